"""Quarantine, sampling, grouping and splits of labelled corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import hashing
from tidewell.functions.tables import discard, kept, table, tables_made
from tidewell.functions.text import canonical
from tidewell.operators import neardup


def with_key(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("canon", canonical(text))


def map_label(label: Column | str, mapping: dict[str, str]) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[label]


def quarantine(keyed: DataFrame, label: str = "label") -> DataFrame:
    """reason: empty_text, else label_conflict for keys with several labels, else null. Keys are judged by a grouped sum, so a hot key meets in no task."""
    judged = keyed.groupBy("canon").agg((F.min(label) != F.max(label)).alias("conflict"))
    return keyed.join(judged, "canon").withColumn("reason", F.when(F.col("canon") == "", "empty_text").when(F.col("conflict"), "label_conflict")).drop("conflict")


def reject_reason(label: Column, allowed: list[str], canon: Column, confidence: Column, least: float) -> Column:
    return F.when(~F.coalesce(label.isin(allowed), F.lit(False)), "unexpected_label").when(canon == "", "empty_text").when(confidence.isNull() | (confidence < least), "low_confidence")


def priority_sample(df: DataFrame, stratum: str, order: Column, k: int) -> DataFrame:
    """The k rows of least order in each stratum: every task keeps k at most before the shuffle."""
    return df.withColumn("priority", order).withColumn("rn", F.row_number().over(W.partitionBy(stratum).orderBy("priority"))).where(F.col("rn") <= k)


def random_sample(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows of least order, alike on every run: a sample is the feature."""
    return df.withColumn("priority", order).orderBy("priority").limit(n)


def select_unique(df: DataFrame, taken: DataFrame, key: str, label: str, order: str, targets: dict[str, int]) -> DataFrame:
    """df with status: what of each label is taken in, in the order, up to its target, with no key twice.

    Labels go one after the other as targets lists them. A key in taken (key, label), chosen for a label before or met before
    is exact_duplicate, or exact_duplicate_label_conflict where that label is another. Once the target is reached rows are
    beyond_target; the others are selected. The order must be unique. Labels without a target are left out.
    """
    seen, parts = taken.groupBy(key).agg(F.min(label).alias("__seen")), []
    for name, n in targets.items():
        pool = df.where(F.col(label) == name).join(seen, key, "left")
        free = pool.where("__seen is null").groupBy(key).agg(F.min(order).alias("__first"))
        picked = free.orderBy("__first").limit(n).select(key, "__first")
        last = picked.agg(F.count("*").alias("__n"), F.max("__first").alias("__last"))  # one row
        beyond = (F.col("__n") >= n) & (F.coalesce(F.col(order) > F.col("__last"), F.lit(True)))
        reason = F.when(beyond, "beyond_target").when(F.col("__seen") != name, "exact_duplicate_label_conflict").when(F.col("__seen").isNotNull() | (F.col(order) != F.col("__first")), "exact_duplicate").otherwise("selected")
        parts.append(pool.join(free, key, "left").crossJoin(F.broadcast(last)).withColumn("status", reason).select(*df.columns, "status"))
        seen = seen.unionByName(picked.select(key, F.lit(name).alias("__seen")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_counts(df: DataFrame, label: str, targets: dict[str, int]) -> DataFrame:
    """df, or an error that names the labels with fewer rows than their target."""
    have = {r[0]: r[1] for r in df.where(F.col(label).isin(*targets)).groupBy(label).count().collect()}  # a row for each target
    short = {k: n - have.get(k, 0) for k, n in targets.items() if have.get(k, 0) < n}
    if short:
        raise ValueError(f"too few unique rows: {short}")
    return df


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in the order, as a grouped minimum."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def exact_quota(df: DataFrame, stratum: list[str], order: Column, rate: float) -> DataFrame:
    """int(n * rate + 0.5) rows of least order in each stratum are targeted."""
    n = df.groupBy(*stratum).agg(F.floor(F.count("*") * rate + 0.5).alias("quota"))
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(*stratum).orderBy(order)))
    return ranked.join(F.broadcast(n), stratum).withColumn("targeted", F.col("rn") <= F.col("quota"))  # n: one row for each stratum


def leakage_safe_split(df: DataFrame, group: str, label: str, human: str, seed: int, validation: float, test: float) -> DataFrame:
    """group, stratum, split: whole groups go to one split; a group with a row not labelled by people trains."""
    g = df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(label)), "+").alias("stratum"), F.min(F.col(human).cast("int")).alias("human"))
    u = hashing.unit(F.lit(str(seed)), F.col("stratum"), F.col(group))
    return g.select(group, "stratum", F.when(F.col("human") == 0, "train").when(u < test, "test").when(u < test + validation, "validation").otherwise("train").alias("split"))


def two_pass_split(df: DataFrame, key: str, text: str, label: str, human: str, vary: Callable[[DataFrame], DataFrame], seed: int, validation: float, test: float) -> DataFrame:
    """df with source_group, variant_group, group, stratum, split: a split safe for near copies of the texts and of their variants.

    Near-duplicate groups are split; vary makes (key, variant) of the rows with that target_split; the variants are grouped
    in turn, both groupings are merged, and the merged groups are split. Keys must be unique and not null.
    """
    grouped = lambda rows, t, name: neardup.duplicate_groups(rows, key, t).select(key, F.col("component").cast("string").alias(name))
    with tables_made() as made:
        rows = kept(df.select(key, label, human).join(grouped(df, text, "source_group"), key), made, "rows")
    first = leakage_safe_split(rows, "source_group", label, human, seed, validation, test)
    homes = rows.join(first.select("source_group", F.col("split").alias("target_split")), "source_group").select(key, "target_split")
    with tables_made() as made:
        variants = kept(vary(df.join(homes, key)).select(key, "variant"), made, "variants")
    with tables_made() as made:
        both = kept(rows.join(grouped(variants, "variant", "variant_group"), key), made, "both")
    discard(rows, variants)
    merged = neardup.merge_groupings(both, key, ["source_group", "variant_group"]).select(F.col("node").alias(key), F.col("component").cast("string").alias("group"))
    both = table(both.join(merged, key), "groups")
    both = both.join(leakage_safe_split(both, "group", label, human, seed, validation, test), "group").drop(label, human)
    return df.join(both, key)


def group_names(members: DataFrame, group: str, member: str) -> DataFrame:
    """A name of each group made of its sorted members' hashes."""
    return members.groupBy(group).agg(F.concat(F.lit("grp_"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(F.sha2(member, 256))), "\u0000"), 256), 1, 20)).alias("group_id"), F.count("*").alias("n"))


def take_ranges(df: DataFrame, stratum: str, order: Column, counts: dict[str, int]) -> DataFrame:
    """Disjoint slices of one shuffled pool for each stratum: a column part names the slice, null beyond them."""
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(stratum).orderBy(order)))
    part, at = F.lit(None).cast("string"), sum(counts.values())
    for name, n in reversed(counts.items()):
        part = F.when((F.col("rn") > at - n) & (F.col("rn") <= at), name).otherwise(part)
        at -= n
    return ranked.withColumn("part", part)


def mix_plan(perturbed: dict[str, int], pool: dict[str, int], clean: float = 0.3, blind: float = 0.1, balanced: bool = True) -> dict[str, dict[str, int]]:
    """Rows to take of each part and label, from what there is: perturbed rows, and a pool of originals for the other two parts.

    Balanced: labels get equal numbers, as many as the scarcest of both allows. Else all perturbed rows, and the pool's label shares.
    Halves round to even.
    """
    labels, keep = list(perturbed), 1 - clean - blind
    if balanced:
        each = min(min(perturbed.values()) / keep, min(pool.values()) / (clean + blind))
        return {part: dict.fromkeys(labels, round(each * share)) for part, share in (("perturbed", keep), ("clean_original", clean), ("blindspot_raw", blind))}
    total, n = sum(perturbed.values()) / keep, sum(pool.values())
    return {"perturbed": dict(perturbed), **{part: {k: round(total * share * pool[k] / n) for k in labels} for part, share in (("clean_original", clean), ("blindspot_raw", blind))}}


def take_until(df: DataFrame, stratum: str, order: Column, made: Column, counts: dict[str, int]) -> DataFrame:
    """The first counts[stratum] rows in the order whose generated value `made` isn't null, with `failed`: the nulls passed over before them."""
    w = W.partitionBy(stratum).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ranked = df.withColumns({"kept": F.count(made).over(w), "failed": F.count_if(made.isNull()).over(w)})
    quota = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col(stratum)]
    return ranked.where(made.isNotNull() & (F.col("kept") <= quota))
