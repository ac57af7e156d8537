"""The gate behind a corpus of variants: traces replayed, invariants of rows, groups and totals, and the review sheet.

Expected columns: sample_id, original_text, perturbed_text, label, label_mapped, annotation_type, target_split,
duplicate_group_id, the columns of obfuscate.VARIANT, and teencode_eligible, teencode_targeted, teencode_applied,
teencode_valid_span_count, teencode_applied_span_count. All rows are judged and all violations returned; null counts as
false, zero or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import hashing
from tidewell.functions.text import canonical
from tidewell.operators.obfuscate import KINDS, LEXICAL, Lexicon

SPLITS = ("train", "validation", "test")


def replay(original: Column, edits: Column) -> Column:
    """The text after all edits; null where an edit doesn't find what it replaced."""

    def step(acc: Column, e: Column) -> Column:
        held = F.substring(acc, e["before_start"] + 1, e["before_end"] - e["before_start"])
        new = F.concat(F.substring(acc, F.lit(1), e["before_start"]), e["after"], F.substring(acc, e["before_end"] + 1, F.length(acc)))
        return F.when(held == e["before"], new)

    return F.aggregate(edits, original, step)


def _lookup(c: Column) -> Column:
    return F.lower(F.trim(c))


def row_rules(lexicon: Lexicon | None, span_rate: float = 1.0) -> dict[str, Column]:
    """rule name: whether the row breaks it."""
    edits, types = F.col("perturbation_edits"), F.col("perturbation_types")
    lexical = F.filter(edits, lambda e: e["perturbation_type"] == LEXICAL)
    n = F.coalesce(F.when(edits.isNotNull(), F.size(lexical)), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    some = lambda bad: F.coalesce(F.exists(lexical, lambda e: F.coalesce(bad(e), F.lit(True))), F.lit(False))
    known = [(f"{s}\0{v}".lower(), lexicon.rule(s, v), len(vs)) for s, vs in (lexicon.variants if lexicon else {}).items() for v in vs]
    table = lambda at: F.create_map(*[F.lit(x) for k in known for x in (k[0], k[at])]) if known else F.create_map().cast(f"map<string,{'int' if at == 2 else 'string'}>")
    pair = lambda e: F.concat_ws("\0", F.regexp_replace(_lookup(e["canonical_form"]), r"(?U)\s+", " "), _lookup(e["selected_variant"]))
    wanted = F.when(flag("teencode_targeted"), F.greatest(F.lit(1), F.ceil(count("teencode_valid_span_count") * span_rate))).otherwise(0)
    name, version, sha = (lexicon.name, lexicon.version, lexicon.sha256) if lexicon else ("", "", "")
    distinct = F.size(F.array_distinct(F.coalesce(types, F.array().cast("array<string>"))))
    rules = {
        "unchanged": F.col("perturbed_text") == F.col("original_text"),
        "empty_output": F.trim(F.coalesce("perturbed_text", F.lit(""))) == "",
        "trace_missing": edits.isNull() | (F.size(edits) == 0),
        "trace_mismatch": F.coalesce(replay(F.col("original_text"), edits), F.lit("")) != F.coalesce("perturbed_text", F.lit("")),
        "resource_name": some(lambda e: e["resource_name"] != name),
        "resource_version": some(lambda e: e["resource_version"] != version),
        "resource_sha256": some(lambda e: e["resource_sha256"] != sha),
        "round_trip": some(lambda e: ~F.map_contains_key(table(1), pair(e))),
        "rule_id": some(lambda e: F.element_at(table(1), pair(e)) != e["rule_id"]),
        "candidate_count": some(lambda e: F.element_at(table(2), pair(e)) != e["candidate_count"]),
        "types_missing": distinct == 0,
        "mixed_types": (F.col("perturbation_mode") == "mixed") & (distinct < 2),
        "edit_count": count("perturbation_count") != F.coalesce(F.when(edits.isNotNull(), F.size(edits)), F.lit(0)),
        "label_mapping": ~F.col("label").eqNullSafe(F.col("label_mapped")),
        "label_unknown": ~F.coalesce(F.col("label").isin("HATE", "CLEAN"), F.lit(False)),
        "eligible": flag("teencode_eligible") != (count("teencode_valid_span_count") > 0),
        "applied": flag("teencode_applied") != (count("teencode_applied_span_count") > 0),
        "applied_spans": count("teencode_applied_span_count") != n,
        "target_spans": count("teencode_applied_span_count") != wanted,
        "applied_type": flag("teencode_applied") != F.coalesce(F.array_contains(types, LEXICAL), F.lit(False)),
        "target_unfulfilled": flag("teencode_targeted") & ~flag("teencode_applied"),
        "target_ineligible": flag("teencode_targeted") & ~flag("teencode_eligible"),
        "weak_in_evaluation": (F.col("annotation_type") == "weak_ai") & (F.col("target_split") != "train"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def row_violations(df: DataFrame, lexicon: Lexicon | None = None, span_rate: float = 1.0) -> DataFrame:
    """(sample_id, rule): one projection over the rows, no shuffle."""
    rules = row_rules(lexicon, span_rate)
    return df.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()]))).alias("rule"))


def group_violations(df: DataFrame) -> DataFrame:
    """(subject, rule): duplicate groups, and equal outputs, that lie in several splits. Grouped minima, so hot keys are combined first."""
    across = lambda key, rule: df.groupBy(key.alias("subject")).agg((F.min("target_split") != F.max("target_split")).alias("bad")).where("bad and subject <> ''").select("subject", F.lit(rule).alias("rule"))
    return across(F.col("duplicate_group_id"), "group_across_splits").union(across(F.sha2(canonical("perturbed_text"), 256), "output_across_splits"))


def total_violations(df: DataFrame, total: int | None = None, per_label: dict[str, int] | None = None, exempt: tuple[str, ...] = (), rate: float | None = None) -> DataFrame:
    """(subject, rule): wrong totals, kinds that never occur (but for exempt ones), no mixed row, and strata off their quota."""
    spark = df.sparkSession
    labels = per_label or {}
    seen = [F.count_if(F.array_contains("perturbation_types", k)).alias(f"kind_{k}") for k in KINDS]
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col("perturbation_mode") == "mixed").alias("mixed"), *[F.count_if(F.col("label") == k).alias(f"label_{k}") for k in labels], *seen).first()
    found = [("total", "total")] if total is not None and one["n"] != total else []
    found += [(k, "label_total") for k, n in labels.items() if one[f"label_{k}"] != n]
    found += [(k, "kind_missing") for k in KINDS if k not in exempt and not one[f"kind_{k}"]]
    found += [("mixed", "mixed_missing")] if not one["mixed"] else []
    out = spark.createDataFrame(found, "subject string, rule string")
    if rate is None:
        return out
    strata = df.where("teencode_eligible").groupBy("label", "target_split").agg(F.count("*").alias("n"), F.count_if("teencode_targeted").alias("t"))
    return out.union(strata.where(F.col("t") != F.floor(F.col("n") * rate + 0.5)).select(F.concat_ws("/", "label", "target_split"), F.lit("stratum_quota")))


def gate(df: DataFrame, lexicon: Lexicon | None = None, span_rate: float = 1.0, **totals) -> DataFrame:
    """(subject, rule) of every violation; an empty table is a passed gate."""
    rows = row_violations(df, lexicon, span_rate).select(F.col("sample_id").cast("string").alias("subject"), "rule")
    return rows.union(group_violations(df)).union(total_violations(df, **totals))


def review_sample(df: DataFrame, size: int, seed: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """`size` rows for people to judge, with columns pick (1 ..) and slot (null: filled by rank).

    Ranked by hash. Each slot in turn (labels, sources, splits, kinds, short and many-candidate lexicon edits,
    mixed) takes its first row not yet picked. With s slots a slot's row is among its first s, so s * s short
    records decide on the driver; s is the number of sources and some 20 more.
    """
    if size <= 0:
        return df.limit(0).select("*", F.lit(0).alias("pick"), F.lit("").alias("slot"))
    rank = hashing.key(F.lit(str(seed)), F.col("sample_id").cast("string"))
    lexical = lambda ok: F.coalesce(F.exists("perturbation_edits", lambda e: (e["perturbation_type"] == LEXICAL) & ok(e)), F.lit(False))
    sources = sorted(r[0] for r in df.select("source_dataset").distinct().collect() if r[0] is not None)
    slots = {f"label:{x}": F.col("label") == x for x in ("HATE", "CLEAN")}
    slots |= {f"source:{x}": F.col("source_dataset") == x for x in sources}
    slots |= {f"split:{x}": F.col("target_split") == x for x in SPLITS}
    slots |= {f"kind:{x}": F.array_contains("perturbation_types", x) for x in KINDS}
    slots |= {"short_variant": lexical(lambda e: F.length(e["selected_variant"]) <= 2), "many_candidates": lexical(lambda e: e["candidate_count"] >= 10), "mixed": F.col("perturbation_mode") == "mixed"}
    slots |= extra or {}
    names = list(slots)
    ids = df.select(F.col("sample_id").alias("id"), rank.alias("rank"), F.array_compact(F.array(*[F.when(ok, F.lit(i)) for i, ok in enumerate(slots.values())])).alias("s"))
    first = ids.select("id", "rank", F.explode("s").alias("s")).withColumn("rn", F.row_number().over(W.partitionBy("s").orderBy("rank", "id"))).where(F.col("rn") <= len(names))
    by_slot: dict[int, list] = {}
    for r in first.orderBy("s", "rn").collect():
        by_slot.setdefault(r["s"], []).append(r["id"])
    picked: dict = {}
    for i in range(len(names)):
        new = next((x for x in by_slot.get(i, []) if x not in picked), None)
        if new is not None:
            picked[new] = names[i]
    for r in ids.select("id", "rank").orderBy("rank", "id").limit(size + len(picked)).collect():  # the sheet itself bounds this
        picked.setdefault(r["id"], None)
    chosen = [(x, n + 1, s) for n, (x, s) in enumerate(picked.items()) if n < size]
    table = df.sparkSession.createDataFrame(chosen, f"sample_id {df.schema['sample_id'].dataType.simpleString()}, pick int, slot string")
    return df.join(F.broadcast(table), "sample_id")  # `size` rows
