"""Classification metrics, curves and paired tests as aggregates over long score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _ratio(a: Column, b: Column) -> Column:
    """0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(y: str = "y", pred: str = "pred") -> list[Column]:
    y, p = F.col(y), F.col(pred)
    return [_count((y == 1) & (p == 1)).alias("tp"), _count((y == 0) & (p == 1)).alias("fp"), _count((y == 1) & (p == 0)).alias("fn"), _count((y == 0) & (p == 0)).alias("tn")]


def scores(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, macro_f1 from tp, fp, fn, tn; six decimals."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    new = {"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": f1, "macro_f1": (f1 + f0) / 2}
    return counts.withColumns({k: F.round(v, 6) for k, v in new.items()})


def invalid_as_wrong(pred: Column, y: Column) -> Column:
    """A prediction that isn't 0 or 1 counts as the other label."""
    return F.when(pred.isin(0, 1), pred).otherwise(1 - y)


def curve(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Cumulative tp and fp at each distinct score, descending: ties are one step. Scores are pre-aggregated, so rows are distinct scores."""
    step = df.groupBy(*by, p).agg(_count(F.col(y) == 1).alias("pos"), _count(F.col(y) == 0).alias("neg"))
    w = W.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    return step.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})


def average_precision(df: DataFrame, by: list[str]) -> DataFrame:
    c = curve(df, by)
    return c.groupBy(*by).agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos").cast("double")), F.lit(0.0)), 6).alias("average_precision"))


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid area: sum of neg * (tp before + tp) / 2 over P * N."""
    c = curve(df, by)
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    return c.groupBy(*by).agg(F.round(F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")), 6).alias("roc_auc"))


def pr_area(df: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid area under precision over recall, from recall 0 and precision 1 on; 0 without positives."""
    c = curve(df, by)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.coalesce(F.lag("precision").over(W.partitionBy(*by).orderBy(F.desc("p"))), F.lit(1.0))
    c = c.withColumn("precision", precision).withColumn("before", before)
    area = F.try_divide(F.sum(F.col("pos") * (F.col("precision") + F.col("before")) / 2), F.sum("pos").cast("double"))
    return c.groupBy(*by).agg(F.round(F.coalesce(area, F.lit(0.0)), 6).alias("pr_auc"))


def rates(counts: DataFrame) -> DataFrame:
    """n, n_hate and predicted_hate_rate from tp, fp, fn, tn; six decimals."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counts.withColumns({"n": n, "n_hate": tp + fn, "predicted_hate_rate": F.round(_ratio(tp + fp, n), 6)})


def report_matrix(df: DataFrame, thresholds: DataFrame, by: list[str], default: float = 0.5) -> DataFrame:
    """Metrics of each system and further columns of `by`, at the system's own threshold where thresholds (system, t: a row
    for each system) has one, else at the default: threshold is null and tuned false there."""
    joined = df.join(thresholds.select("system", F.col("t").alias("threshold")), "system", "left")
    pred = joined.withColumn("pred", (F.col("p") > F.coalesce("threshold", F.lit(default))).cast("int"))
    counts = pred.groupBy(*by, "threshold").agg(*confusion())
    return rates(scores(counts)).withColumn("tuned", F.col("threshold").isNotNull())


def threshold_sweep(df: DataFrame, by: list[str], steps: int = 200, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Metrics at each threshold of the grid (strictly above counts as 1). A row is first put into one of steps + 1
    bins by the thresholds below its score, and only the bins' counts meet the grid, a constant of `steps` rows."""
    step = (high - low) / (steps - 1)
    t = lambda i: F.round(F.lit(low) + i * step, 9)
    guess = F.greatest(F.lit(0), F.least(F.lit(steps), F.ceil((F.col("p") - low) / step)))
    below = F.when((guess > 0) & (t(guess - 1) >= F.col("p")), guess - 1).when((guess < steps) & (t(guess) < F.col("p")), guess + 1).otherwise(guess)
    bins = df.where(F.col("p").isNotNull()).withColumn("bin", F.when(F.isnan("p"), steps).otherwise(below).cast("long")).groupBy(*by, "bin").agg(_count(F.col("y") == 1).alias("pos"), _count(F.col("y") == 0).alias("neg"))
    grid = F.broadcast(df.sparkSession.range(steps).select(F.col("id").alias("i"), t(F.col("id")).alias("t")))
    total = lambda c, above: F.sum(F.when((F.col("bin") > F.col("i")) == F.lit(above), F.col(c)).otherwise(0))
    counts = {"tp": total("pos", True), "fp": total("neg", True), "fn": total("pos", False), "tn": total("neg", False)}
    return scores(bins.crossJoin(grid).groupBy(*by, "t").agg(*[v.alias(k) for k, v in counts.items()]))


def best_threshold(swept: DataFrame, by: list[str]) -> DataFrame:
    """The least threshold of greatest f1."""
    return swept.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("f1"), "t"))).where("rn = 1").select(*by, "t", "f1")


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p: 2 * sum of binomials up to the lesser count over 2**(b + c), at most 1; 1 without discordant rows.

    One pass: each term's logarithm follows from the one before it; the sum is kept relative to the last term, the greatest.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.lit(1.0).alias("share"))
    step = lambda acc, i: F.struct((acc["term"] + F.log((n - i + 1) / i)).alias("term"), (acc["share"] * i / (n - i + 1) + 1.0).alias("share"))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: F.exp(acc["term"] + F.log(acc["share"])))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def bootstrap_f1(counts: DataFrame, by: list[str], resamples: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of f1. F1 depends on the four counts only, so a resample is one multinomial draw of them."""
    import numpy as np
    import pandas as pd

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        k = np.array([r.tp, r.fp, r.fn, r.tn], float)
        x = np.random.default_rng(seed).multinomial(int(k.sum()), k / k.sum(), resamples)
        f1 = 2 * x[:, 0] / np.maximum(2 * x[:, 0] + x[:, 1] + x[:, 2], 1)
        return pd.DataFrame([[*(r[c] for c in by), *np.quantile(f1, [alpha / 2, 1 - alpha / 2])]], columns=[*by, "low", "high"])

    kinds = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in by)
    return counts.groupBy(*by).applyInPandas(draw, f"{kinds}, low double, high double")


def localisation(gold: Column, pred: Column) -> list[Column]:
    """tp, fp, fn of word index arrays in a row."""
    return [F.size(F.array_intersect(gold, pred)).alias("tp"), F.size(F.array_except(pred, gold)).alias("fp"), F.size(F.array_except(gold, pred)).alias("fn")]


# ---------------------------------------------------------------- percentiles


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], places: int = 6) -> DataFrame:
    """For each group the values at places round_half_even((n - 1) q) of its sorted values, counted by value first:
    what is put in order are the distinct values, never a group's rows. Null values don't count; a group without values has no row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    order = W.partitionBy(*by).orderBy(value)
    counts = counts.withColumns({"__to": F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum("__n").over(W.partitionBy(*by))})
    place = lambda q: F.bround((F.col("__all") - 1) * F.lit(q), 0)
    at = lambda q: F.min(F.when(F.col("__to") > place(q), F.col(value)))
    return counts.groupBy(*by).agg(*[F.round(at(q), places).alias(name) for name, q in quantiles.items()])


def list_histogram(df: DataFrame, lists: str) -> DataFrame:
    """value, n, n_rows: how often each value stands in the lists, and in how many rows."""
    each = df.select(F.explode(F.transform(F.array_distinct(lists), lambda v: F.struct(v.alias("value"), F.size(F.filter(lists, lambda x: x == v)).alias("times")))).alias("e"))
    return each.groupBy(F.col("e.value").alias("value")).agg(F.sum("e.times").alias("n"), F.count("*").alias("n_rows"))
