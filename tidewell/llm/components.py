"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; nothing is collected. A star's centre may hold
any share of the edges: its minimum is aggregated before the shuffle and the join's long side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """u > v in every edge (u, v). Large: higher neighbours of a node go to its least neighbour; small: the lower ones and itself."""
    if large:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(edges.select(F.col("v"), F.col("u")))
        # written, so that both sides of the join are dealt anew and a centre with many edges can be split
        least = common.table(both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m")), "least")
        out = both.where("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
        least = down.groupBy("n").agg(F.min("o").alias("m"))
        out = down.join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n"), F.col("m")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the least node reachable. Nodes without edges are not listed. Nulls join nothing."""
    u, v = F.greatest(a, b), F.least(a, b)
    now = common.table(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = common.table(_star(_star(now, True), False), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))), F.sum(F.shiftright(h, 40))).first())
