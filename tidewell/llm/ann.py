"""Nearest neighbours by multiprobe p-stable hashing, over an index in shards.

Vectors are scaled to unit length, so Euclidean order is cosine order. Each shard of the
index (rows by hash of vec_id, about SHARD_ROWS) has several tables; a table's key is the
vector of floor((a.x + b) / w) for Gaussian a. A query visits its own bucket and those that
differ by the perturbations most likely to hold a neighbour: their sequence follows the
expected squared distances to bucket borders, mapped onto the query's own sorted distances.
The tables' candidates are merged and ranked by exact cosine in double precision.

Null, zero and non-finite vectors, vectors with null components or of another dimension than
most take no part. Equal vectors: ties go to the smaller vec_id. Rows that repeat a vec_id
and its vector count once; rows that repeat a vec_id with another vector are rows of their own,
each found and, if asked for, ranked for itself. A query that the probes leave with fewer than k of the other rows,
though there are more, is compared with every row instead; only a table of k rows or fewer gives fewer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm import common

SHARD_ROWS = 2048
TABLES, HASHES, WIDTH, PROBES = 12, 8, 2.0, 80


def perturbations(m: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (0 to 2m - 1) among a query's sorted border distances, by expected sum of squares; the empty set first.

    Ranks r and 2m - 1 - r are the two borders of one hash, so no set holds both.
    """
    j = np.arange(1, 2 * m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    up = 2 * m + 1 - j
    e = np.where(j <= m, low, 1 - up / (m + 1) + up * (up + 1) / (4 * (m + 1) * (m + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(float(e[0]), (0,))]
    while len(out) < probes and heap:
        s, a = heapq.heappop(heap)
        if not any(2 * m - 1 - x in a for x in a):
            out.append(a)
        if a[-1] + 1 < 2 * m:
            heapq.heappush(heap, (s - e[a[-1]] + e[a[-1] + 1], (*a[:-1], a[-1] + 1)))
            heapq.heappush(heap, (s + e[a[-1] + 1], (*a, a[-1] + 1)))
    return out


@lru_cache(4)
def _family(dim: int, tables: int, m: int, w: float):
    rng = np.random.default_rng(20240229)
    return rng.standard_normal((tables, dim, m)), rng.random((tables, m)) * w, rng.integers(1, 1 << 62, m) | 1


class Index:
    """The tables of one shard. Without tables every row is a candidate."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, tables: int, m: int, w: float):
        self.rows, self.ids, self.x = rows, ids, vectors
        self.unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.m, self.w = m, w
        self.a, self.b, self.mult = _family(vectors.shape[1], tables, m, w)
        self.tables = []
        for a, b in zip(self.a, self.b):
            key = (np.floor((self.unit @ a + b) / w).astype(np.int64) * self.mult).sum(1)
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], order))

    def search(self, asked: np.ndarray, q: np.ndarray, k: int, probes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's row, its k nearest ids, scores) of each query."""
        sets = perturbations(self.m, probes)
        unit = q / np.linalg.norm(q, axis=1)[:, None]
        found = []
        for (keys, order), a, b in zip(self.tables, self.a, self.b):
            f = (unit @ a + b) / self.w
            h = np.floor(f).astype(np.int64)
            own = (h * self.mult).sum(1)
            near = np.concatenate([f - h, 1 - (f - h)], 1)
            rank = np.argsort(near, 1)
            step = np.where(rank < self.m, -1, 1) * self.mult[rank % self.m]
            probe = np.stack([own + (step[:, list(s)].sum(1) if s else 0) for s in sets], 1)
            found.append((np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right"), order))
        for i in range(len(q)):
            hit = np.full(len(self.ids), not found)
            for lo, hi, order in found:
                for s, e in zip(lo[i][lo[i] < hi[i]], hi[i][lo[i] < hi[i]]):
                    hit[order[s:e]] = True
            hit &= self.rows != asked[i]
            at = np.flatnonzero(hit)
            # exact cosine in double precision; each sum runs over one vector alone, so it doesn't depend on the shard
            score = (self.x[at] * q[i]).sum(1) / (np.sqrt((self.x[at] ** 2).sum(1)) * np.sqrt((q[i] ** 2).sum()))
            best = np.lexsort((self.ids[at], -score))[:k]
            yield int(asked[i]), self.ids[at][best], score[best]


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that take part, each once (by vec_id and vector)."""
    v = F.col(vector).cast("array<double>")
    ok = v.isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(ok).where(F.exists("v", lambda x: x != 0)).dropDuplicates(["vec_id", "v"])


def search(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES) -> DataFrame:
    """The k nearest of each row where is_query holds: query_id, rank, vec_id, score.

    Every row is indexed. Queries visit every shard in blocks: rows sent are rows + queries * shards,
    and as many again for the queries that come out short, if there are any.
    """
    rows = common.table(usable(vectors, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")  # written, so the numbers stay
    counts = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    dim, n = (counts[0]["d"], counts[0]["count"]) if counts else (1, 0)
    rows = rows.where(F.size("v") == dim)
    shards = max(1, -(-n // shard_rows))
    base = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("query"), "row", "vec_id", "v")
    asked = rows.where(is_query)

    def run(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
        held, shard, index = [], None, None
        for batch in batches:
            s, query, row, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(query) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(s)]):
                if a == b:
                    continue
                if shard != s[a]:
                    held, shard, index = [], s[a], None
                if query[a] == 0:
                    held.append((row[a:b], ids[a:b], x[a:b]))
                    continue
                if not held:
                    continue
                index = index or Index(*map(np.concatenate, zip(*held)), tables, hashes, width)
                out = [(qi, j, c) for qi, js, cs in index.search(row[a:b], x[a:b], k, probes) for j, c in zip(js.tolist(), cs.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["asked", "vec_id", "score"])

    def visit(asked: DataFrame, tables: int) -> DataFrame:
        sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("query"), "row", "vec_id", "v")
        return base.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "query").mapInArrow(lambda batches: run(batches, tables), "asked long, vec_id long, score double")

    order = W.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    best = lambda near: near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("asked", "rank", "vec_id", "score")
    found = common.table(best(visit(asked, tables)), "found")
    filled = found.groupBy("asked").count().where(F.col("count") >= min(k, n - 1)).select(F.col("asked").alias("row"))
    short = common.table(asked.join(filled, "row", "left_anti").select("row", "vec_id", "v"), "short")
    if n >= 2 and not short.isEmpty():
        found = found.join(filled.withColumnRenamed("row", "asked"), "asked", "left_semi").unionByName(best(visit(short, 0)))
    return found.join(asked.select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id")), "asked").select("query_id", "rank", "vec_id", "score")
