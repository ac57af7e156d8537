"""Vector best-fit packing of token sequences.

A bin (a training sequence) has capacities in tokens, documents and attention cost (sum
of squared piece lengths). Pieces of one length are alike, so the packing is made on the
histogram of lengths: bins with equal residuals form a class, and pieces, longest first,
go to the class with the least weighted norm (or the greatest weighted dot product) of
residuals among those that hold the piece under every constraint. All three residuals count in
the choice (WEIGHTS), though by default documents and cost have room for whatever the tokens hold:
tighter capacities would open more sequences. The state is bounded by the capacities, not by the corpus, so the driver packs exactly and globally; what it
hands out is a table of runs (length, ranks from..to -> bins from..to, offset).

Documents: null text is empty; every document ends with the end id, so an empty one has one
token. Only documents longer than a sequence are cut. Ties in rank go by doc_id, then piece.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.tokens import encode

END_ID = 2
#: What tokens, documents and attention cost weigh in the choice of a bin.
WEIGHTS = (1.0, 0.2, 0.2)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, max_tokens: int, text: str = "text", end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and ids if asked for. The first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids_out: list[np.ndarray] = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(t.as_py(), json_path, ranks_path), np.uint32(end_id)).astype("<u4", copy=False)
                first = len(ids) % max_tokens or max_tokens
                cuts = [0, *range(first, len(ids) + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b])))
                    if with_ids:
                        ids_out.append(ids[a:b])
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in ids_out], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def plan(hist: dict[int, int], max_tokens: int, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first bin, offset): piece `rank + i` of that length lies in bin `bin + i` at the offset.

    rule: "norm" takes the class whose residuals left after the piece have the least weighted norm, "dot" the
    one whose residuals have the greatest weighted dot product with the piece's demands. Capacities are scaled to 1.
    Ties go to the tightest class. Cost is counted in steps of max_cost / max_tokens, a piece's rounded up: so no
    bin exceeds max_cost, at the default max_cost (max_tokens squared) the rounding never binds, and classes stay few.
    """
    max_docs = max_docs or max_tokens
    max_cost = max_cost or max_tokens * max_tokens
    cap = np.array([max_tokens, max_docs, max_tokens], float)
    wt = np.asarray(weights, float)
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residuals -> runs of bins (first, count)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    for length in sorted(hist, reverse=True):
        left, rank = hist[length], 0
        need = (length, 1, -(-length * length * max_tokens // max_cost))
        assert length <= max_tokens and need[2] <= max_tokens, "a piece exceeds the capacity of an empty bin"
        part = np.array(need) / cap

        def score(residuals: np.ndarray) -> np.ndarray:
            r = residuals / cap
            return (wt * (r - part) ** 2).sum(1) if rule == "norm" else -(wt * r * part).sum(1)

        def offer(key: tuple[int, int, int]) -> None:
            if all(x >= y for x, y in zip(key, need)):
                heapq.heappush(heap, (float(score(np.array([key]))[0]), key))

        def put(key: tuple[int, int, int], first: int, count: int) -> None:
            if key not in classes:
                classes[key] = []
                offer(key)
            classes[key].append((first, count))

        keys = np.array(list(classes), np.int64).reshape(-1, 3)
        keys = keys[(keys >= need).all(1)]
        heap = list(zip(score(keys).tolist(), map(tuple, keys.tolist())))
        heapq.heapify(heap)
        while left:
            while heap and heap[0][1] not in classes:
                heapq.heappop(heap)
            if not heap:  # open as many bins as whole ones of this length need
                per = min(max_tokens // length, max_docs, max_tokens // need[2])
                new = -(-left // per)
                put((max_tokens, max_docs, max_tokens), bins, new)
                bins += new
                continue
            best = heap[0][1]
            first, count = classes[best].pop()
            if not classes[best]:
                del classes[best]
            n = min(count, left)
            if n < count:
                put(best, first + n, count - n)
            runs.append((length, rank, n, first, max_tokens - best[0]))
            put((best[0] - length, best[1] - 1, best[2] - need[2]), first, n)
            left -= n
            rank += n
    return runs


def ranked(rows: DataFrame, group: str, order: list[str], per_block: int = 50_000, out: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within group, without one task for a group: blocks by hash of the order's first column,
    row numbers in each block, and the blocks' sums before it. rows must be stable when read again (a written table)."""
    n = rows.count()
    blocks = max(1, -(-n // per_block))
    b = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sums = b.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(W.partitionBy(group, "__b").orderBy(*order)) - 1
    return b.withColumn("__i", inner).join(sums, [group, "__b"]).withColumn(out, (F.col("__i") + F.col("__before")).cast("long")).drop("__b", "__i", "__before")


def pack(parts: DataFrame, max_tokens: int, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """parts (a written table with doc_id, piece, length) with sequence_id and offset."""
    spark = parts.sparkSession
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    runs = sorted(plan(hist, max_tokens, max_docs, max_cost, weights, rule))
    keys = np.array([[r[0], r[1]] for r in runs], np.int64).reshape(-1, 2)
    vals = np.array([[r[3], r[4]] for r in runs], np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((keys[:, 0] << 44 | keys[:, 1], keys[:, 1].copy(), vals))  # bounded by the capacities
    with_rank = ranked(parts, "length", ["doc_id", "piece", "start"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema), "sequence_id long, offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, to = shared.value
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = get("rank")
            i = np.searchsorted(code, get("length") << 44 | rank, "right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(to[i, 0] + rank - first[i]), pa.array(to[i, 1])], names=[*names, "sequence_id", "offset"])

    return with_rank.select(*parts.columns, "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, max_tokens: int = 1024, max_docs: int | None = None, max_cost: int | None = None, **options) -> DataFrame:
    """Cut, tokenize and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = common.table(pieces(docs, max_tokens), "pieces")
    return pack(parts, max_tokens, max_docs, max_cost, **options)
