"""Byte-balanced shards by Karmarkar-Karp differencing.

Equal texts form an indivisible group. Groups that are a large share of a shard stand for
themselves; the many small ones are bundled by hash, so at most about 2 * BUNDLES items
remain whatever the corpus holds. Each item starts as a partial partition (its size in one
shard, 0 in the others); the two partial partitions with the largest spread are combined
again and again, the fuller shards of one with the emptier ones of the other, until one is left.

Null text counts 0 bytes (plus 1) and is a group apart from the empty text. Ties go by item number.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.packing import ranked

BUNDLES = 4096


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: k-way Karmarkar-Karp."""
    heap = []
    for i, s in enumerate(sizes):
        parts = [(0, None)] * (shards - 1) + [(s, i)]
        heap.append((-s, i, parts))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        parts = sorted(((x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: t[0])
        heapq.heappush(heap, (parts[0][0] - parts[-1][0], number, parts))
        number += 1
    out = [0] * len(sizes)
    for shard, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            elif t is not None:
                out[t] = shard
    return out


def assign(rows: DataFrame, shards: int, key: str, size: str, bundles: int = BUNDLES) -> DataFrame:
    """rows (a written table) with a shard: rows of one key stay together, sums of size are near equal."""
    groups = rows.groupBy(key).agg(F.sum(size).alias("__s"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    least = max(1, total // bundles)
    heavy = groups.where(F.col("__s") >= least).select(F.col(key), F.col("__s"))  # bundles rows at most, as their sizes add up to total
    heavy_rows = sorted(heavy.collect(), key=lambda r: (-r["__s"], str(r[key])))
    bundle = F.pmod(F.xxhash64(key), F.lit(bundles)).cast("int")
    known = rows.sparkSession.createDataFrame([(r[key], i) for i, r in enumerate(heavy_rows)], f"{key} {rows.schema[key].dataType.simpleString()}, __item int")
    light = rows.join(F.broadcast(known), key, "left_anti").groupBy(bundle.alias("b")).agg(F.sum(size).alias("s")).collect()
    items = [(("h", i), r["__s"]) for i, r in enumerate(heavy_rows)] + [(("b", r["b"]), r["s"]) for r in sorted(light, key=lambda r: r["b"])]
    shard = differencing([s for _, s in items], shards)
    at = {name: k for (name, _), k in zip(items, shard)}
    known = rows.sparkSession.createDataFrame([(r[key], at["h", i]) for i, r in enumerate(heavy_rows)], f"{key} {rows.schema[key].dataType.simpleString()}, __heavy int")
    light_map = rows.sparkSession.createDataFrame([(b, at.get(("b", b), 0)) for b in range(bundles)], "__b int, __light int")
    out = rows.join(F.broadcast(known), key, "left").withColumn("__b", bundle).join(F.broadcast(light_map), "__b", "left")
    return out.withColumn("shard", F.coalesce("__heavy", "__light").cast("int")).drop("__b", "__heavy", "__light")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, under the law `bytes`."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("key"),
    )
    placed = common.table(assign(common.table(rows, "sizes"), shards, "key", "size"), "shards")
    return ranked(placed, "shard", ["doc_id", "key"], out="slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
