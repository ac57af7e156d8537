"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

Texts are lower-cased words; five words make a shingle. A window has as many words as the
benchmark item it is held against (the whole document where that is shorter). Windows lie
where a shared shingle puts them: one that shares no shingle with an item has similarity 0.
Windows and items get 64-bit SimHashes of their weighted shingles (weight: occurrences). A
multi-index over RADIUS + 1 blocks of the fingerprint finds every pair of one size within
Hamming distance RADIUS: by the pigeonhole principle such a pair agrees in a block. Each
candidate is verified by weighted Jaccard similarity, sum of least over sum of greatest weights.

At similarity 0.8 two SimHashes differ in 9.7 bits on average with deviation 2.9; RADIUS 22
is four deviations above.

Items of fewer than five words count as one shingle of all their words and must occur exactly.
Null and empty texts have no windows, null and empty items find nothing. Repeated documents are
each matched; repeated items too, under their own item_id. Documents with a null doc_id can't be named and match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

N_WORDS = 5
RADIUS = 22
#: Bytes (rows of 64, and 8 for each element of an array) that are sent to every executor; beyond, the join is shuffled.
BROADCAST_BYTES = 128 << 20


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(w: Column, n: int) -> Column:
    """One hash for each run of n words, in order."""
    runs = F.transform(w, lambda x, i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)]))
    return F.slice(runs, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))


def simhash(h: Column) -> Column:
    """64 bits: each is set if at least half of the shingles (with repetition) have it."""
    half = F.size(h) / 2.0
    bit = lambda b: F.when(F.aggregate(h, F.lit(0), lambda acc, x: acc + F.shiftrightunsigned(x, b).bitwiseAND(F.lit(1)).cast("int")) >= half, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return reduce(lambda x, y: x.bitwiseOR(y), [bit(b) for b in range(64)])


def blocks(f: Column, count: int) -> Column:
    """(block number, its bits) as numbers, count blocks of 64 bits dealt as evenly as possible."""
    cuts = [64 * i // count for i in range(count + 1)]
    return F.array(*[F.shiftrightunsigned(f, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") + F.lit(i << 8) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes, a repeated hash weighing more."""
    times = lambda arr, h: F.size(F.filter(arr, lambda x: x == h))
    plain = F.size(F.array_intersect(a, b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))
    both = F.when((F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b)), plain).otherwise(counted)
    return both / (F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n_words: int = N_WORDS, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows): document and item pairs with a window of similarity >= threshold."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(item_text).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.size("w")).withColumn("n", F.least("len", F.lit(n_words)))
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # n_words rows at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int, n_windows long")
    hashed = lambda w, size: F.coalesce(*[F.when(size == n, shingle_hashes(w, n)) for n in sizes])
    items = common.table(items.withColumn("h", hashed(F.col("w"), F.col("n"))).drop("w").withColumn("f", simhash(F.col("h"))), "items")
    d = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    # where shared shingles put windows
    grams = items.select("item_id", "len", "n", F.posexplode("h").alias("ipos", "h")).select("len", "n", "ipos", "h").distinct()
    def small(df: DataFrame, *arrays: str) -> DataFrame:
        width = F.lit(64) + sum((8 * F.size(c) for c in arrays), F.lit(0))
        return F.broadcast(df) if df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0] <= BROADCAST_BYTES else df

    grams = common.table(grams, "item-shingles")
    w = d.select("doc_id", words("text").alias("w"))
    spots = [w.select("doc_id", F.size("w").alias("n_words"), F.posexplode(shingle_hashes(F.col("w"), n)).alias("pos", "h")).join(small(grams.where(F.col("n") == n).drop("n")), "h") for n in sizes]
    spot = reduce(DataFrame.unionByName, spots)
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("ipos"), F.col("n_words") - F.col("len")))
    windows = common.table(spot.select("doc_id", "len", start.cast("int").alias("start")).distinct(), "windows")

    # their shingles and fingerprints
    at = windows.groupBy("doc_id").agg(F.collect_set(F.struct("len", "start")).alias("at"))  # within one document
    found = d.join(small(at, "at", "at"), "doc_id").select("doc_id", words("text").alias("w"), "at").select("doc_id", "at", *[shingle_hashes(F.col("w"), n).alias(f"h{n}") for n in sizes])
    found = found.select("doc_id", F.explode("at").alias("at"), *[f"h{n}" for n in sizes]).select("doc_id", "at.len", "at.start", *[f"h{n}" for n in sizes])
    cut = F.coalesce(*[F.when(F.least("len", F.lit(n_words)) == n, F.slice(f"h{n}", F.col("start") + 1, F.col("len") - (n - 1))) for n in sizes])
    found = found.select("doc_id", "len", "start", cut.alias("wh")).where(F.size("wh") > 0).withColumn("wf", simhash(F.col("wh")))
    found = common.table(found.withColumn("window", F.monotonically_increasing_id()), "fingerprints")

    # all pairs of one size within the radius
    count = radius + 1
    left = found.select("window", "len", "wf", F.explode(blocks(F.col("wf"), count)).alias("block"))
    right = items.select("item_id", "len", "f", F.explode(blocks(F.col("f"), count)).alias("block"))
    near = left.join(small(right), ["len", "block"]).where(F.bit_count(F.col("wf").bitwiseXOR(F.col("f"))) <= radius).select("window", "item_id").distinct()
    checked = near.join(found, "window").join(small(items.select("item_id", "h"), "h"), "item_id").withColumn("similarity", similarity(F.col("wh"), F.col("h"))).where(F.col("similarity") >= threshold)
    return checked.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).alias("start_word"), F.countDistinct("start").alias("n_windows"))
