"""Near-duplicate groups by b-bit MinHash.

Each document's set of word shingles gets 128 minima. Bands of four minima give candidates;
of every minimum only the two low bits are kept, packed into four 64-bit words, and a
candidate's similarity is estimated from the count of agreeing positions, corrected for the
quarter of them that agree by chance. What the estimate doesn't rule out (six standard
errors) is confirmed on the full shingle sets. 32 bands of four miss a link of similarity
0.8 with probability 5e-8, one of 0.85 with 6e-11.

Work per bucket is linear first: equal sets are one class, each class is compared with the
least class of its buckets, and components are formed. Only classes of a bucket that lie in
different components afterwards are compared with each other, in blocks; a block reports a
link only if it joins components, so a large group never gives all its pairs. No link
between different texts that could join groups is lost.

Documents without words have an empty set and no links. Null text counts as empty. Rows that
repeat a doc_id are one document. Rows with a null doc_id are linked with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.common import U64
from tidewell.llm.components import components

HASHES, BANDS = 128, 32
MARGIN = 0.25
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
_rng = np.random.default_rng(41)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_BAND = _rng.integers(0, 1 << 63, (HASHES // BANDS, BANDS), dtype=np.uint64) * U64(2) + U64(1)


def minima(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """HASHES minima of each non-empty set."""
    out = np.empty((len(offs) - 1, HASHES), U64)
    buf = np.empty_like(values)
    for k in range(HASHES):
        np.bitwise_xor(values, _XOR[k], out=buf)
        np.multiply(buf, _MUL[k], out=buf)
        out[:, k] = np.minimum.reduceat(buf, offs[:-1])
    return out


def signature(m: np.ndarray) -> np.ndarray:
    """The two low bits of each (mixed) minimum as four 64-bit words: two of low bits, two of high bits."""
    low = common.mix(m)
    planes = [np.packbits(((low >> U64(j)) & U64(1)).astype(np.uint8), axis=1).view(">u8").astype(U64) for j in (0, 1)]
    return np.concatenate(planes, axis=1)


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(len(m), BANDS, HASHES // BANDS)
    key = np.arange(1, BANDS + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
    key = np.repeat(key, len(m), 0)
    for j in range(HASHES // BANDS):
        key += rows[:, :, j] * _BAND[j]
    return common.mix(key)


def _long_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)))


def sketches(docs: DataFrame, n_words: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, f1, f2 (128 bits that name the set), sig, bands. Empty sets have null sig and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in common.chunks(batch.column(1)):
                s, e, first = common.words(data, offs)
                sh, so = common.shingles(common.word_hashes(data, s, e), first, n_words)
                n = np.diff(so)
                some = np.flatnonzero(n)
                ids = batch.column(0).slice(a, b - a)
                sig, bands = np.zeros((0, 4), U64), np.zeros((0, BANDS), U64)
                f = np.zeros((2, b - a), U64)
                if len(some):
                    cut = np.append(so[:-1][some], so[-1])
                    m = minima(sh, cut)
                    sig, bands = signature(m), band_keys(m)
                    f[0, some] = np.add.reduceat(common.mix(sh ^ U64(0xA5A5)), cut[:-1])
                    f[1, some] = np.add.reduceat(common.mix(sh + U64(0x1234567)), cut[:-1]) ^ n[some].astype(U64)
                where = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, -1))
                where = pa.compute.if_else(pa.compute.less(where, 0), None, where)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), _long_lists(sig).take(where), _long_lists(bands).take(where)], names=["doc_id", "n_shingles", "f1", "f2", "sig", "bands"])

    return docs.select("doc_id", F.col(text)).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>")


def shingle_sets(docs: DataFrame, n_words: int, text: str = "text") -> DataFrame:
    """(id, set): the full set of shingle hashes of each row of (id, text), ascending as unsigned numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in common.chunks(batch.column(1)):
                s, e, first = common.words(data, offs)
                sh, so = common.shingles(common.word_hashes(data, s, e), first, n_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(sh.view(np.int64)))], names=["id", "set"])

    return docs.select("id", F.col(text)).mapInArrow(run, "id long, set array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: positions that agree, less those that agree by chance."""
    x = lambda i: a[i].bitwiseXOR(b[i])
    differ = F.bit_count(x(0).bitwiseOR(x(2))) + F.bit_count(x(1).bitwiseOR(x(3)))
    return (1 - differ / float(HASHES) - 0.25) / 0.75


def near_duplicates(docs: DataFrame, n_words: int = 5, threshold: tuple[int, int] = (4, 5), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. Linked: intersection / union >= threshold, a fraction."""
    num, den = threshold
    least = num / den
    all_docs = common.table(sketches(docs, n_words, text), "sketches")
    sets_of = ["f1", "f2", "n_shingles"]
    # one class for equal sets, named by its least doc_id
    classes = all_docs.where("n_shingles > 0 and doc_id is not null").groupBy(*sets_of).agg(F.min("doc_id").alias("id"))
    classes = common.table(classes, "classes")
    one = classes.withColumnRenamed("id", "doc_id").join(all_docs.select("doc_id", *sets_of, "sig", "bands"), [*sets_of, "doc_id"]).dropDuplicates(["f1", "f2"])
    one = common.table(one.select(F.col("doc_id").alias("id"), "n_shingles", "sig", "bands"), "class-sketches")

    # buckets that hold more than one class
    flat = one.select("id", F.explode("bands").alias("key"))
    # written, so that both sides of the join are dealt anew and a hot bucket can be split
    shared = common.table(flat.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = common.table(flat.join(shared, "key"), "members")
    spread = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), F.col(text).alias("text"))
    sets = shingle_sets(texts.join(spread, "id", "left_semi"), n_words)
    sets = common.table(sets.join(one.select("id", "sig"), "id"), "sets")

    # first every class against the least one of its buckets
    left = sets.select("id", F.col("sig").alias("sa"), F.col("set").alias("a"))
    right = sets.select(F.col("id").alias("rep"), F.col("sig").alias("sb"), F.col("set").alias("b"))
    pairs = members.where("id <> rep").select("id", "rep").distinct()
    sketch = sets.select("id", "sig")
    likely = pairs.join(sketch.withColumnRenamed("sig", "sa"), "id").join(sketch.select(F.col("id").alias("rep"), F.col("sig").alias("sb")), "rep").where(estimate(F.col("sa"), F.col("sb")) >= least - MARGIN).select("id", "rep")
    common_n = F.size(F.array_intersect("a", "b"))
    links = likely.join(left.drop("sa"), "id").join(right.drop("sb"), "rep").withColumn("c", common_n)
    links = links.where(F.col("c") * den >= (F.size("a") + F.size("b") - F.col("c")) * num).select("id", "rep")
    # classes that bear one doc_id (its rows differ) are one document: nothing to add, their id is the same
    links = common.table(links, "links")
    comp = components(links, "id", "rep")

    # then, in buckets whose other members lie in several components, those against each other
    others = members.where("id <> rep and n > 2").select("key", "id").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rest = others.join(mixed, "key").withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "id", "component")
    rest = rest.join(sets, "id").select("key", "i", "j", "id", "component", "sig", "set")
    more = rest.groupBy("key", "i", "j").applyInPandas(lambda pdf: block_links(pdf, num, den), "id long, rep long")
    more = common.table(more.distinct(), "links")
    comp = common.table(components(links.union(more), "id", "rep"), "components")

    named = classes.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select(*sets_of, F.coalesce("component", "id").alias("component"))
    out = all_docs.select("doc_id", *sets_of).join(named, sets_of, "left")
    repeated = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", repeated).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def block_links(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between members of different components, as many as join them: the largest component needs no look inside."""
    if len(pdf) < 2:
        return pd.DataFrame({"id": [], "rep": []}, dtype="int64")
    pdf = pdf.drop_duplicates("id").reset_index(drop=True)
    ids, comp = pdf["id"].to_numpy(), pdf["component"].to_numpy()
    names, group, size = np.unique(comp, return_inverse=True, return_counts=True)
    sig = np.stack(pdf["sig"].to_numpy()).astype(np.int64).view(U64)
    sets = [np.asarray(x).view(U64) for x in pdf["set"]]
    n = np.array([len(x) for x in sets])
    flat, cut = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in np.flatnonzero(group != size.argmax()).tolist():
        d = sig ^ sig[x]
        differ = np.bitwise_count(d[:, 0] | d[:, 2]) + np.bitwise_count(d[:, 1] | d[:, 3])
        est = (1 - differ / HASHES - 0.25) / 0.75
        roots = np.array([find(g) for g in range(len(names))])
        ok = np.flatnonzero((roots[group] != roots[group[x]]) & (est >= num / den - MARGIN) & (np.minimum(n, n[x]) * den >= np.maximum(n, n[x]) * num))
        if not len(ok):
            continue
        if len(ok) > 64:
            hit = np.searchsorted(sets[x], flat)
            inside = sets[x][np.minimum(hit, n[x] - 1)] == flat
            both = np.diff(np.concatenate([[0], np.cumsum(inside)])[cut])[ok]
        else:
            both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in ok.tolist()])
        for y in ok[both * den >= (n[ok] + n[x] - both) * num].tolist():
            p, q = find(group[x]), find(group[y])
            if p != q:
                parent[q] = p
                out.append((ids[x], ids[y]))
    return pd.DataFrame(out, columns=["id", "rep"], dtype="int64")
