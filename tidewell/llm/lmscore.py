"""Language-model scores by context-tree weighting (CTW).

Bytes are decomposed into bits (a binary tree of 255 nodes, most significant bit first).
At every bit node a context tree over the last 0 to 5 bytes mixes Krichevsky-Trofimov
estimates of all depths: P(node) = (KT + product over children) / 2, KT at the leaves. The
counts come from all training documents and are then frozen; a bit's mixture ends at the
deepest context seen at its node, so each (context, byte) has one code length and a
document's code length is an exact sum.

The counts of six-byte grams grow with the corpus and stay a distributed table. Their part
of the tree below the last three bytes is worked out slice by slice: a slice holds whole
three-byte contexts, so at most LOT grams and one context's (2**24 by its definition). The
part above has 2**24 grams by its definition and is worked out on the driver. Code lengths of
the most frequent grams (at most FREQUENT_GRAMS) are looked up where the text is read, those
of all others, seen or not, come by a join.

The base score is a unigram model with additive smoothing. The counts of all words stay a
distributed table; the most frequent ones (at most FREQUENT) are looked up where the text is
read, the others by a join.

The end of a text is a token of the base score alone: the model codes the bytes and no end symbol.

Null texts are empty: one end token, no bytes, score 0. Repeated rows are scored each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

FREQUENT = 200_000
FREQUENT_GRAMS = 1 << 20
#: Bytes of context in all, and those that hold a slice of the tree together.
DEPTH, TOP = 5, 3
#: Grams that a slice gathers before it is worked out, and distinct keys that a count gathers before it is sent on.
LOT = 1 << 17
#: Bytes of text that one round of array work takes here.
PIECE = 1 << 19
U64 = np.uint64
END = np.uint64(0xE0F0E0F0E0F0E0F1)
WORD, GRAM = 0, 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte a number of its context, the byte before it foremost, and the byte itself; zeros stand before a text."""
    x = data.astype(np.uint64)
    k = x.copy()
    starts = offs[:-1]
    lens = np.diff(offs)
    for d in range(1, DEPTH + 1):
        shift = U64(8 * (DEPTH + 1 - d))
        k[d:] |= x[:-d] << shift
        for j in range(d):
            at = starts[lens > j] + j
            k[at] &= ~(U64(255) << shift)
    return k


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the number of each document's first word."""
    s, e, first = common.words(data, offs)
    return common.word_hashes(data, s, e), first


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, k, n): counts of word hashes (kind 0, the end token among them) and of byte grams (kind 1) over all rows."""

    def merged(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        k = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        order = np.argsort(k)
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.add.reduceat(n[order], first)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind, np.int32)), pa.array(k[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "k", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: tuple[list, list] = ([], [])
            for a, b, data, offs in common.chunks(batch.column(0), PIECE):
                got[WORD].append(np.unique(tokens(data, offs)[0], return_counts=True))
                got[WORD].append((np.array([END]), np.array([b - a])))
                got[GRAM].append(np.unique(grams(data, offs), return_counts=True))
                for kind in (WORD, GRAM):
                    if sum(len(k) for k, _ in got[kind]) >= LOT:
                        yield merged(kind, got[kind])
                        got[kind].clear()
            for kind in (WORD, GRAM):
                if sum(len(k) for k, _ in got[kind]):
                    yield merged(kind, got[kind])

    return docs.select(F.col(text)).mapInArrow(run, "kind int, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- context-tree weighting


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x >= 0.5: shifted Stirling series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift += np.where(small, np.log(np.where(small, y, 1)), 0)
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(zero + 0.5) + _lgamma(one + 0.5) - 2 * math.lgamma(0.5) - _lgamma(zero + one + 1.0)


def _parent(gram: np.ndarray, bits: int) -> np.ndarray:
    """The node, or gram (bits 8), of the context without its farthest byte."""
    return gram >> (bits + 8) << bits | gram & ((1 << bits) - 1)


class Level:
    """The nodes of one depth and bit: sorted numbers (context, bits so far), the estimate of a one, log P, log KT."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, bit: int):
        node = gram >> (8 - bit)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        one = np.add.reduceat(n * (gram >> (7 - bit) & 1), first).astype(float) if len(node) else np.zeros(0)
        both = np.add.reduceat(n, first).astype(float) if len(node) else np.zeros(0)
        self.node = node[first]
        self.bit = bit
        self.kt = (one + 0.5) / (both + 1)
        self.log_kt = self.log_p = _log_kt(both - one, one)
        self.weight = np.ones(len(first))

    def mix(self, below: np.ndarray) -> None:
        """below: the sum of the children's log P."""
        self.log_p = np.logaddexp(self.log_kt, below) - math.log(2)
        self.weight = np.exp(self.log_kt - math.log(2) - self.log_p)

    def sum_of(self, child: Level) -> np.ndarray:
        return np.bincount(np.searchsorted(self.node, _parent(child.node, self.bit)), child.log_p, minlength=len(self.node))

    def find(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.node):
            return np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        i = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return i, self.node[i] == node

    def settle(self, above: Level | None) -> None:
        """What the path down to here has of the mixture (held), what is left (rest), and the mixture if it ends here (stop)."""
        if above is None:
            held, rest = np.zeros(len(self.node)), np.ones(len(self.node))
        else:
            i, _ = above.find(_parent(self.node, self.bit))
            held, rest = above.held[i], above.rest[i]
        self.stop = held + rest * self.kt
        self.held, self.rest = held + rest * self.weight * self.kt, rest * (1 - self.weight)


class ContextTree:
    """The depths lo to hi over sorted grams of depth hi: levels[bit][depth - lo]."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, lo: int, hi: int, below: tuple[np.ndarray, np.ndarray] | None = None):
        """below: (number, sum of log P) of the children of nodes of depth hi, numbered context * 256 + (1 << bit) + bits so far."""
        at = {hi: (gram, n)}
        for d in range(hi - 1, lo - 1, -1):
            k, where = np.unique(_parent(at[d + 1][0], 8), return_inverse=True)
            at[d] = k, np.bincount(where, at[d + 1][1], minlength=len(k)).astype(np.int64)
        self.lo, self.hi = lo, hi
        self.levels: list[list[Level]] = []
        for bit in range(8):
            own = [Level(*at[d], bit) for d in range(lo, hi + 1)]
            if below is not None and len(own[-1].node):
                i = np.searchsorted(below[0], numbered(own[-1].node, bit))
                own[-1].mix(below[1][i])
            for up, down in zip(own[-2::-1], own[:0:-1]):
                up.mix(up.sum_of(down))
            self.levels.append(own)

    def settle(self, top: ContextTree | None = None) -> ContextTree:
        for bit, own in enumerate(self.levels):
            above = top.levels[bit][-1] if top else None
            for level in own:
                level.settle(above)
                above = level
        return self


def numbered(node: np.ndarray, bit: int) -> np.ndarray:
    return (node >> bit) * 256 + (1 << bit) + (node & ((1 << bit) - 1))


def code_lengths(gram: np.ndarray, *trees: ContextTree) -> np.ndarray:
    """Bits of each gram's last byte after its context, under settled trees from the top down."""
    bits = np.zeros(len(gram))
    for bit in range(8):
        p = np.full(len(gram), 0.5)
        live = np.arange(len(gram))
        for tree in trees:
            for d in range(tree.lo, tree.hi + 1):
                g = gram[live]
                cut = (g >> (8 * (DEPTH - d) + 8) << 8 | g & 255) >> (8 - bit)
                i, seen = tree.levels[bit][d - tree.lo].find(cut)
                live = live[seen]
                p[live] = tree.levels[bit][d - tree.lo].stop[i[seen]]
        one = gram >> (7 - bit) & 1
        bits -= np.log2(np.where(one == 1, p, 1 - p))
    return bits


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of sorted rows (k, ...) of about LOT rows that hold whole contexts of TOP bytes."""
    kept: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        size += batch.num_rows
        if size >= LOT:
            cols = tuple(np.concatenate(c) for c in zip(*kept))
            ctx = cols[0] >> (8 * (DEPTH + 1 - TOP))
            cut = int(np.searchsorted(ctx, ctx[-1]))
            if cut:
                yield tuple(c[:cut] for c in cols)
            kept = [tuple(c[cut:] for c in cols)]
            size = len(cols[0]) - cut
    if kept:
        yield tuple(np.concatenate(c) for c in zip(*kept))


def _by_context(df: DataFrame) -> DataFrame:
    return df.repartition(F.shiftright("k", 8 * (DEPTH + 1 - TOP))).sortWithinPartitions("k")


def top_tree(counts: DataFrame) -> ContextTree:
    """The settled depths below TOP, from the (k, n) of all grams."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _slices(batches):
            for bit, own in enumerate(ContextTree(k, n, TOP, DEPTH).levels):
                up, where = np.unique(numbered(_parent(own[0].node, bit), bit), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(up), pa.array(np.bincount(where, own[0].log_p))], names=["node", "s"])

    below = _by_context(counts).mapInArrow(sums, "node long, s double").groupBy("node").agg(F.sum("s").alias("s")).toArrow().sort_by("node")
    cut = F.shiftright("k", 8 * (DEPTH + 2 - TOP)) * 256 + F.col("k").bitwiseAND(F.lit(255))
    up = counts.groupBy(cut.alias("k")).agg(F.sum("n").alias("n")).toArrow().sort_by("k")  # 2**24 rows at most, as is below
    tree = ContextTree(up["k"].to_numpy(), up["n"].to_numpy(), 0, TOP - 1, (below["node"].to_numpy(), below["s"].to_numpy()))
    return tree.settle()


def gram_costs(counts: DataFrame, asked: DataFrame, top) -> DataFrame:
    """(k, bits) of the asked k: rows with n of 0 beside the counted ones, sorted into the same slices. top: a broadcast top tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _slices(batches):
            own = ContextTree(k[n > 0], n[n > 0], TOP, DEPTH).settle(top.value)
            wanted = k[n == 0]
            yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(code_lengths(wanted, top.value, own))], names=["k", "bits"])

    return _by_context(counts.select("k", "n").union(asked.select("k", F.lit(0).cast("long")))).mapInArrow(run, "k long, bits double")


class Lookup:
    """Values of keys. Most keys have a slot of their own by a few bits of a product; the others are searched.

    Only keys and values travel; the slots are laid out where the first key is looked up.
    """

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.given = key, value.astype(float)
        self.shift = U64(64 - max(4, int(len(key)).bit_length() + 1))
        self.key = None

    def __reduce__(self):
        return Lookup, self.given

    def _lay(self) -> None:
        key, value = self.given
        slot = self._slot(key)
        size = 1 << (64 - int(self.shift))
        self.key = np.full(size, ~U64(0))
        self.value = np.zeros(size)
        self.key[slot], self.value[slot] = key, value
        lost = self.key[slot] != key
        order = np.argsort(key[lost])
        self.more, self.more_value = key[lost][order], value[lost][order]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * U64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found)"""
        if self.key is None:
            self._lay()
        slot = self._slot(key)
        value, found = self.value[slot], self.key[slot] == key
        if len(self.more):
            at = np.flatnonzero(~found)
            i = np.minimum(np.searchsorted(self.more, key[at]), len(self.more) - 1)
            hit = self.more[i] == key[at]
            value[at[hit]], found[at[hit]] = self.more_value[i[hit]], True
        return value, found


def _least(counts: DataFrame, most: int) -> int | None:
    """The least step of the counts' log scale so that at most `most` rows reach it, from a histogram; None if none does."""
    least = None
    for r in counts.groupBy(_step().alias("s")).agg(F.count("*").alias("c")).orderBy(F.desc("s")).collect():
        most -= r["c"]
        if most < 0:
            break
        least = r["s"]
    return least


def _step() -> Column:
    return F.floor(F.log2("n") * 16).cast("int")


# ---------------------------------------------------------------- scores


def score_documents(docs: DataFrame, train: Column | None = None, text: str = "text", frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """Learn from the rows where train holds (default: not held out), score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    """
    spark = docs.sparkSession
    train = ~held_out() if train is None else train
    counts = common.table(corpus_counts(docs.where(train), text), "counts")
    words = counts.where(F.col("kind") == WORD).select("k", "n")
    gram = counts.where(F.col("kind") == GRAM).select("k", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = float(total) + 0.1 * (kinds + 1)
    above = lambda df, most: df.where(_step() >= F.lit(x)) if (x := _least(df, most)) is not None else df.limit(0)
    top_words = above(words, frequent).toArrow()
    word_table = _pairs(top_words["k"], np.log10((top_words["n"].to_numpy() + 0.1) / norm))
    top = spark.sparkContext.broadcast(top_tree(gram))
    often = gram_costs(gram, above(gram, frequent_grams), top).toArrow()
    gram_table = Lookup(often["k"].to_numpy().view(np.uint64), often["bits"].to_numpy())
    shared = spark.sparkContext.broadcast((word_table, gram_table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, logs), known_grams = shared.value
        for batch in batches:
            for a, b, data, offs in common.chunks(batch.column(2), PIECE):
                m = b - a
                wh, first = tokens(data, offs)
                n = np.diff(first)
                allw = np.concatenate([wh, np.full(m, END)])
                doc = np.concatenate([np.repeat(np.arange(m), n), np.arange(m)])
                i = np.minimum(np.searchsorted(keys, allw), max(len(keys) - 1, 0))
                seen = keys[i] == allw if len(keys) else np.zeros(len(allw), bool)
                part = np.bincount(doc[seen], logs[i[seen]], minlength=m) if len(keys) else np.zeros(m)
                g = grams(data, offs)
                cost, found = known_grams.get(g)
                owner = np.repeat(np.arange(m), np.diff(offs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), batch.column(1).slice(a, m), pa.array(n + 1), pa.array(np.bincount(doc[seen], minlength=m)), pa.array(part.astype(float)), _lists(doc[~seen], allw[~seen], m),
                     pa.array(np.bincount(owner[found], cost[found], minlength=m).astype(float)), _lists(owner[~found], g[~found], m), pa.array(np.diff(offs))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "rare_words", "bits", "rare_grams", "n_bytes"],
                )

    first = docs.select("doc_id", (~train).alias("held_out"), F.col(text)).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare_words array<long>, bits double, rare_grams array<long>, n_bytes long")
    part = common.table(first.withColumn("row", F.monotonically_increasing_id()), "scored")  # written, so the row numbers stay
    asked = part.select(F.explode("rare_grams").alias("k")).distinct()
    prices = words.select(F.lit(WORD).alias("kind"), "k", F.log10((F.col("n") + F.lit(0.1)) / F.lit(norm)).alias("v")).union(gram_costs(gram, asked, top).select(F.lit(GRAM), "k", "bits"))
    each = lambda kind, c: part.select("row", F.lit(kind).alias("kind"), F.explode(c).alias("k"))
    rare = each(WORD, "rare_words").union(each(GRAM, "rare_grams")).join(prices, ["kind", "k"], "left")
    is_word, unseen = F.col("kind") == WORD, math.log10(0.1 / norm)
    rare = rare.groupBy("row").agg(F.sum(F.when(is_word, F.coalesce("v", F.lit(unseen)))).alias("more"), F.count_if(is_word & F.col("v").isNotNull()).alias("more_known"), F.sum(F.when(~is_word, F.col("v"))).alias("more_bits"))
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return part.drop("rare_words", "rare_grams").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (-bits * math.log10(2)).alias("score"),
        F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _pairs(k, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = k.to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], v[order]


def _lists(owner: np.ndarray, key: np.ndarray, m: int) -> pa.ListArray:
    """The keys of each of m rows."""
    order = np.argsort(owner, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(key[order].view(np.int64)))
