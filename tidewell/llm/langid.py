"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of depth `order` is counted on training text.
A symbol is coded in the longest context seen; escape probabilities (method C: distinct
symbols over total plus distinct) lead to shorter ones and at last to 1/256. The
statistics are frozen, so the code length of a text is an exact sum over its bytes.
The language with the shortest code wins; ties go to the smaller name.

Tables: code lengths by the last four bytes go through the sparse tree when such bytes are
first met, and are kept for pairs of byte pairs seen in training as far as there is room.

Null texts and texts without a letter (Unicode L; signs for numbers such as ² or ½ are none) are `und` with score 0. Repeated rows are judged each for itself.
Without training rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

ORDER = 3
#: Documents of each language (expected number, chosen by hash) that the classifier is fitted on.
SAMPLE_PER_LANG = 1500
#: Bytes that code lengths of all pairs of byte pairs would take at most (byte pairs squared, times languages), and byte pairs at most.
TABLE_BYTES, MAX_PAIRS = 150_000_000, 3000
#: Bytes of code lengths that a Python worker keeps; what has no room is worked out anew.
KEPT_BYTES = 32 << 20
#: Code lengths (bytes of text times languages) that are held at once.
SLICE = 1 << 20
#: Languages that one classifier tells apart; more in the training rows are an error, not a cut.
MAX_LANGS = 1000


def count_grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (order + 1)-byte windows and their counts; zero bytes stand before each text."""
    pad = ORDER
    lens = np.diff(offs)
    n = int(lens.sum())
    x = np.zeros(n + pad * len(lens), np.uint32)
    at = np.arange(n) + pad * (np.repeat(np.arange(len(lens)), lens) + 1)
    x[at] = data
    key = x[at - 3] << np.uint32(24) | x[at - 2] << np.uint32(16) | x[at - 1] << np.uint32(8) | x[at]
    return np.unique(key, return_counts=True)


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> "Model":
    """Fit on a sample of labelled rows (lang and text not null): all rows of a language up to
    sample_per_lang, beyond that each with a probability that makes sample_per_lang expected."""
    rows = docs.where("lang is not null and text is not null")
    share = {r["lang"]: min(1.0, sample_per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if not share:
        return Model([], {})
    if len(share) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages in the training rows")
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    picked = rows.where(unit < limit[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                some = batch.column(1).filter(pa.array([x == lang for x in langs]))
                for _, _, data, offs in common.chunks(some):
                    k, c = count_grams(data, offs)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "k", "n"])

    grams = picked.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    return Model(sorted(share), {lang: (g["k"].to_numpy(np.uint32), g["n"].to_numpy(np.int64)) for lang, g in grams.groupby("lang")})


class Model:
    """Frozen counts of each language, by context length."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.levels = [_levels(*grams[x]) if x in grams else None for x in langs]
        self.dense = None
        self.pair = None
        if langs:
            self._tabulate(grams)

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte window, for each language: the sparse way."""
        out = np.empty((len(key), len(self.langs)), np.float32)
        for j, levels in enumerate(self.levels):
            out[:, j] = _bits(levels, key)
        return out

    def _tabulate(self, grams) -> None:
        total: dict[int, int] = {}
        for k, n in grams.values():
            p, c = np.unique(np.concatenate([k >> np.uint32(16), k & np.uint32(0xFFFF)]), return_counts=True)
            for a, b in zip(p.tolist(), c.tolist()):
                total[a] = total.get(a, 0) + b
        most = min(MAX_PAIRS, int((TABLE_BYTES / (4 * len(self.langs))) ** 0.5) - 1)
        pairs = np.array(sorted(sorted(total, key=lambda p: (-total[p], p))[:most]), np.uint32)
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.pairs = pairs

    def table(self) -> np.ndarray:
        """Code lengths by language of the windows met so far, from row 1 on; each Python worker has its own. self.row: by two pairs, 0 if not there."""
        if self.dense is None:
            n = len(self.pairs) + 1
            self.row = np.zeros(n * n, np.int32)
            self.dense = np.zeros((max(1, min(n * n, KEPT_BYTES // (4 * len(self.langs)))), len(self.langs)), np.float32)
            self.used = 1
        return self.dense

    def _met(self, cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code lengths of windows of pairs a and b that the table hasn't; as many as there is room for are kept under their cells."""
        key, at, back = np.unique(a.astype(np.uint32) << np.uint32(16) | b, return_index=True, return_inverse=True)
        bits = self.bits(key)
        known = np.flatnonzero((self.pair[a[at]] > 0) & (self.pair[b[at]] > 0))[: len(self.dense) - self.used]
        self.dense[self.used : self.used + len(known)] = bits[known]
        self.row[cell[at[known]]] = np.arange(self.used, self.used + len(known))
        self.used += len(known)
        return bits[back]

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        lens = np.diff(offs)
        out = np.zeros((len(lens), len(self.langs)))
        if not len(data):
            return out
        x = np.zeros(len(data) + 3, np.uint16)
        x[3:] = data
        x2 = np.zeros(len(data) + 2, np.uint16)  # pair that ends at each byte
        x2[:] = x[:-1] << np.uint16(8) | x[1:]
        left, right = x2[:-2].copy(), x2[2:].copy()
        for j in (0, 1, 2):  # what stood in another document is zero
            at = offs[:-1][lens > j] + j
            if j == 0:
                left[at] = 0
                right[at] &= np.uint16(0xFF)
            elif j == 1:
                left[at] = 0
            else:
                left[at] &= np.uint16(0xFF)
        table, n = self.table(), len(self.pairs) + 1
        step = max(1, SLICE // len(self.langs))
        for lo in range(0, len(data), step):
            a, b = left[lo : lo + step], right[lo : lo + step]
            cell = self.pair[a] * np.int64(n) + self.pair[b]
            row = self.row[cell]
            cost = table.take(row, axis=0)
            slow = np.flatnonzero(row == 0)
            if len(slow):
                cost[slow] = self._met(cell[slow], a[slow], b[slow])
            first = np.searchsorted(offs, lo, "right") - 1  # the document of the slice's first byte
            last = np.searchsorted(offs, lo + len(a), "left")
            some = first + np.flatnonzero(lens[first:last] > 0)
            out[some] += np.add.reduceat(cost.astype(np.float64), np.maximum(offs[some] - lo, 0), axis=0)
        return out


def _levels(key: np.ndarray, n: np.ndarray) -> list[tuple]:
    """By context length 0 to ORDER: sorted windows, their counts, sorted contexts, their totals and distinct symbols."""
    out = []
    for d in range(ORDER + 1):
        w, at = np.unique(key & np.uint32((1 << 8 * (d + 1)) - 1), return_inverse=True)
        c = np.bincount(at, n).astype(np.int64)
        ctx, at = np.unique(w >> np.uint32(8), return_inverse=True)
        out.append((w, c, ctx, np.bincount(at, c).astype(np.int64), np.bincount(at)))
    return out


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return i, keys[i] == x


def _bits(levels: list[tuple] | None, key: np.ndarray) -> np.ndarray:
    out = np.full(len(key), 8.0)
    if levels is None or not len(key):
        return out
    out[:] = 0
    todo = np.arange(len(key))
    for d in range(ORDER, -1, -1):
        w, c, ctx, total, kinds = levels[d]
        k = key[todo] & np.uint32((1 << 8 * (d + 1)) - 1)
        i, seen = _find(w, k)
        j, known = _find(ctx, k >> np.uint32(8))
        base = np.log2(np.where(known, total[j] + kinds[j], 1))
        out[todo] += base - np.where(seen, np.log2(c[i]), np.where(known, np.log2(kinds[j]), 0))
        todo = todo[~seen]
    out[todo] += 8.0
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior under equal priors. Columns of those names are replaced."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (lang, score)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the sample bounds the tree, TABLE_BYTES the table
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{lang}` string", f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            names, scores = [], []
            for a, b, data, offs in common.chunks(col):
                bits = m.code_lengths(data, offs) if m.langs else None
                for d, t in enumerate(col.slice(a, b - a).to_pylist()):
                    if bits is None or t is None or not any(map(str.isalpha, t)):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    k = int(bits[d].argmin())
                    names.append(m.langs[k])
                    scores.append(float(1 / np.exp2(np.maximum(bits[d, k] - bits[d], -1000)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang, score])

    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Learn from rows that aren't held out, predict all: the columns of docs, held_out, lang_pred, score."""
    model = train(docs.where(~held_out()), sample_per_lang)
    return predict(docs.withColumn("held_out", held_out()), model)
