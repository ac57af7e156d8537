"""What the training-data operators share: tables in the shared folder, byte-level text kernels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.functions.tables import discard, shared_folder, sweep, table  # noqa: F401

U64 = np.uint64
#: Bytes of text that one round of array work takes; a longer document makes a round of its own.
CHUNK = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- texts as arrays


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about limit bytes. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(o, o[a] + limit, "right")) - 1)
        yield a, b, buf[o[a] : o[b]], o[a : b + 1] - o[a]
        a = b


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = U64(0x9E3779B97F4A7C55)
_P_INV = U64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(p: np.uint64) -> np.ndarray:
        x = np.full(n, p, U64)
        x[:1] = 1
        return np.multiply.accumulate(x)

    return of(_P), of(_P_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number and of its inverse, modulo 2**64."""
    p, q = _powers(1 << max(22, int(n + 1).bit_length()))
    return p[: n + 1], q[: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with (h[j] - h[i]) * inverse power i = polynomial hash of data[i:j]."""
    p, _ = powers(len(data))
    h = np.zeros(len(data) + 1, U64)
    x = data.astype(U64)
    x += U64(1)
    x *= p[: len(data)]
    np.cumsum(x, out=h[1:])
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each document, the number of its first word."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    h = prefix_hash(LOWER[data] if lower else data)
    _, q = powers(len(data))
    return mix((h[e] - h[s]) * q[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(wh: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct k-word shingles, sorted, and their offsets.

    With fewer than k words the whole sequence is the one shingle; without words there is none.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.zeros(n.sum(), U64)
    o = np.concatenate([[0], np.cumsum(n)])
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 1 << 63, size=k, dtype=np.uint64) * U64(2) + U64(1)
    full = count >= k
    if full.any():
        m = len(wh) - k + 1
        x = wh[:m] * mult[0]
        for j in range(1, k):
            x += wh[j : j + m] * mult[j]
        keep = np.zeros(m, bool)
        ok = np.ones(len(wh), bool)
        tails = first[1:][count > 0]
        for j in range(1, k):  # the last k - 1 words of a document start no shingle
            at = tails - j
            ok[at[at >= 0]] = False
        keep = ok[:m]
        short = np.flatnonzero((count > 0) & ~full)
        for d in short:
            keep[first[d] : min(first[d + 1], m)] = False
        dest = np.zeros(len(out), bool)
        dest[np.concatenate([o[short], np.zeros(0, np.int64)])] = True
        out[~dest] = x[keep]
    for d in np.flatnonzero((count > 0) & ~full):
        c = count[d]
        with np.errstate(over="ignore"):
            out[o[d]] = (wh[first[d] : first[d + 1]] * mult[:c]).sum(dtype=U64) + U64(c)
    out = mix(out)
    for a, b in zip(o[:-1].tolist(), o[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[o[:-1][n > 0]] = True
    c = np.concatenate([[0], np.cumsum(new)])
    return out[new], c[o]
