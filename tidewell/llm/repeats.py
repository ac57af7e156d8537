"""Exact removal of repeated byte strings with a run-length (r-index style) suffix index.

A string of min_bytes bytes that starts at two places of the corpus is removed wherever it
stands; matches never cross documents. Strings are judged on the input. Beside it, passages of
min_words words (the words, whatever stands between them) that stand in two different documents
are reported, as they may be shorter than min_bytes. Both go the same way, as strings of symbols:
bytes, or 64-bit hashes of words. The lowest bit of a key says which.

1. Every window (min_bytes bytes or min_words words) picks an anchor: of the strings of a third of its
   length in it the one with the least hash, the first on ties. Equal windows pick equal anchors at
   the same place, so only anchors that occur at two places matter, and windows are compared within an
   anchor's group. Only hashes travel to find them; texts that hold such an anchor are read once more.
2. The windows that picked one occurrence of an anchor form a segment of text. Equal segments
   are counted with a grouped sum; all their windows repeat, and one of them goes on.
3. Groups of different segments are gathered into blocks. Each block's text gets a run-length
   Burrows-Wheeler transform. At the ends of its runs the suffix position and the matching
   length with the neighbouring suffix are sampled (r samples each way); the matching statistics
   of all other positions follow from the samples, as they fall by one from a position to the
   next within a run. Windows whose matching length with any other suffix reaches min_bytes repeat.
   Words: windows that lie together in the suffix order are one class, which must have two documents.
4. A group too large for a block is split: windows in the left and the right half of the
   anchor's range are keyed by the longer text that all windows of the half share. A split
   sends a segment on at most twice, halves the range, and ends at single windows, whose equal
   segments step 2 counts. So no group, however large, meets in one task.

Equal texts are one text with a count: with a count over one and min_bytes bytes they are
removed whole, with min_words words they are one passage. Null counts as empty. Repeated rows
are documents of their own, rows with a null doc_id as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.common import U64

#: Bytes of one block's index, and segments of a group beyond which it is split.
BLOCK_BYTES, GROUP = 1 << 20, 4096
#: Segments (about a hundred bytes each) up to which they are sent to the texts; more are dealt by text with them.
SENT = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
BYTES, WORDS = 0, 1


@dataclass(frozen=True)
class Windows:
    """Lengths of windows in symbols, by kind (bytes, words), the anchors' lengths and the symbols' widths in bytes."""

    length: tuple[int, int]

    @property
    def k(self) -> tuple[int, int]:
        return max(1, self.length[0] // 3), max(1, self.length[1] // 3)

    width = (1, 8)


# ---------------------------------------------------------------- anchors

_LOW = 24
_PLACE = U64((1 << _LOW) - 1)


def _places(x: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of k symbols, and for each window of length symbols the place of its anchor."""
    n, span = len(x), length - k + 1
    h = common.prefix_hash(x)
    _, q = common.powers(n)
    h = common.mix((h[k:] - h[:-k]) * q[: n - k + 1])
    if n <= _PLACE:  # the upper bits of the hash, then the place: a sliding minimum by doubling
        best = (h & ~_PLACE) | np.arange(len(h), dtype=U64)
        width = 1
        while width * 2 <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = (np.minimum(best[: n - length + 1], best[span - width : span - width + n - length + 1]) & _PLACE).astype(np.int64)
    else:  # the same order, by places alone
        upper, best, width = h >> U64(_LOW), np.arange(len(h)), 1
        first = lambda a, b: np.where(upper[a] <= upper[b], a, b)
        while width * 2 <= span:
            best = first(best[: len(best) - width], best[width:])
            width *= 2
        best = first(best[: n - length + 1], best[span - width : span - width + n - length + 1])
    return h, best


def anchors(x: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of each anchor of one string of at least length symbols."""
    h, best = _places(x, length, k)
    cut = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    pos = best[cut]
    return h[pos], pos, cut, np.append(cut[1:], len(best)) - 1


def all_anchors(x: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, number of the string) of each anchor of the strings of x that offs tells apart, in their order."""
    lens = np.diff(offs)
    start = offs[:-1][lens >= length]
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, best = _places(x, length, k)
    step = np.zeros(len(x) + 1, np.int8)
    step[start] += 1
    step[start + lens[lens >= length] - length + 1] -= 1
    new = np.append(True, best[1:] != best[:-1])
    new[start] = True
    cut = np.flatnonzero(new & (np.cumsum(step, dtype=np.int8)[: len(best)] > 0))  # no window lies in two strings
    of = np.searchsorted(offs, cut, "right") - 1
    pos = best[cut]
    return h[pos], pos - offs[of], of


INDEX = "doc_id long, n_bytes long, n_words long, word_from int, word_to int, sha string, tid binary, h array<long>, at array<long>"


def text_anchors(data: np.ndarray, words: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of one text of both kinds; the lowest bit of the hash is the kind."""
    got = []
    for kind, x in ((BYTES, data), (WORDS, words)):
        if len(x) >= windows.length[kind] > 0:
            h, *rest = anchors(x, windows.length[kind], windows.k[kind])
            got.append(((h & ~U64(1)) | U64(kind), *rest))
    return tuple(map(np.concatenate, zip(*got))) if got else (np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)


def index_texts(docs: DataFrame, windows: Windows, text: str) -> DataFrame:
    """doc_id, sizes, where the words lie, sha (of the text), tid (128 bits of it), hashes of the anchors and of the places (text and position) they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in common.chunks(batch.column(1)):
                ws, we, first = common.words(data, offs)
                wh = common.word_hashes(data, ws, we, lower=False)
                sha = [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
                n = np.diff(first)
                lo, hi = np.zeros((2, b - a), np.int64)
                some = n > 0
                lo[some] = ws[first[:-1][some]] - offs[:-1][some]
                hi[some] = we[first[1:][some] - 1] - offs[:-1][some]
                got = [all_anchors(x, o, windows.length[kind], windows.k[kind]) for kind, x, o in ((BYTES, data, offs), (WORDS, wh, first)) if windows.length[kind] > 0]
                h, pos, of = map(np.concatenate, zip(*(((h & ~U64(1)) | U64(kind), pos, of) for kind, (h, pos, of) in enumerate(got))))
                order = np.argsort(of, kind="stable")
                h, pos, of = h[order], pos[order], of[order]
                at = common.mix(np.array([int(x[:16], 16) for x in sha], U64)[of] + pos.astype(U64))
                cut = pa.array(np.searchsorted(of, np.arange(b - a + 1)), pa.int32())
                nest = lambda v: pa.ListArray.from_arrays(cut, pa.array(v.view(np.int64)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offs)), pa.array(n), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(sha), pa.array([bytes.fromhex(x[:32]) for x in sha], pa.binary()), nest(h), nest(at)],
                    names=["doc_id", "n_bytes", "n_words", "word_from", "word_to", "sha", "tid", "h", "at"],
                )

    return docs.select("doc_id", F.col(text)).mapInArrow(run, INDEX)


# ---------------------------------------------------------------- the run-length index of a block


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order: by as many symbols as 63 bits hold, then by as many ranks; only ties are sorted again."""
    n = len(t)
    if t.dtype == np.uint8:  # symbols numbered among those there are, so more of them fit
        t = np.cumsum(np.bincount(t, minlength=256) > 0)[t] - 1
    bits = int(t.max() + 1).bit_length() if n else 1
    each = 63 // bits
    x = np.zeros(n + each, U64)
    x[:n] = t.astype(U64) + U64(1)
    key = np.zeros(n, U64)
    for j in range(each):
        key = key << U64(bits) | x[j : j + n]
    sa = np.argsort(key)
    at, key = np.arange(n), key[sa]
    rank = np.zeros(n + 1, np.int64)  # from 1, the first place of a group; 0 behind the end
    width = n.bit_length()
    times, step = min(4, 63 // width) if n else 1, each
    while len(at):
        pos = sa[at]
        new = np.append(True, key[1:] != key[:-1])
        rank[pos] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        tied = ~(new & np.append(new[1:], True))
        at, pos = at[tied], pos[tied]
        key = rank[pos]
        for j in range(1, times):
            key = key << width | rank[np.minimum(pos + j * step, n)]
        order = np.argsort(key)
        sa[at], key = pos[order], key[order]
        step *= times
    return sa


def matching(t: np.ndarray, least: int = 1) -> np.ndarray:
    """For each position the length of its longest match with another position, from samples at run ends of the transform only.

    Lengths below least may come out as less: a sample below it counts as 0.
    """
    n = len(t)
    sa = suffix_array(t)
    bwt = t[sa - 1].astype(np.int16)
    bwt[sa == 0] = -1
    change = bwt[1:] != bwt[:-1]
    out = np.zeros(n, np.int64)
    for heads in (True, False):
        # heads: first of a run against the suffix before it; tails: last of a run against the one after it
        edge = np.flatnonzero(np.append(True, change)) if heads else np.flatnonzero(np.append(change, True))
        ok = edge > 0 if heads else edge < n - 1
        at = sa[edge]
        length = np.zeros(len(edge), np.int64)
        length[ok] = _lcp(t, at[ok], sa[edge[ok] + (-1 if heads else 1)], least)
        order = np.argsort(at)
        at, length = at[order], length[order]
        first = np.repeat(np.arange(len(at)), np.diff(np.append(at, n)))
        from_sample = np.arange(at[0], n)
        out[at[0] :] = np.maximum(out[at[0] :], length[first] - (from_sample - at[first]))
    return out


def _lcp(t: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Common prefix lengths of suffixes a and b, 0 if below least: one look at that length, then halving steps over prefix hashes."""
    n = len(t)
    h = common.prefix_hash(t)
    _, q = common.powers(n)
    out = np.zeros(len(a), np.int64)
    fit = np.flatnonzero(np.maximum(a, b) + least <= n)
    far = fit[(h[a[fit] + least] - h[a[fit]]) * q[a[fit]] == (h[b[fit] + least] - h[b[fit]]) * q[b[fit]]]
    a, b = a[far], b[far]
    room = np.minimum(n - a, n - b)
    low = np.zeros(len(a), np.int64)
    step = 1 << n.bit_length()
    while step:
        m = low + step
        can = m <= room
        m = np.where(can, m, 0)
        same = can & ((h[a + m] - h[a]) * q[a] == (h[b + m] - h[b]) * q[b])
        low = np.where(same, m, low)
        step >>= 1
    out[far] = low
    return out


def block_repeats(t: np.ndarray, length: int) -> np.ndarray:
    """For each position of a block of bytes whether its window occurs elsewhere in it."""
    return matching(t, length) >= length


def block_passages(t: np.ndarray, owner: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """For each position of a block of word hashes whether its window stands in two documents. owner, many (the segment itself does): by position."""
    t = np.unique(t, return_inverse=True)[1]
    sa = suffix_array(t)
    n = len(t)
    h, q = common.prefix_hash(t), common.powers(n)[1]
    whole = sa + length <= n
    at = np.minimum(sa, max(n - length, 0))
    value = (h[np.minimum(at + length, n)] - h[at]) * q[at]
    cuts = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | ~whole[1:] | ~whole[:-1]))
    two = (np.minimum.reduceat(owner[sa], cuts) != np.maximum.reduceat(owner[sa], cuts)) | np.logical_or.reduceat(many[sa], cuts)
    flag = np.zeros(n, bool)
    flag[sa] = np.repeat(two, np.diff(np.append(cuts, n)))
    return flag


def _joined(segments: list[np.ndarray], between) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(s) for s in segments])
    start = np.cumsum(np.append(0, lens[:-1] + 1))
    t = np.full(int(lens.sum() + len(lens)), between)
    for s, x in zip(start.tolist(), segments):
        t[s : s + len(x)] = x
    return t, start, lens


# ---------------------------------------------------------------- the operator

#: A segment without its text: windows w0 to w1 of a text picked the anchor at pos; [lo, hi) is the range of windows relative to it.
SEG = "key long, c long, tid binary, w0 int, w1 int, pos int, lo int, hi int, many boolean, size int"
TEXT = "key long, tid binary, w0 int, many boolean, symbols binary"
SPAN = "tid binary, kind int, s int, e int"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(x == 1), np.flatnonzero(x == -1)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, schema)], schema=schema)


_SEG = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("tid", pa.binary()), *((n, pa.int32()) for n in ("w0", "w1", "pos", "lo", "hi")), ("many", pa.bool_()), ("size", pa.int32())])
_TEXT = pa.schema([("key", pa.int64()), ("tid", pa.binary()), ("w0", pa.int32()), ("many", pa.bool_()), ("symbols", pa.binary())])


class _Text:
    """A text as symbols of both kinds, and hashes of its parts."""

    def __init__(self, text: str):
        self.raw = text.encode()
        self.data = np.frombuffer(self.raw, np.uint8)
        s, e, _ = common.words(self.data, np.array([0, len(self.data)]))
        self.words = common.word_hashes(self.data, s, e, lower=False)
        self.symbols = self.raw, self.words.tobytes()
        self.sums = [None, None]

    def part(self, kind: int, a: int, b: int) -> bytes:
        width = Windows.width[kind]
        return self.symbols[kind][a * width : b * width]

    def hashes(self, kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of the parts [a, b) in symbols."""
        if self.sums[kind] is None:
            self.sums[kind] = common.prefix_hash((self.data, self.words)[kind])
        h, q = self.sums[kind], common.powers(len(self.sums[kind]))[1]
        return common.mix((h[b] - h[a]) * q[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93)).view(np.int64)


def _seg_batch(tid: bytes, key, c, w0, w1, pos, lo, hi, many, size) -> pa.RecordBatch:
    n = len(key)
    full = lambda x, t: pa.array(np.full(n, x) if np.isscalar(x) else x, t)
    return pa.RecordBatch.from_arrays([full(key, pa.int64()), full(c, pa.int64()), pa.array([tid] * n, pa.binary()), *(full(np.asarray(x, np.int32) if not np.isscalar(x) else np.int32(x), pa.int32()) for x in (w0, w1, pos, lo, hi)), full(many, pa.bool_()), pa.array(np.asarray(size, np.int32))], schema=_SEG)


def _segments(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Batches of (tid, text, hashes of anchors that occur at two places)."""
    for batch in batches:
        for tid, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = _Text(text)
            h, pos, w0, w1 = text_anchors(x.data, x.words, windows)
            hit = np.isin(h.view(np.int64), marks.values.to_numpy())
            h, pos, w0, w1 = h[hit], pos[hit], w0[hit], w1[hit]
            for kind in (BYTES, WORDS):
                own = (h & U64(1)) == kind
                if own.any():
                    a, b = w0[own], w1[own] + windows.length[kind]
                    yield _seg_batch(tid, h[own].view(np.int64), x.hashes(kind, a, b), a, w1[own], pos[own], windows.k[kind] - windows.length[kind], 1, False, (b - a) * windows.width[kind])


def _split(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Batches of (tid, text, segments): halves of each segment's range of windows, keyed by the text all of a half's windows share."""
    for batch in batches:
        for tid, text, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = _Text(text)
            cols = {f.name: segments.values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(segments.type.value_type)}
            for kind in (BYTES, WORDS):
                own = (cols["key"] & 1) == kind
                key, w0, w1, pos, lo, hi, many = (cols[n][own] for n in ("key", "w0", "w1", "pos", "lo", "hi", "many"))
                w0, w1, pos, lo, hi = (v.astype(np.int64) for v in (w0, w1, pos, lo, hi))
                mid, length = (lo + hi) // 2, windows.length[kind]
                for a, b in ((lo, mid), (mid, hi)):
                    x0, x1 = np.maximum(w0, pos + a), np.minimum(w1, pos + b - 1)
                    ok = (a < b) & (x0 <= x1)
                    if not ok.any():
                        continue
                    a, b, x0, x1, p = a[ok], b[ok], x0[ok], x1[ok], pos[ok]
                    core = x.hashes(kind, p + b - 1, p + a + length)
                    name = common.mix(common.mix(core.view(U64) ^ common.mix(key[ok].view(U64))) + (a + 1000003 * b).astype(U64))
                    name = ((name & ~U64(1)) | U64(kind)).view(np.int64)
                    yield _seg_batch(tid, name, x.hashes(kind, x0, x1 + length), x0, x1, p, a, b, many[ok], (x1 + length - x0) * windows.width[kind])


def _texts(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Batches of (tid, text, segments): the segments' texts."""
    for batch in batches:
        for tid, text, segments in zip(*(c.to_pylist() for c in batch.columns)):
            x = _Text(text)
            yield _batch([(m["key"], tid, m["w0"], m["many"], x.part(m["key"] & 1, m["w0"], m["w1"] + windows.length[m["key"] & 1])) for m in segments], _TEXT)


def _blocks(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Batches of (key, tid, w0, many, symbols) sorted by key: whole groups gathered into blocks, each of one kind."""
    held: tuple[list, list] = [], []
    size = [0, 0]
    group: list[tuple] = []

    def flush(kind: int) -> pa.RecordBatch:
        rows, length = held[kind], windows.length[kind]
        out = []
        if rows:
            symbols = np.uint8 if kind == BYTES else U64
            t, start, lens = _joined([np.frombuffer(x[4], symbols) for x in rows], symbols(255))  # a byte that UTF-8 has not
            if kind == BYTES:
                flags = block_repeats(t, length)
            else:
                owner = np.unique([x[1].hex() for x in rows], return_inverse=True)[1]
                flags = block_passages(t, np.repeat(owner, lens + 1), np.repeat([x[3] for x in rows], lens + 1), length)
            fits = np.zeros(len(t) + 1, np.int8)  # where a window lies within its segment
            fits[start] += 1
            fits[start + lens - length + 1] -= 1
            s, e = _runs(flags & (np.cumsum(fits[:-1]) > 0))
            of = np.searchsorted(start, s, "right") - 1
            w0 = np.array([x[2] for x in rows])
            out = [(rows[i][1], kind, a, b) for i, a, b in zip(of.tolist(), (w0[of] + s - start[of]).tolist(), (w0[of] + e - start[of] - 1 + length).tolist())]
        rows.clear()
        size[kind] = 0
        cols = zip(*out) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int32()))], names=["tid", "kind", "s", "e"])

    def close() -> int:
        """The group is whole: it joins the block of its kind."""
        kind = group[0][0] & 1
        held[kind].extend(group)
        size[kind] += sum(len(x[4]) + 1 for x in group)
        group.clear()
        return kind

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[0][0] != row[0]:
                kind = close()
                if size[kind] >= BLOCK_BYTES * windows.width[kind] // 4 ** kind:
                    yield flush(kind)
            group.append(row)
    if group:
        close()
    yield flush(BYTES)
    yield flush(WORDS)


def repeated_spans(indexed: DataFrame, docs: DataFrame, windows: Windows, text: str, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """((tid, kind, s, e) of distinct texts with repeated windows, (tid, text) of the texts that can have some). indexed is a written table of its own, removed here."""
    # anchors at two places: hashes alone travel. Copies of a text have equal places, and count once
    flat = indexed.select(F.explode(F.arrays_zip("h", "at")).alias("m")).select("m.*")
    twice = common.table(flat.groupBy("h").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("h"), "twice")
    # of the texts that hold such anchors one row each; rows without a doc_id are named by their text alone
    named = F.coalesce(F.col("doc_id").cast("string"), F.hex("tid")).alias("name")
    holders = indexed.select("tid", named, F.explode("h").alias("h")).join(twice.hint("merge"), "h")  # both sides dealt anew, so a hot anchor's can be split
    all_marks = common.table(holders.groupBy("tid", "name").agg(F.collect_set("h").alias("marks")), "marks")  # within one document
    one = all_marks.groupBy(F.col("tid").alias("of")).agg(F.min("name").alias("name"))
    marks = all_marks.withColumnRenamed("name", "own").join(one.hint("merge"), (F.col("tid") == F.col("of")) & (F.col("own") == F.col("name"))).select("name", "tid", "marks")
    own = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    docs = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.substring(F.upper(F.sha2(text, 256)), 1, 32)).alias("name"))
    held = common.table(docs.join(marks.hint("merge"), "name").where(own == F.col("tid")).dropDuplicates(["name", "tid"]).select("tid", "text", "marks"), "held")
    common.discard(twice, all_marks, indexed)
    seg = held.mapInArrow(lambda it: _segments(it, windows), SEG)

    spans = None
    texts = held.select("tid", "text")
    pool = None  # from the second round on: the texts that large groups hold, no others travel again
    while True:
        seg = common.table(seg, "segments")
        # equal segments of a group: every window repeats; one of them goes on
        same = seg.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(F.struct("tid", "w0")).alias("who"), F.max("tid").alias("other"), F.max("many").alias("many"), F.max("size").alias("size"))
        same = common.table(same.withColumn("many", F.col("many") | (F.col("other") > F.col("who.tid"))).drop("other"), "segment-classes")
        common.sweep(docs.sparkSession)
        kind = F.col("key").bitwiseAND(F.lit(1)).cast("int")
        length = F.when(kind == BYTES, windows.length[BYTES]).otherwise(windows.length[WORDS])
        again = same.where(F.when(kind == BYTES, F.col("n") > 1).otherwise(F.col("many"))).select("key", "c")
        copied = seg.select("key", "c", "tid", "w0", "w1").join(again.hint("merge"), ["key", "c"]).select("tid", kind.alias("kind"), F.col("w0").alias("s"), (F.col("w1") + length).alias("e"))
        # words that one document repeats all go on, as what is found of one holds for each of them
        every = (kind == WORDS) & (F.col("n") > 1) & ~F.col("many")
        groups = same.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        going = common.table(same.join(groups.hint("merge"), "key").select("key", "c", "who", "many", "m", "n", "size", every.alias("every")), "going")
        few, rows = F.col("m") <= group, F.when(F.col("every"), F.col("n")).otherwise(1)
        total, n_small, n_large = going.agg(*(F.coalesce(F.sum(F.when(ok, v)), F.lit(0)) for ok, v in ((few, F.col("size") * rows), (few, rows), (~few, rows)))).first()

        def with_texts(some, n: int, source: DataFrame) -> DataFrame:
            """Texts of source with their chosen segments of the groups asked for, n segments in all."""
            way = "broadcast" if n <= SENT else "merge"
            chosen = seg.drop("many", "size").join(going.where(some).drop("n", "size").hint(way), ["key", "c"]).where(F.col("every") | (F.struct("tid", "w0") == F.col("who")))
            each = chosen.groupBy("tid").agg(F.collect_list(F.struct("key", "w0", "w1", "pos", "lo", "hi", "many")).alias("segments"))  # within one text
            return source.join(each.hint(way), "tid")

        parts = max(1, -(-total // (4 * BLOCK_BYTES)))
        small = with_texts(few, n_small, texts if pool is None else pool).mapInArrow(lambda it: _texts(it, windows), TEXT)
        matched = small.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda it: _blocks(it, windows), SPAN)
        now = common.table(copied.unionByName(matched), "spans")
        spans = now if spans is None else spans.unionByName(now)
        done = [seg, same, going, *([] if pool is None else [pool])]
        if n_large:
            hot = common.table(with_texts(~few, n_large, texts if pool is None else pool), "hot-texts")
            seg = hot.mapInArrow(lambda it: _split(it, windows), SEG)
            pool = hot.select("tid", "text")
            pool.stored_at = hot.stored_at
        common.discard(*done)
        if not n_large:
            return spans, texts


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    if not len(start):
        return []
    order = np.argsort(start)
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return list(zip(s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    for batch in batches:
        out = []
        for tid, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            kind, start, end = (np.asarray(c, np.int64) for c in spans.values.flatten())
            raw, kept, at = text.encode(), [], 0
            gone = _merged(start[kind == BYTES], end[kind == BYTES])
            for s, e in gone:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            rest = b"".join(kept)
            shared = _merged(start[kind == WORDS], end[kind == WORDS])
            if shared:
                ws, we, _ = common.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                shared = [(int(ws[s]), int(we[e - 1])) for s, e in shared]
            as_spans = lambda x: [{"s": s, "e": e} for s, e in x]
            out.append((tid, len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), as_spans(gone), as_spans(shared)))
        cols = zip(*out) if out else [[]] * 6
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pair, pair]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=["tid", "n_removed", "n_spans", "kept_sha256", "spans", "passages"])


CUT = "tid binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>, passages array<struct<s:int,e:int>>"


def remove_repeats(docs: DataFrame, min_bytes: int = 400, text: str = "text", group: int = GROUP, min_words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets of the removed runs) and passages of every row.

    passages: byte offsets, first word to last, of the maximal runs of words covered by min_words words that another document holds too.
    They are not removed for that. min_words 0: none are looked for.
    """
    windows = Windows((min_bytes, min_words))
    indexed = common.table(index_texts(docs, windows, text), "texts")
    kept = common.table(indexed.select("doc_id", "tid", "n_bytes", "n_words", "word_from", "word_to", "sha", (F.size("h") > 0).alias("long")), "rows")
    spans, texts = repeated_spans(indexed, docs, windows, text, group)
    by = spans.groupBy("tid").agg(F.collect_list(F.struct("kind", "s", "e")).alias("spans"))  # within one text
    done = common.table(texts.join(by.hint("merge"), "tid").mapInArrow(_cut, CUT), "cut")
    copies = kept.where("long").groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid", F.lit(True).alias("whole"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    whole = F.col("whole") & (F.col("n_bytes") >= min_bytes)
    told = F.col("whole") & (F.col("n_words") >= min_words) & F.lit(min_words > 0)
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("s"), b.cast("int").alias("e")))
    out = kept.join(copies, "tid", "left").join(done, "tid", "left")
    pick = lambda full, part, otherwise: F.when(whole, full).otherwise(F.coalesce(part, otherwise))
    return out.select(
        "doc_id", "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(EMPTY), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        pick(span(F.lit(0), F.col("n_bytes")), F.col("spans"), none).alias("spans"),
        F.when(told, span(F.col("word_from"), F.col("word_to"))).otherwise(F.coalesce("passages", none)).alias("passages"),
    )
