"""Secret scanning by a trigram inverted index.

Every rule is a regular expression. Its Boolean trigram query (an OR of ANDs of the
trigrams that every match must contain) is derived from the parsed expression. Each
Arrow batch of documents gets an inverted index from the queries' trigrams to posting
lists of documents; a rule's query intersects and unites postings, and only the
documents left are searched with the expression. A rule without mandatory trigrams
scans every document.

Null and empty texts have no spans. Rows that repeat are scanned each for itself.
Whole texts are scanned; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group has at least min_len characters."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 0


BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # maximal runs, so asking for the length in the expression drops the same matches
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + EXTRA

# ---------------------------------------------------------------- trigram queries


def _strings(node) -> tuple[list[set[str]] | None, int]:
    """The strings that one parsed item can be, lower-cased, as a list of sets by position; None if it can be too many."""
    op, arg = node
    if op is C.LITERAL:
        return [{chr(arg).lower()}], 1
    if op is C.IN:
        chars = set()
        for o, a in arg:
            if o is not C.LITERAL:
                return None, 1
            chars.add(chr(a).lower())
        return ([chars], 1) if len(chars) == 1 else (None, 1)
    return None, 0


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs over lower-case trigrams that holds for each text the pattern matches; [] if nothing is mandatory."""
    ways: list[tuple[frozenset[str], str]] = [(frozenset(), "")]  # trigrams so far, literal run that is still open

    def close(way: tuple[frozenset[str], str]) -> tuple[frozenset[str], str]:
        got, run = way
        return got | {run[i : i + 3] for i in range(len(run) - 2)}, ""

    def walk(items, ways):
        for op, arg in items:
            one, _ = _strings((op, arg))
            if one:
                ways = [(g, r + next(iter(one[0]))) for g, r in ways]
            elif op is C.SUBPATTERN:
                ways = walk(arg[3], ways)
            elif op is C.BRANCH:
                ways = [w for branch in arg[1] for w in walk(branch, ways)]
            elif op is C.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                ways = ways + walk(arg[2], ways)
            elif op is C.MAX_REPEAT and arg[0] >= 1 and len(arg[2]) == 1 and _strings(arg[2][0])[0]:
                ways = [close((g, r + next(iter(_strings(arg[2][0])[0][0])) * arg[0])) for g, r in ways]
            else:
                ways = [close(w) for w in ways]
        return ways

    out = {close(w)[0] for w in walk(_parser.parse(pattern), ways)}
    if not out or frozenset() in out:
        return []
    return sorted((x for x in out if not any(y < x for y in out)), key=sorted)


def _code(t: str) -> int:
    a, b, c = t.encode()
    return a << 16 | b << 8 | c


@lru_cache(8)
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    needed = sorted({_code(t) for q in queries for way in q for t in way if t.isascii()})
    slot = np.zeros(1 << 24, np.uint8 if len(needed) < 255 else np.uint16)
    slot[needed] = np.arange(1, len(needed) + 1)
    number = {c: i for i, c in enumerate(needed)}
    ways = [[[number[_code(t)] for t in sorted(way) if t.isascii()] for way in q] for q in queries]
    return [re.compile(r.pattern) for r in rules], ways, slot, len(needed)


def postings(data: np.ndarray, offs: np.ndarray, slot: np.ndarray, n: int) -> list[np.ndarray]:
    """For each needed trigram the sorted documents that hold it."""
    docs = len(offs) - 1
    if len(data) < 3:
        return [np.zeros(0, np.int64)] * n
    x = common.LOWER[data].astype(np.uint32)
    hit = slot[(x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]]
    at = np.flatnonzero(hit)
    doc = np.searchsorted(offs, at, "right") - 1
    inside = at + 2 < offs[doc + 1]
    key = np.unique((hit[at[inside]].astype(np.int64) - 1) * docs + doc[inside])
    cut = np.searchsorted(key, np.arange(n + 1) * docs)
    return [key[a:b] % docs for a, b in zip(cut[:-1], cut[1:])]


def _candidates(ways: list[list[int]], index: list[np.ndarray], docs: int) -> np.ndarray:
    if not ways:
        return np.arange(docs)
    found = np.zeros(0, np.int64)
    for way in ways:
        got = None
        for t in sorted(way, key=lambda t: len(index[t])):
            got = index[t] if got is None else np.intersect1d(got, index[t], assume_unique=True)
            if not len(got):
                break
        found = np.union1d(found, got)
    return found


def scan(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """For each text its spans (kind, start, end), by start, then in the order of the rules."""
    found, ways, slot, n = _compiled(rules)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(texts))]
    for a, b, data, offs in common.chunks(texts):
        index = postings(data, offs, slot, n)
        for k, (rule, exp) in enumerate(zip(rules, found)):
            for d in _candidates(ways[k], index, b - a).tolist():
                text = texts[a + d].as_py()
                for m in exp.finditer(text or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.min_len:
                        out[a + d].append((rule.kind, m.start(), m.end()))
    order = {r.kind: i for i, r in enumerate(rules)}
    for x in out:
        x.sort(key=lambda s: (s[1], order[s[0]]))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "spans", redacted: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with a column of spans; with redacted, that column too, in which mark stands for each stretch under spans.

    Other columns pass as they are. A column that already has one of the new names is replaced.
    """
    new = [out, *([redacted] if redacted else [])]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new or c == text])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in new)
    schema = ", ".join(x for x in (fields, f"`{out}` {SPANS}", f"`{redacted}` string" if redacted else "") if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            spans = scan(col, rules)
            names = [f for f in batch.schema.names if f not in new]
            arrays = [batch.column(batch.schema.get_field_index(f)) for f in names]
            arrays.append(pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], _SPANS))
            if redacted:
                arrays.append(pa.array([redact(t, x, mark) if x else t for t, x in zip(col.to_pylist(), spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *new])

    return kept.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans and all spans as text."""
    joined = lambda kinds: F.array_join(F.transform(kinds, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_secrets(docs.select("doc_id", "text")).select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

