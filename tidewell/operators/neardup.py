"""Near-duplicate edges by SimHash bands over character trigrams, and their components.

What travels for a text is 300 bytes: its name, length, signature and a sketch of its trigrams. The trigrams themselves, of which a
long text has few beside its length, are written once, and those of texts that still have a likely pair are sent to where all of their pairs are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.batches import column_udf
from tidewell.functions.tables import discard, drop, sweep, table, tables_made
from tidewell.functions.text import canonical, fold

BANDS = 4
CELLS = 256
#: Trigrams and texts whose pairs one task looks at together.
GRAMS, TEXTS = 1_000_000, 1024


def dedup_form(text: Column | str) -> Column:
    """Canonical text without marks, other signs as spaces."""
    return F.trim(F.regexp_replace(fold(canonical(text)), r"[^\p{L}\p{N}]+", " "))


def trigrams(form: str) -> np.ndarray:
    """Distinct character trigrams of the form between two spaces on each side, three code points in each number."""
    x = np.frombuffer(f"  {form}  ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:])


def packed(grams: np.ndarray) -> bytes:
    """Trigrams in order: each first two code points once with the number of third ones, then those; in as few bytes as the greatest code point takes."""
    two, n = np.unique(grams >> np.uint64(21), return_counts=True)
    points = np.concatenate([two >> np.uint64(21), two & np.uint64(0x1FFFFF), grams & np.uint64(0x1FFFFF)])
    width = 1 if points.max() < 256 else 2 if points.max() < 65536 else 4
    return np.array([width, len(two)], np.uint32).tobytes() + zlib.compress(points.astype(f"u{width}").tobytes() + n.astype(np.uint32).tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    width, two = np.frombuffer(x, np.uint32, 2).tolist()
    body = zlib.decompress(x[8:])
    points = np.frombuffer(body, f"u{width}", (len(body) - 4 * two) // width).astype(np.uint64)
    n = np.frombuffer(body, np.uint32, offset=len(body) - 4 * two)
    return np.repeat(points[:two] << np.uint64(42) | points[two : 2 * two] << np.uint64(21), n) | points[2 * two :]


_HASHES: dict[int, bytes] = {}


def _hashes(grams: np.ndarray) -> np.ndarray:
    """BLAKE2b of each trigram as eight bytes; a worker keeps those it met, up to a bound."""
    if len(_HASHES) > 1 << 18:
        _HASHES.clear()
    out = []
    for g in grams.tolist():
        h = _HASHES.get(g)
        if h is None:
            h = _HASHES[g] = hashlib.blake2b((chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)).encode(), digest_size=8).digest()
        out.append(h)
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, 8)


def _simhash(kind: pa.StructType):
    def run(forms: pa.Array) -> pa.Array:
        grams = [None if x is None else trigrams(x) for x in forms.to_pylist()]
        some = [g for g in grams if g is not None]
        known = np.unique(np.concatenate(some)) if some else np.zeros(0, np.uint64)
        h = _hashes(known)
        bits, cell = np.unpackbits(h, axis=1), (h[:, 0].astype(np.int64) << 8 | h[:, 1]) % CELLS
        sig, m, sketch, sets = [], [], [], []
        for g in grams:
            at = np.searchsorted(known, g) if g is not None else np.zeros(0, np.int64)
            signs = bits[at].sum(0, dtype=np.int64) * 2 >= len(at)
            sig.append(int(np.packbits(signs).view(">u8")[0].astype(np.uint64).view(np.int64)) if g is not None else 0)
            m.append(len(at))
            sketch.append(np.minimum(np.bincount(cell[at], minlength=CELLS), 255).astype(np.uint8).tobytes())
            sets.append(packed(g) if g is not None else None)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((sig, m, sketch, sets), kind)], fields=list(kind))

    return run


#: sig: 64 bits by the sign of summed bits of the trigrams' hashes; a tie sets the bit. m: trigrams; sketch: their number, up to 255, in each of CELLS cells; grams: all of them, packed.
simhash = column_udf(T.StructType([T.StructField("sig", T.LongType()), T.StructField("m", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("grams", T.BinaryType())]), _simhash, once=True)


def _most_shared(kind: pa.DataType):
    def run(a: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for s in (a, b))
        return pa.array((m.to_numpy() - np.abs(x - y).sum(1, dtype=np.int64)) // 2, kind)

    return run


#: A bound of the trigrams that two texts share: cells that differ by d hold d trigrams of one text alone. m: trigrams of both together.
most_shared = column_udf(T.IntegerType(), _most_shared, once=True)


def near_edges(df: DataFrame, key: str, text: str = "text", max_hamming: int = 8, min_jaccard: float = 0.9, min_length_ratio: float = 0.85, min_chars: int = 12) -> DataFrame:
    """(a, b): pairs that share one of four 16-bit bands and pass the length, Hamming and Jaccard tests."""
    return form_edges(signed(df.select(F.col(key).alias("k"), dedup_form(text).alias("form"))), max_hamming, min_jaccard, min_length_ratio, min_chars)


def signed(rows: DataFrame) -> DataFrame:
    """rows as a table, with n, the form's length, and s, its simhash, in place of form."""
    return table(rows.withColumn("n", F.length("form")).withColumn("s", simhash("form")).drop("form"), "forms")


def _likely(sigs: DataFrame, max_hamming: int, min_jaccard: float, min_length_ratio: float) -> DataFrame:
    """(a, b): pairs that pass all tests but the last one, in which their sketches stand for trigrams."""
    bands = sigs.select("*", F.posexplode(F.array(*[F.shiftrightunsigned("sig", 16 * b).bitwiseAND(F.lit(65535)) for b in range(BANDS)])).alias("band", "v"))
    a, b = bands.alias("a"), bands.alias("b")
    ok = (F.col("a.k") < F.col("b.k")) & (F.least("a.n", "b.n") >= min_length_ratio * F.greatest("a.n", "b.n")) & (F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) <= max_hamming)
    ok &= F.least("a.m", "b.m") >= min_jaccard * F.greatest("a.m", "b.m")  # as the Jaccard test needs it
    for i in range(BANDS - 1):  # the band that counts is the first of those that a pair shares
        ok &= (F.shiftrightunsigned(F.col("a.sig").bitwiseXOR(F.col("b.sig")), 16 * i).bitwiseAND(F.lit(65535)) != 0) | (F.col("a.band") <= i)
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & ok)
    pairs = pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), (F.col("a.m") + F.col("b.m")).alias("m"), most_shared("a.sketch", "b.sketch", F.col("a.m") + F.col("b.m")).alias("most"))
    return pairs.where(F.col("most") >= min_jaccard * (F.col("m") - F.col("most"))).select("a", "b")


def form_edges(rows: DataFrame, max_hamming: int = 8, min_jaccard: float = 0.9, min_length_ratio: float = 0.85, min_chars: int = 12, counted: bool = False) -> DataFrame:
    """near_edges of rows (k, n, s); rows of one k have one form.

    counted: (a, b, links) in place of all pairs, from each task as many pairs as join what its pairs join, and for each text a its number
    of pairs, with null b. Pairs grow with the square of a group, these rows with its texts.

    Cheap tests come first, with bounds that no pair of enough shared trigrams fails. Pairs that passed them make groups; a group's trigrams go
    to one task once, with all its pairs. A group of more than GRAMS or TEXTS is dealt into blocks, and each two blocks meet in a task.
    """
    base = rows.where(F.col("n") >= min_chars).select("k", "n", "s.*")
    sigs = table(base.drop("grams").dropDuplicates(["k"]), "sketches")
    pairs = table(_likely(sigs, max_hamming, min_jaccard, min_length_ratio), "pairs")
    sweep(rows.sparkSession)
    with tables_made() as made:
        nodes = components(forests(pairs)).join(sigs.select(F.col("k").alias("node"), F.col("m").alias("n")), "node")
        size = nodes.groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / GRAMS, F.count("*") / TEXTS)).cast("int").alias("blocks"))
        nodes = table(nodes.join(size, "component").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "nodes")
    drop(*(t for t in made if t is not nodes))
    # groups of one block share tasks, as many as their trigrams take
    small = max(1, -(-(nodes.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) // GRAMS))
    task = lambda i, j: F.struct(F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(small)).cast("string")).otherwise(F.col("component").cast("string")).alias("g"), F.when(F.col("blocks") == 1, -1).otherwise(F.least(i, j)).alias("i"), F.when(F.col("blocks") == 1, -1).otherwise(F.greatest(i, j)).alias("j"))
    sent = nodes.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("node").alias("k"), task(F.col("at"), F.col("o")).alias("t"))
    sets = base.select("k", "grams").join(nodes.select(F.col("node").alias("k")), "k", "left_semi").dropDuplicates(["k"]).join(sent, "k").select("t.*", "k", "grams")
    left, right = nodes.select(F.col("node").alias("a"), "component", "blocks", F.col("at").alias("x")), nodes.select(F.col("node").alias("b"), F.col("at").alias("y"))
    where = pairs.join(left, "a").join(right, "b").select(task(F.col("x"), F.col("y")).alias("t"), "a", "b").select("t.*", "a", "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def judge(edges: pa.Table, texts: pa.Table) -> pa.Table:
        found = edges.select(["a", "b"]).filter(pa.array(enough(edges, texts, min_jaccard)))
        return counts(found) if counted else found

    by = ("g", "i", "j")
    return where.groupBy(*by).cogroup(sets.groupBy(*by)).applyInArrow(judge, f"a {kind}, b {kind}" + ", links long" * counted)


def counts(edges: pa.Table) -> pa.Table:
    """(a, b, links): edges that join what all of them join, with null links; and each end's number of edges, with null b."""
    kept, n = forest(edges), Counter(chain(edges["a"].to_pylist(), edges["b"].to_pylist()))
    kind = edges.schema.field("a").type
    return pa.table([pa.array([*kept["a"].to_pylist(), *n], kind), pa.array([*kept["b"].to_pylist(), *[None] * len(n)], kind), pa.array([*[None] * kept.num_rows, *n.values()], pa.int64())], names=["a", "b", "links"])


def forest(edges: pa.Table) -> pa.Table:
    """As many of the edges (a, b) as join what all of them join."""
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    keep = []
    for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist()):
        p, q = top(a), top(b)
        keep.append(p != q)
        if p != q:
            up[p] = q
    return edges.filter(pa.array(keep, pa.bool_()))


def forests(edges: DataFrame) -> DataFrame:
    """edges (a, b) without those that a batch of them doesn't need to join what it joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from forest(pa.Table.from_batches([batch])).to_batches()

    return edges.mapInArrow(run, edges.schema)


def enough(edges: pa.Table, texts: pa.Table, min_jaccard: float) -> np.ndarray:
    """For each edge (a, b) whether texts (k, grams) share enough trigrams. One text's are marked, and its partners' marks counted."""
    if not edges.num_rows:
        return np.zeros(0, bool)
    place = {k: i for i, k in enumerate(texts["k"].to_pylist())}
    grams = [unpacked(x) for x in texts["grams"].to_pylist()]
    cut = np.cumsum([0, *map(len, grams)])
    known, ids = np.unique(np.concatenate(grams), return_inverse=True)
    a, b = (np.array([place[k] for k in edges[c].to_pylist()]) for c in ("a", "b"))
    marks, ok, last = np.zeros(len(known), bool), np.zeros(len(a), bool), None
    for e in np.argsort(a, kind="stable").tolist():
        x, y = a[e], b[e]
        if x != last:
            marks[:] = False
            marks[ids[cut[x] : cut[x + 1]]] = True
            last = x
        common = int(marks[ids[cut[y] : cut[y + 1]]].sum())
        ok[e] = common >= min_jaccard * (len(grams[x]) + len(grams[y]) - common)
    return ok


def duplicate_groups(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, component, links) of every row: component is the least key of its group, links the number of other texts near its own.

    Rows of one canonical text are one group; near texts, and texts of signs that differ in the runs' lengths only, join groups. Texts are told apart by a hash of the canonical
    text, so rows that repeat a key or have none are grouped by what they say.
    """
    with tables_made() as made:
        canon = df.select(F.col(key), canonical(text).alias("canon")).select(key, F.unhex(F.md5("canon")).alias("k"), symbolic_key(F.col("canon")).alias("signs"), F.trim(F.regexp_replace(fold("canon"), r"[^\p{L}\p{N}]+", " ")).alias("form"))
        rows = signed(canon)
        near = table(form_edges(rows, counted=True), "near")
        names = table(rows.select(key, "k", "signs"), "names")
    discard(*(t for t in made if t is not near and t is not names))
    with tables_made() as made:
        links = near.where("b is null").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
        joins = near.where("b is not null").select("a", "b")
        signs = names.where("signs is not null").select("k", "signs").distinct()
        alike = signs.join(signs.groupBy("signs").agg(F.min("k").alias("b")), "signs").where("k <> b").select(F.col("k").alias("a"), "b")
        joined = components(joins.union(alike)).select(F.col("node").alias("k"), F.col("component").alias("c"))
        texts = names.groupBy("k").agg(F.min(key).alias("least")).join(joined, "k", "left").join(links, "k", "left")
        texts = table(texts.select("k", "least", F.coalesce("c", "k").alias("c"), F.coalesce("links", F.lit(0)).alias("links")), "texts")
    discard(near, *(t for t in made if t is not texts))
    named = texts.groupBy("c").agg(F.min("least").alias("component"))
    return names.select(key, "k").join(texts.join(named, "c").select("k", "component", "links"), "k").select(key, "component", "links")


def symbolic_key(canon: Column) -> Column:
    """Runs of signs as one sign, for texts without letters or digits; else null."""
    bare = F.replace(canon, F.lit(" "), F.lit(""))
    return F.when((bare != "") & ~bare.rlike(r"[\p{L}\p{N}]"), F.regexp_replace(bare, r"(.)\1+", "$1"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): least-label propagation with grouped minima, a table each round, until nothing changes."""
    both = table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct(), "edges")
    now = table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        near = both.join(now.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        new = now.join(near, "u").select("u", F.least("c", "m").alias("c"))
        jump = table(new.join(new.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c", "left").select("u", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        if jump.join(now.withColumnRenamed("c", "old"), "u").where("c <> old").isEmpty():
            drop(both, now)
            return jump.select(F.col("u").alias("node"), F.col("c").alias("component"))
        drop(now)
        now = jump


def merge_groupings(df: DataFrame, key: str, groupings: list[str]) -> DataFrame:
    """(node, component) of rows that share a group in any of the groupings, transitively: rows meet through each group's least row."""
    edges = None
    for g in groupings:
        least = df.groupBy(F.col(g).alias("__g")).agg(F.min(key).alias("__least"))
        e = df.select(F.col(key).alias("a"), F.col(g).alias("__g")).join(least, "__g").select("a", F.col("__least").alias("b"))
        edges = e if edges is None else edges.union(e)
    return components(edges)
