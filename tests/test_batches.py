import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import batches, tables
from tidewell.functions import text as T
from tidewell.operators import obfuscate

LEX = obfuscate.Lexicon({"and": ("nd", "n")}, "own")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * 1000] * 3000 + ["y" * (3 << 20), None, "z"] + [None] * 2000
    parts = list(batches.slices((pa.array(texts), pa.array(range(len(texts))))))
    assert [t for p, _ in parts for t in p.to_pylist()] == texts
    assert [i for _, p in parts for i in p.to_pylist()] == list(range(len(texts)))
    assert all(len(p) <= batches.ROWS and (len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= batches.BYTES) for p, _ in parts)


def test_a_worker_gives_each_slice_before_it_takes_the_next(spark):
    """A partition of 3,000 rows in one batch of Spark: no call sees more than a slice of it."""
    seen = batches.column_udf("int", lambda kind: lambda t: pa.array([len(t)] * len(t), kind))
    got = spark.range(3000).coalesce(1).select(F.repeat(F.lit("x"), 900).alias("t")).select(seen("t").alias("n")).collect()
    assert len(got) == 3000 and max(r.n for r in got) <= batches.ROWS


def test_variants_are_made_once_below_a_filter(spark):
    df = spark.createDataFrame([("hello wonderful people and others", "HATE", "0f")], "text string, label string, seed string")
    v = obfuscate.perturb(df, "text", "label", "seed", LEX)
    s = v.select(obfuscate.surface_similarity("text", F.col("variant.perturbed_text")).alias("s")).where("s is not null")
    assert plan(s).count("ArrowEvalPython") == 2


def test_restore_looks_at_each_token_once(spark):
    df = spark.createDataFrame([("Ko, (ko)  ok",)], "t string").select(T.restore(F.col("t"), T.lexicon_map({"ko": "không"})).alias("o"))
    assert plan(df).count("regexp_extract") <= 4
    odd = ["__ko__", "ko", "...", "(KO-ko)", "ko.ko", "_", "kO!?", "-ko Ko-"]
    got = [r.o for r in spark.createDataFrame([(x,) for x in odd], "t string").select(T.restore(F.col("t"), T.lexicon_map({"ko": "không", "_": "u"})).alias("o")).collect()]
    assert got == ["__ko__", "không", "...", "(KO-ko)", "ko.ko", "u", "không!?", "-không Không-"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aw.:/@# \n éſ_1", max_size=40))
def test_protected_stretches_by_runs(text):
    assert obfuscate.View(text).taken == [m.span() for m in obfuscate.PROTECTED.finditer(text)]
    taken = obfuscate.View(text).taken
    spans = [m.span() for m in obfuscate.WORD.finditer(text)]
    assert obfuscate.View(text).words == [(a, b) for a, b in spans if not any(a < y and x < b for x, y in taken)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**63), st.integers(1, 40), st.integers(1, 40))
def test_first_sites_are_those_of_the_shuffle(seed, n, take):
    draw = obfuscate.Draw(seed, 3, "kind")
    assert draw.first(n, take, "site") == sorted(draw.shuffled(range(n), "site")[:take])


def test_likeness_of_long_texts_counts_pairs_as_short_ones():
    from collections import Counter
    from itertools import pairwise

    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = ("".join(chr(c) for c in rng.integers(97, 104, n)) for n in rng.integers(200, 900, 2))
        assert obfuscate._shared_pairs(a, b) == (Counter(pairwise(a)) & Counter(pairwise(b))).total()


def test_augmentation_writes_texts_once(spark):
    rows = [(i, "ok" if i < 40 else f"hello wonderful people and number {i}", "HATE", "train", False) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, label string, split string, targeted boolean")
    with tables.tables_made() as made:
        out = obfuscate.augment(df, "id", "text", "label", "split", "targeted", 9, LEX).collect()
    sizes = [t.count() for t in made if "__v" in t.columns]
    assert len(out) == 80 and sizes[0] == 80 and len(sizes) > 2
    assert sizes == sorted(sizes, reverse=True) and all(n < 40 for n in sizes[1:])
