import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import corpus, obfuscate, quality

LEX = obfuscate.Lexicon({"không": ("ko", "khong"), "và": ("n",)}, "own")
TEXTS = ["không biết nói gì và quá buồn", "Bình thường thôi bạn ơi, xem https://a.b/không nhé", "!!!", "hello wonderful people of the world", "", None, "  ", "điện thoại của mọi người"]


def messages(spark):
    rows = [(i, t, "HATE" if i % 2 else "CLEAN", f"s{i % 3}", ("train", "test")[i % 5 == 4]) for i, t in enumerate(TEXTS * 5)]
    return spark.createDataFrame(rows, "sample_id long, text string, label string, source_dataset string, target_split string")


def same_as_plain(edits, text):
    for e in edits:
        assert text[e["before_start"] : e["before_end"]] == e["before"]
        text = text[: e["before_start"]] + e["after"] + text[e["before_end"] :]
    return text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aăâbcdđeghiknoôpquvxyáà ,.!@#:/'\n", max_size=60), st.integers(0, 2**63), st.sampled_from(["HATE", "CLEAN"]))
def test_traces_replay(text, seed, label):
    got = obfuscate.Perturber(LEX).perturb(text, label, seed)
    if got is None:
        return
    assert same_as_plain(got["perturbation_edits"], text) == got["perturbed_text"] != text
    assert got["perturbation_count"] == len(got["perturbation_edits"]) == len(got["perturbation_types"])
    if label == "CLEAN":
        assert obfuscate.risks(got["perturbed_text"]) <= obfuscate.risks(text)


@pytest.mark.parametrize("kind", [*obfuscate.KINDS, "mixed"])
def test_required_kind_is_used(kind):
    text = "không biết bây giờ mọi người quá vội vào thế, thôi rồi bạn"
    got = next(x for x in (obfuscate.Perturber(LEX).perturb(text, "HATE", s, kind, 2 if kind == "mixed" else 1) for s in range(40)) if x)
    types = set(got["perturbation_types"])
    assert len(types) >= 2 if kind == "mixed" else kind in types


def test_protected_stretches_stay():
    text = "không https://x.vn/không @không #không ai@không.vn"
    for seed in range(40):
        got = obfuscate.Perturber(LEX).perturb(text, "HATE", seed, disabled=frozenset({"expressive_lengthening"}))
        assert got is None or got["perturbed_text"].endswith(" https://x.vn/không @không #không ai@không.vn")


def test_guard():
    assert not obfuscate.keeps_label("a chợ", "a chợ", "CLEAN")
    assert not obfuscate.keeps_label("đi chơi nhé bạn ơi", "đi cho nhé bạn ơi", "CLEAN")
    assert obfuscate.keeps_label("đi chơi nhé bạn ơi", "đi cho nhé bạn ơi", "HATE")
    assert obfuscate.keeps_label("!", "!!!!", "CLEAN") and not obfuscate.keeps_label("!", "!" * 12, "CLEAN")
    assert not obfuscate.keeps_label("a long enough text", "a", "HATE")
    long = "wonderful people of the world " * 40
    assert obfuscate.keeps_label(long, long.replace("people", "poeple", 3), "CLEAN")


def test_options_are_checked():
    for bad in ((0, 1, 1.0), (2, 1, 1.0), (1, 1, 0.0), (1, 1, 1.5)):
        with pytest.raises(ValueError):
            obfuscate.check_options(*bad)
    with pytest.raises(ValueError):
        obfuscate.check_options(1, 2, 1.0, "typographical_noise", ("typographical_noise",))


def test_normalize_twin_equals_columns(spark):
    rng = random.Random(5)
    alphabet = "aáàăbBđĐoOôe431@059.-_·~ \t\n!kK(),"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [t for t in TEXTS if t is not None]
    entries = {"k": "không", "ao": "ào", "bk": "biết"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for e in ({}, entries):
        got = [r.o for r in df.select(T.normalize(F.col("t"), e).alias("o")).collect()]
        assert got == [T.normalize_one(t, e) for t in texts]


def test_variant_is_the_same_under_any_partitioning(spark):
    df = messages(spark).withColumn("seed", obfuscate.seed_of(F.lit("1"), F.col("sample_id").cast("string")))
    run = lambda n: {r.sample_id: r.t for r in obfuscate.perturb(df.repartition(n), "text", "label", "seed", LEX).select("sample_id", F.col("variant.perturbed_text").alias("t")).collect()}
    one = run(1)
    assert one == run(7)
    assert all((one[r.sample_id] is None) == (not (r.text or "").strip()) for r in df.collect())


def augmented(spark):
    m = messages(spark).withColumn("teencode_valid_span_count", obfuscate.valid_spans("text", "label", LEX)).withColumn("teencode_eligible", F.col("teencode_valid_span_count") > 0)
    m = m.withColumn("teencode_targeted", F.col("teencode_eligible") & (F.col("sample_id") % 3 == 0))
    v = obfuscate.augment(m, "sample_id", "text", "label", "target_split", "teencode_targeted", 9, LEX).withColumnRenamed("text", "original_text")
    n = F.size(F.filter(F.coalesce("perturbation_types", F.array().cast("array<string>")), lambda x: x == obfuscate.LEXICAL))
    return v.withColumns({"teencode_applied_span_count": n, "teencode_applied": n > 0, "label_mapped": F.col("label"), "annotation_type": F.lit("human"), "duplicate_group_id": F.col("sample_id").cast("string")})


def test_augmentation_gate_and_review(spark):
    df = augmented(spark).checkpoint()
    rows = df.collect()
    assert len(rows) == len(TEXTS) * 5
    made = [r.perturbed_text for r in rows if r.perturbed_text and "duplicate_output" not in r.quality_flags]
    assert len(made) == len(set(made))
    assert all(("no_variant" in r.quality_flags) == (not (r.original_text or "").strip()) or r.teencode_targeted for r in rows)
    found = quality.gate(df.where("perturbed_text is not null"), LEX, exempt=tuple(obfuscate.PHRASES)).collect()
    assert [f for f in found if f.rule not in ("kind_missing",)] == []
    bad = df.where("perturbed_text is not null").withColumn("perturbed_text", F.concat("perturbed_text", F.lit("x")))
    assert quality.row_violations(bad, LEX).where("rule = 'trace_mismatch'").count() == bad.count()
    sheet = quality.review_sample(df.where("perturbed_text is not null"), 12, 3).orderBy("pick").collect()
    assert [r["pick"] for r in sheet] == list(range(1, 13)) and sheet[0]["slot"] == "label:HATE" and sheet[0]["label"] == "HATE"
    assert quality.review_sample(df, 0, 3).count() == 0


def test_gate_sees_each_broken_rule(spark):
    df = augmented(spark).where("perturbed_text is not null").checkpoint()
    change = {
        "count_off": ("perturbation_count", F.lit(99), "edit_count"),
        "label": ("label_mapped", F.lit("CLEANISH"), "label_mapping"),
        "weak": ("annotation_type", F.lit("weak_ai"), "weak_in_evaluation"),
        "spans": ("teencode_applied_span_count", F.lit(7), "applied_spans"),
        "types": ("perturbation_types", F.array().cast("array<string>"), "types_missing"),
        "same": ("perturbed_text", F.col("original_text"), "unchanged"),
    }
    for column, value, rule in change.values():
        assert quality.row_violations(df.withColumn(column, value), LEX).where(F.col("rule") == rule).count() > 0, rule
    one_group = df.withColumn("duplicate_group_id", F.lit("g"))
    assert {r.rule for r in quality.group_violations(one_group).collect()} >= {"group_across_splits"}
    assert {(r.subject, r.rule) for r in quality.total_violations(df, 1, {"HATE": 1}).collect()} >= {("total", "total"), ("HATE", "label_total")}


def test_gate_on_an_empty_table(spark):
    assert [(r.subject, r.rule) for r in quality.gate(augmented(spark).limit(0), LEX, exempt=obfuscate.KINDS).collect()] == [("mixed", "mixed_missing")]


def test_blind_spots_survive_the_normaliser(spark):
    df = messages(spark).withColumn("seed", obfuscate.seed_of(F.col("sample_id").cast("string")))
    got = [(r.text, r.variant) for r in obfuscate.blind_spots(df, "text", "seed").select("text", "variant").collect()]
    made = [(t, v.text, v.techniques) for t, v in got if v.text is not None]
    assert made and all(T.normalize_one(v) == v != t and 1 <= len(k) <= 2 for t, v, k in made)


def test_plain_variants(spark):
    df = spark.createDataFrame([("Bánh đa ABC ko", "0f"), (None, "01")], "t string, s string")
    run = lambda kind, **kw: df.select(obfuscate.plain_variant("t", "s", kind, **kw).alias("o")).collect()[0].o
    assert run("remove_diacritics") == "Banh da ABC ko"
    assert run("lookalike_substitute") == "8ánh đ4 48C k0"
    assert run("teencode_substitute", variants={"ko": ["không"]}) == "Bánh đa ABC không"
    assert run("spelling_noise", intensity=0.0) == "Bánh đa ABC ko"
    with pytest.raises(ValueError):
        obfuscate.plain_variant("t", "s", "nothing")


def test_mix_plan():
    assert corpus.mix_plan({"H": 60, "C": 90}, {"H": 100, "C": 50}, 0.3, 0.1) == {"perturbed": {"H": 60, "C": 60}, "clean_original": {"H": 30, "C": 30}, "blindspot_raw": {"H": 10, "C": 10}}
    assert corpus.mix_plan({"H": 20, "C": 40}, {"H": 10, "C": 30}, 0.3, 0.1, balanced=False) == {"perturbed": {"H": 20, "C": 40}, "clean_original": {"H": 8, "C": 22}, "blindspot_raw": {"H": 2, "C": 8}}


def test_take_until_counts_failures(spark):
    df = spark.createDataFrame([("H", 1, "a"), ("H", 2, None), ("H", 3, "b"), ("H", 4, "c"), ("C", 1, None)], "y string, i int, v string")
    got = corpus.take_until(df, "y", F.col("i"), F.col("v"), {"H": 2, "C": 1}).orderBy("i").collect()
    assert [(r.v, r.failed) for r in got] == [("a", 0), ("b", 1)]
