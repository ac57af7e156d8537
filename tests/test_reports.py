import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import corpus, lexicon, metrics
from tidewell.sources import corpora


def test_pairs_leave_out_emoticons_elongations_and_signs(spark):
    rows = [("Ko, :)) vui", "không :D vui"), ("nàoooo ko!", "nào không"), ("a b", "a"), (None, "x"), ("(dc)", "được."), ("bb", "b"), ("ab", "b")]
    got = lexicon.pair_frequency(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert {(r.original, r.normalized): r.freq for r in got} == {("ko", "không"): 2, ("dc", "được"): 1, ("ab", "b"): 1}


def test_word_predicates(spark):
    words = spark.createDataFrame([(":))", True), ("xD", True), ("@@", True), ("=3", True), ("pop", True), ("so", False), ("4:", False), ("", False), ("a:)", False)], "w string, want boolean")
    assert all(bool(r.got) == r.want for r in words.select("want", lexicon.is_emoticon(F.col("w")).alias("got")).collect())
    pairs = spark.createDataFrame([("ngu", "ngủ", True, False), ("di", "đi", True, False), ("ngu", "ngu", False, False), ("quáaaa", "quáa", False, False), ("quáaaa", "quá", False, False), ("xaaa", "xa", False, True)], "a string, b string, marks boolean, long boolean")
    got = pairs.select("marks", "long", lexicon.differs_in_marks(F.col("a"), F.col("b")).alias("m"), lexicon.is_elongated(F.col("a"), F.col("b")).alias("l")).collect()
    assert [(r.m, r.l) for r in got[:3]] + [r.l for r in got[3:]] == [(True, False), (True, False), (False, False), True, False, True]


def test_blocked_words_and_lengths(spark):
    freq = spark.createDataFrame([("ko", "không", 5), ("r", "rồi", 9), ("x", "y", 7), ("x", "z", 3), ("q", "a", 6), ("q", "b", 4), ("longer", "l", 2)], "original string, normalized string, freq long")
    d = lexicon.induce_dictionary(freq, blocked=("r",))
    assert {r.original: r.normalized for r in d.collect()} == {"ko": "không", "x": "y", "longer": "l"}
    assert {r.length: r.n for r in lexicon.length_histogram(d).collect()} == {1: 1, 2: 1, 4: 1}
    assert lexicon.induce_dictionary(freq).where("original = 'r'").count() == 1


def test_highlight_kinds(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d"], [0.5, 0.25, 0.1, 0.05])], "w array<string>, v array<double>")
    got = row.select(*[text.highlight(F.col("w"), F.col("v"), 0.1, k).alias(k) for k in ("markdown", "plain", "ansi")]).first()
    assert got[:2] == ("**a** *b* *c* d", "[a] [b] [c] d")
    assert got.ansi == "\x1b[1;97;41ma\x1b[0m \x1b[1;30;43mb\x1b[0m \x1b[4mc\x1b[0m d"
    with pytest.raises(ValueError):
        text.highlight(F.col("w"), F.col("v"), 0.1, "html")


def test_softmax_of_two(spark):
    got = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "a double, b double").select(text.softmax_second(F.col("a"), F.col("b")).alias("p")).collect()
    assert [round(r.p, 6) for r in got] == [0.5, 0.880797]


def one_by_one(rows, taken, targets):
    """The rule, one row after the other."""
    seen, status = dict(taken), {}
    for label, n in targets.items():
        picked = 0
        for k, o in sorted(((k, o) for k, lab, o in rows if lab == label), key=lambda x: x[1]):
            if picked >= n:
                status[o] = "beyond_target"
            elif k in seen:
                status[o] = "exact_duplicate" if seen[k] == label else "exact_duplicate_label_conflict"
            else:
                seen[k], status[o], picked = label, "selected", picked + 1
    return status


@pytest.mark.parametrize("targets", [{"HATE": 4, "CLEAN": 5}, {"HATE": 0, "CLEAN": 1}, {"HATE": 99, "CLEAN": 99}])
def test_unique_selection_against_row_by_row(spark, targets):
    rows = [(f"k{i * 7 % 11}", "HATE" if i % 3 else "CLEAN", f"{i * 37 % 60:03d}") for i in range(60)]
    taken = [("k1", "HATE"), ("k2", "CLEAN")]
    df = spark.createDataFrame(rows, "key string, label string, o string")
    got = corpus.select_unique(df, spark.createDataFrame(taken, "key string, label string"), "key", "label", "o", targets)
    assert {r.o: r.status for r in got.collect()} == one_by_one(rows, taken, targets)


def test_shortage_is_an_error(spark):
    df = spark.createDataFrame([("HATE",), ("CLEAN",)], "label string")
    assert corpus.require_counts(df, "label", {"HATE": 1}).count() == 2
    with pytest.raises(ValueError, match="CLEAN"):
        corpus.require_counts(df, "label", {"HATE": 1, "CLEAN": 3})
    with pytest.raises(ValueError):
        corpus.require_counts(df.limit(0), "label", {"HATE": 1})


def test_matrix_falls_back_to_the_default(spark):
    s = spark.createDataFrame([("a", 0, 1, 0.4), ("a", 0, 0, 0.2), ("b", 0, 1, 0.4), ("b", 0, 0, 0.6)], "system string, cond int, y int, p double")
    t = spark.createDataFrame([("a", 0.3)], "system string, t double")
    got = {r.system: r for r in metrics.report_matrix(s, t, ["system", "cond"]).collect()}
    assert (got["a"].f1, got["a"].threshold, got["a"].tuned, got["a"].n, got["a"].n_hate, got["a"].predicted_hate_rate) == (1.0, 0.3, True, 2, 1, 0.5)
    assert (got["b"].f1, got["b"].threshold, got["b"].tuned) == (0.0, None, False)


def test_area_under_precision_and_recall(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.7), ("n", 0, 0.1)], "system string, y int, p double")
    # points (recall, precision): (0, 1), (.5, 1), (.5, .5), (1, 2/3)
    assert {r.system: r.pr_auc for r in metrics.pr_area(rows, ["system"]).collect()} == {"a": round(0.5 + 0.5 * (0.5 + 2 / 3) / 2, 6), "n": 0.0}


def test_list_histogram(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],), (None,)], "t array<string>")
    assert {r.value: (r.n, r.n_rows) for r in metrics.list_histogram(df, "t").collect()} == {"a": (3, 2), "b": (1, 1)}


def test_scans_of_side_tables(spark, tmp_path):
    (tmp_path / "d.json").write_text('{\n "ko": "không",\n "dc": "được"\n}', encoding="utf-8")
    assert {r.original: r.normalized for r in corpora.dictionary_table(spark, f"{tmp_path}/d.json").collect()} == {"ko": "không", "dc": "được"}
    (tmp_path / "p.csv").write_text('original,normalized\n"a, b",c\nx,\n', encoding="utf-8")
    assert [tuple(r) for r in corpora.aligned_pairs(spark, f"{tmp_path}/p.csv").collect()] == [("a, b", "c")]
    (tmp_path / "s.jsonl").write_text('{"system":"a","condition":"C0","row_id":"1","y":1,"p":0.5}\n')
    assert [tuple(r) for r in corpora.score_table(spark, f"{tmp_path}/s.jsonl").collect()] == [("a", "C0", "1", 1, 0.5)]
    (tmp_path / "m.json").write_text('{"results": {"a": {"C0": {"f1": 0.5, "n": 3, "note": "x"}}}}')
    assert [(r.system, r.condition, r.metrics) for r in corpora.report_cells(spark, f"{tmp_path}/m.json").collect()] == [("a", "C0", {"f1": 0.5, "n": 3.0, "note": None})]
    rows = [{"words": ["a"], "span_mask": [1], "label": "HATE"}, {"words": ["a"], "span_mask": [0], "label": "HATE"}, {"words": [], "span_mask": [1], "label": "HATE"}, {"words": ["b"], "span_mask": [1], "label": "CLEAN"}]
    (tmp_path / "w.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.words for r in corpora.span_rows(spark, f"{tmp_path}/w.jsonl").collect()] == [["a"]]


def test_selection_made_before_is_checked(spark):
    cols = "source_dataset string, revision string, text string, label string"
    make = lambda *more: spark.createDataFrame([("v", "r1", "one", "HATE"), ("v", "r1", "two", "CLEAN"), ("other", "r0", "one", "CLEAN"), *more], cols)
    read = lambda df, **n: corpora.cached_selection(df, {"revision": "r1"}, "v", "text", "label", n or {"HATE": 1, "CLEAN": 1})
    assert read(make()).count() == 2
    for bad in (("v", "r2", "three", "X"), ("v", "r1", " ONE ", "X"), ("v", "r1", None, "X"), ("v", "r1", "three", "X"), ("v", None, "three", "X")):
        with pytest.raises(ValueError, match="pinned"):
            read(make(bad))


def test_bounded_scan_says_whether_it_is_complete(spark):
    df = spark.range(5)
    assert corpora.bounded(df, ["id"], 3).count() == 3
    assert tuple(corpora.bounded_report(df, 3).first()) == (3, False)
    assert tuple(corpora.bounded_report(df, 5).first()) == (5, True)


def test_checksums_of_files_and_absent_ones(spark, tmp_path):
    import hashlib

    files = {"a.jsonl": b"{}\n{}\n", "b.jsonl": b"{}\n\n{}", "c.txt": b"x\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "e.jsonl").write_bytes(b"")  # no byte: absent
    got = {r.path: (r.sha256, r.bytes, r.lines) for r in corpora.files_checksums(spark, str(tmp_path)).collect()}
    lines = {"a.jsonl": 2, "b.jsonl": 3, "c.txt": None}
    assert got == {k: (hashlib.sha256(v).hexdigest(), len(v), lines[k]) for k, v in files.items()}
    e = spark.createDataFrame([("a", None), ("b", None), ("c", "3")], "path string, sha256 string")
    a = spark.createDataFrame([("a", "1"), ("c", "3")], "path string, sha256 string")
    assert {r.path: r.status for r in corpora.compare_checksums(e, a).collect()} == {"a": "EXTRA", "b": "MISSING", "c": "OK"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "HATE", None), ("b", "CLEAN", "empty_text")], "text string, label string, reason string")
    good = corpora.write_rejected(df, f"{tmp_path}/rejected")
    assert [r.text for r in good.collect()] == ["a"] and [r.text for r in spark.read.json(f"{tmp_path}/rejected").collect()] == ["b"]
    corpora.write_projection(df, f"{tmp_path}/plain")
    with pytest.raises(Exception, match="(?i)exists"):
        corpora.write_projection(df, f"{tmp_path}/plain")
    corpora.write_projection(df.limit(1), f"{tmp_path}/plain", force=True)
    assert spark.read.json(f"{tmp_path}/plain").columns == ["label", "text"]
    n = df.groupBy("label").agg(F.count("*").alias("n"), F.lit(0.5).alias("share"))
    want = corpora.write_manifest(spark, {"labels": n}, f"{tmp_path}/manifest")
    assert json.loads(spark.read.text(f"{tmp_path}/manifest", wholetext=True).first()[0]) == want
    assert corpora.markdown_table(n.orderBy("label")).splitlines() == ["| label | n | share |", "| - | - | - |", "| CLEAN | 1 | 0.5000 |", "| HATE | 1 | 0.5000 |"]
    card = corpora.dataset_card("Rows", "Made by hand.", {"Labels": n})
    corpora.write_card(spark, card, f"{tmp_path}/card")
    assert spark.read.text(f"{tmp_path}/card", wholetext=True).first()[0].strip() == card.strip()
    with pytest.raises(ValueError, match="at most"):
        corpora.report_rows(spark.range(corpora.REPORT_ROWS + 1))
