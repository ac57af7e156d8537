import pytest

from tidewell.sources import corpora
from tidewell.streaming import messages


def test_labelled_csv_contract(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text('free_text,label_id\n"two\nlines",1\nplain,0\n', encoding="utf-8")
    assert [(r.free_text, r.label_id) for r in corpora.labelled_csv(spark, str(good)).collect()] == [("two\nlines", 1), ("plain", 0)]
    bad = tmp_path / "b.csv"
    bad.write_text("text,label\nx,1\n")
    with pytest.raises(ValueError, match="header"):
        corpora.labelled_csv(spark, str(bad))


def test_jsonl_labels(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"text":"a","label":"HATE"}\n\n{"text":"b","label":"X","source":"s"}\n')
    assert [(r.text, r.source) for r in corpora.jsonl(spark, str(p), ["HATE"], strict=False).collect()] == [("a", "unknown")]
    with pytest.raises(Exception, match="unknown label"):
        corpora.jsonl(spark, str(p), ["HATE"]).collect()


def test_malformed_spans_are_empty(spark):
    df = spark.createDataFrame([("[1, 2]",), ("[1,",), (None,)], "s string")
    assert [(r.spans, r.malformed) for r in corpora.index_spans(df, "s").collect()] == [([1, 2], False), ([], True), ([], True)]


def test_checksums(spark):
    e = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    a = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "path string, sha256 string")
    assert {r.path: r.status for r in corpora.compare_checksums(e, a).collect()} == {"a": "OK", "b": "DIFFERENT", "c": "MISSING"}


def test_scan_flags_keywords(spark):
    df = spark.createDataFrame([("so baaad ko",), ("fine",), ("",)], "text string")
    got = messages.scan(df, ["bad"], {"ko": "không"}, k=1).collect()
    assert [(r.normalized, r.label, r.flagged) for r in got] == [("so bad không", "HATE", ["bad"]), ("fine", "CLEAN", []), ("", "CLEAN", [])]


def test_send_gate_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, True, False), (1, 1, True, True), (1, 2, False, False), (2, 1, True, False)], "conv_id long, turn long, flagged boolean, resend boolean")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = messages.send_gate(stream).writeStream.format("memory").queryName("gate").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.conv_id, r.turn, r.status) for r in spark.sql("select * from gate").collect())
    assert got == [(1, 1, "sent_anyway"), (1, 1, "warning"), (1, 2, "sent"), (2, 1, "warning")]
