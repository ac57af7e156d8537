from pyspark.sql import functions as F

from tidewell.functions import hashing, names, text

TEXTS = ["n.g.u", "quaaaa xoong", "Đi Về 3.14", "it's ½ OK", "", None]


def test_sql_names_equal_the_columns(spark):
    assert len(names.register_all(spark)) == 8
    spark.createDataFrame([(t,) for t in TEXTS], "t string").createOrReplaceTempView("named")
    t = F.col("t")
    columns = [text.nfc(t), text.fold(t), text.plain_after_marked(t), hashing.blake2b_64(t), text.separators(t), text.elongation(t), text.tokens(t), F.sha2(t, 256)]
    want = spark.table("named").select("t", *[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    calls = ", ".join(f"{n}(t) AS c{i}" for i, n in enumerate([*names.ARROW, *names.EXPRESSIONS]))
    got = spark.sql(f"SELECT t, {calls} FROM named").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_dictionary_tokens_and_labels(spark):
    rows = spark.createDataFrame([("(abc!)", "ABC", " hate ")], "a string, b string, c string")
    got = rows.select(text.strip_edges(F.col("a")), text.case_like(F.col("b"), F.lit("xyz")), text.label_id(F.col("c"), {"CLEAN": 0, "HATE": 1}), text.label_id(F.col("a"), {"HATE": 1}), hashing.sample_id("b")).first()
    assert got[:4] == ("abc", "XYZ", 1, -1)
    assert got[4].startswith("sv_") and len(got[4]) == 27
