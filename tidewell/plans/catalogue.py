"""Named queries over the test tables, and SQL that states the same rows.

Labelled rows: documents joined with labels, toxic 1 is HATE. Scores stand in for a model's:
a hash of doc_id blended with the label, so every curve can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import hashing, text
from tidewell.functions.tables import table
from tidewell.operators import corpus, explain, lexicon, metrics, neardup, obfuscate, quality, variants
from tidewell.streaming import messages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, source, y, label: the smaller side is left to the optimizer's size estimate."""
    labels = read(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("y"))
    return read(spark, d, "documents").select("doc_id", "text", "source", "lang").join(labels, "doc_id").withColumn("label", F.when(F.col("y") == 1, "HATE").otherwise("CLEAN"))


def keyed_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).drop("text")


LAB = "lab AS (SELECT d.doc_id, d.text, d.source, d.lang, CAST(l.toxic AS INTEGER) AS y, CASE WHEN l.toxic = 1 THEN 'HATE' ELSE 'CLEAN' END AS label FROM documents d JOIN labels l USING (doc_id))"
TOK = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nl}\p{No}]+'), lambda x: lower(x))"
UNIT = "(CAST('0x' || substr(sha256({}), 1, 13) AS BIGINT) / 4503599627370496.0)"
CANON = r"trim(regexp_replace(regexp_replace(trim(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), E' \t\n\r\x0b\x0c'), '[\p{Cf}\p{Cc}]', '', 'g'), '\s+', ' ', 'g'))"
BLACK = f"f AS (SELECT word, count(*) FILTER (y = 1) AS hate_docs, count(*) AS docs FROM (SELECT y, unnest(list_distinct({TOK})) AS word FROM lab) GROUP BY word), bl AS (SELECT word, hate_docs, docs, round(hate_docs / docs, 6) AS ratio FROM f WHERE docs >= 5 AND hate_docs / docs >= 0.75 ORDER BY hate_docs / docs DESC, hate_docs DESC, word DESC LIMIT 400)"


def _metric_sql(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT {g}tp, fp, fn, tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1
FROM (SELECT {g}count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn FROM {src}{f' GROUP BY {by}' if by else ''})"""


# ---------------------------------------------------------------- keyword lists


def _keywords(spark, d, min_count=5):
    return lexicon.induce_keywords(lexicon.document_frequency(labelled(spark, d)), min_count)


@query(f"WITH {LAB}, {BLACK} SELECT * FROM bl")
def blacklist_induce(spark, d):
    return _keywords(spark, d).select("word", "hate_docs", "docs", "ratio")


def flagship(spark: SparkSession, d: str, min_count: int = 2) -> DataFrame:
    rows = labelled(spark, d)
    return metrics.scores(lexicon.flag_keywords(rows, _keywords(spark, d, min_count), "doc_id").agg(*metrics.confusion()))


PRED = f"pr AS (SELECT lab.*, CASE WHEN list_has_any({TOK}, (SELECT coalesce(list(word), []) FROM bl)) THEN 1 ELSE 0 END AS pred FROM lab)"


@query(f"WITH {LAB}, {BLACK}, {PRED} {_metric_sql('pr')}")
def blacklist_metrics(spark, d):
    return flagship(spark, d, 5)


@query(f"WITH {LAB}, {BLACK}, {PRED}, al AS (SELECT y, pred, source FROM pr UNION ALL SELECT y, pred, 'overall' FROM pr) {_metric_sql('al', 'source')}")
def blacklist_metrics_by_source(spark, d):
    pred = lexicon.flag_keywords(labelled(spark, d), _keywords(spark, d), "doc_id")
    both = pred.select(F.explode(F.array("source", F.lit("overall"))).alias("source"), "y", "pred")
    return metrics.scores(both.groupBy("source").agg(*metrics.confusion()))


# ---------------------------------------------------------------- text functions


def _text_query(name: str, column, sql: str) -> None:
    def f(spark, d):
        return read(spark, d, "documents").select("doc_id", column(F.col("text")).alias("out"))

    f.__name__ = name
    query(sql)(f)


_CHARS = "(SELECT doc_id, string_split(text, '') AS c FROM documents)"
_L = "regexp_full_match(c[i], '[a-zA-ZÀ-ỹ]')"
_text_query("text_nfc", text.nfc, "SELECT doc_id, nfc_normalize(text) AS out FROM documents")
_text_query("text_fold", text.fold, "SELECT doc_id, strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D')) AS out FROM documents")
_text_query("text_separators", text.separators, r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-zA-ZÀ-ỹ])[.\-_·~]([a-zA-ZÀ-ỹ])', '\1\2', 'g'), '([a-zA-ZÀ-ỹ])[.\-_·~]([a-zA-ZÀ-ỹ])', '\1\2', 'g') AS out FROM documents")
_text_query("text_elongation", text.elongation, f"SELECT doc_id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > 1 AND {_L} AND c[i] = c[i - 1] AND ((i > 2 AND c[i - 2] = c[i]) OR (i < len(c) AND c[i + 1] = c[i])) THEN '' ELSE c[i] END), '') AS out FROM {_CHARS}")
_text_query("text_lookalike", text.lookalike, r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\s+|\S+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') OR length(regexp_replace(t, '[^4310598@]', '', 'g')) = 0 OR length(regexp_replace(t, '[^\p{L}]', '', 'g')) <= length(regexp_replace(t, '[^4310598@]', '', 'g')) THEN t ELSE translate(t, '4310598@', 'aeiosgba') END), '') AS out FROM documents")
_text_query("text_tokens", lambda c: F.array_join(text.tokens(c), " "), f"SELECT doc_id, array_to_string({TOK}, ' ') AS out FROM documents")
_text_query("text_teencode", lambda c: text.restore(c, text.lexicon_map({"the": "THE", "and": "plus"})), r"""SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda w: CASE lower(regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}_]*', ''), '[^\p{L}\p{N}_]*$', ''))
WHEN 'the' THEN regexp_extract(w, '^[^\p{L}\p{N}_]*') || 'THE' || regexp_extract(w, '[^\p{L}\p{N}_]*$') WHEN 'and' THEN regexp_extract(w, '^[^\p{L}\p{N}_]*') || CASE WHEN regexp_matches(w, '^[^\p{L}\p{N}_]*A') THEN 'Plus' ELSE 'plus' END || regexp_extract(w, '[^\p{L}\p{N}_]*$') ELSE w END), ' ') AS out FROM documents""")

_text_query("variant_fullwidth", variants.fullwidth, f"SELECT doc_id, translate(text, '{variants.ASCII.replace(chr(39), chr(39) * 2)}', '{variants.FULLWIDTH}') AS out FROM documents")
_text_query("variant_zero_width", variants.zero_width, rf"SELECT doc_id, regexp_replace(text, '([a-zA-Z])([a-zA-Z]{{2,}})', '\1' || chr(8203) || '\2', 'g') AS out FROM documents")


@query(f"SELECT count(*) AS n, count(DISTINCT c) AS n_keys, count(*) FILTER (c = '') AS n_empty, count(*) - count(DISTINCT c) AS n_repeated FROM (SELECT {CANON} AS c FROM documents)")
def canonical_key_stats(spark, d):
    k = read(spark, d, "documents").select(text.canonical("text").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return k.agg(F.sum("n").alias("n"), F.count("*").alias("n_keys"), F.sum(F.when(F.col("c") == "", F.col("n")).otherwise(0)).alias("n_empty"), F.sum(F.col("n") - 1).alias("n_repeated"))


@query()
def text_normalize_changed(spark, d):
    docs = read(spark, d, "documents").select("text", text.normalize(F.col("text"), {"ko": "không", "dc": "được"}).alias("n"))
    return docs.agg(F.count("*").alias("n"), F.count_if(F.col("n") != F.col("text")).alias("changed"))


# ---------------------------------------------------------------- quarantine, sampling, splits


@query(f"WITH {LAB}, k AS (SELECT doc_id, y, {CANON} AS canon, CASE WHEN doc_id % 7 = 0 THEN 1 - y ELSE y END AS y2 FROM lab), c AS (SELECT canon, min(y2) <> max(y2) AS conflict FROM k GROUP BY canon) SELECT doc_id, CASE WHEN canon = '' THEN 'empty_text' WHEN conflict THEN 'label_conflict' END AS reason FROM k JOIN c USING (canon)")
def quarantine_conflicts(spark, d):
    rows = corpus.with_key(labelled(spark, d)).withColumn("y2", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return corpus.quarantine(rows, "y2").select("doc_id", "reason")


@query(f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unexpected_label' WHEN {CANON} = '' THEN 'empty_text' WHEN {UNIT.format('CAST(doc_id AS VARCHAR)')} < 0.3 THEN 'low_confidence' END AS reason FROM documents) GROUP BY ALL")
def reject_reasons(spark, d):
    rows = corpus.with_key(read(spark, d, "documents").select("doc_id", "text", "lang"))
    reason = corpus.reject_reason(F.col("lang"), ["en", "fr", "de"], F.col("canon"), hashing.unit(F.col("doc_id").cast("string")), 0.3)
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT source, doc_id, CAST(rn AS BIGINT) AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn FROM documents) WHERE rn <= 25")
def priority_sample(spark, d):
    return corpus.priority_sample(read(spark, d, "documents").select("source", "doc_id"), "source", hashing.key(F.col("doc_id").cast("string")), 25).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query(f"WITH r AS (SELECT * FROM (SELECT source, doc_id, {CANON} AS canon, sha256(CAST(doc_id AS VARCHAR)) AS p, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn FROM documents) WHERE rn <= 25) SELECT md5(canon) AS canon, arg_min(doc_id, source || p) AS doc_id FROM r GROUP BY canon")
def priority_sample_dedup(spark, d):
    rows = corpus.with_key(read(spark, d, "documents").select("source", "doc_id", "text")).select("source", "doc_id", F.md5("canon").alias("canon"))
    picked = corpus.priority_sample(rows, "source", hashing.key(F.col("doc_id").cast("string")), 25)
    return corpus.first_per_key(picked.select("canon", "doc_id", F.concat("source", "priority").alias("o")), "canon", [F.col("o")]).select("canon", "doc_id")


UNIQUE = f"""k AS (SELECT doc_id, label, {CANON} AS canon, sha256('9' || chr(0) || CAST(doc_id AS VARCHAR)) AS o FROM lab), t AS (SELECT canon, min(CASE WHEN doc_id % 2 = 0 THEN label ELSE 'CLEAN' END) AS seen FROM k WHERE doc_id % 13 = 0 GROUP BY canon), h AS (SELECT * FROM k LEFT JOIN t USING (canon) WHERE doc_id % 13 <> 0),
a1 AS (SELECT *, CASE WHEN seen IS NULL THEN min(CASE WHEN seen IS NULL THEN o END) OVER (PARTITION BY canon) END AS f FROM h WHERE label = 'HATE'), p1 AS (SELECT canon, f FROM a1 WHERE o = f ORDER BY o LIMIT 20), l1 AS (SELECT count(*) AS n, max(f) AS last FROM p1),
h2 AS (SELECT h.* REPLACE (coalesce(seen, CASE WHEN p1.f IS NOT NULL THEN 'HATE' END) AS seen) FROM h LEFT JOIN p1 USING (canon) WHERE label = 'CLEAN'),
a2 AS (SELECT *, CASE WHEN seen IS NULL THEN min(CASE WHEN seen IS NULL THEN o END) OVER (PARTITION BY canon) END AS f FROM h2), p2 AS (SELECT canon, f FROM a2 WHERE o = f ORDER BY o LIMIT 40), l2 AS (SELECT count(*) AS n, max(f) AS last FROM p2),
al AS (SELECT a1.*, n >= 20 AND coalesce(o > last, true) AS beyond FROM a1, l1 UNION ALL SELECT a2.*, n >= 40 AND coalesce(o > last, true) FROM a2, l2)"""


@query(f"WITH {LAB}, {UNIQUE} SELECT doc_id, CASE WHEN beyond THEN 'beyond_target' WHEN seen <> label THEN 'exact_duplicate_label_conflict' WHEN seen IS NOT NULL OR o <> f THEN 'exact_duplicate' ELSE 'selected' END AS status FROM al")
def select_unique(spark, d):
    """What becomes of each labelled document when 20 of one label and 40 of the other are taken in beside texts already taken."""
    rows = corpus.with_key(labelled(spark, d)).select("doc_id", "label", "canon", hashing.key(F.lit("9"), F.col("doc_id").cast("string")).alias("o"))
    old = F.col("doc_id") % 13 == 0
    taken = rows.where(old).select("canon", F.when(F.col("doc_id") % 2 == 0, F.col("label")).otherwise("CLEAN").alias("label"))
    return corpus.select_unique(rows.where(~old), taken, "canon", "label", "o", {"HATE": 20, "CLEAN": 40}).select("doc_id", "status")


@query("SELECT doc_id FROM documents ORDER BY sha256('42' || chr(0) || CAST(doc_id AS VARCHAR)) LIMIT 100")
def random_sample(spark, d):
    return corpus.random_sample(read(spark, d, "documents").select("doc_id"), hashing.key(F.lit("42"), F.col("doc_id").cast("string")), 100).select("doc_id")


@query("WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) SELECT source, lang, count(*) AS n, count(*) FILTER (rn <= floor(n * 0.3 + 0.5)) AS targeted FROM r GROUP BY source, lang")
def quota_per_stratum(spark, d):
    t = corpus.exact_quota(read(spark, d, "documents").select("source", "lang", "doc_id"), ["source", "lang"], hashing.key(F.col("doc_id").cast("string")), 0.3)
    return t.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if("targeted").alias("targeted"))


@query(f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {CANON} HAVING count(*) > 1")
def exact_groups(spark, d):
    rows = corpus.with_key(read(spark, d, "documents").select("doc_id", "text"))
    return rows.groupBy("canon").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


@query(r"SELECT k, count(*) AS n FROM (SELECT regexp_replace(html, '[^<>]', '', 'g') AS k FROM pages) GROUP BY k")
def symbolic_groups(spark, d):
    marks = read(spark, d, "pages").select(F.regexp_replace("html", "[^<>]", "").alias("k"))
    return marks.groupBy("k").agg(F.count("*").alias("n"))


@query()
def near_dup_components(spark, d):
    """Every document with its group: exact copies, and near ones of any member."""
    _checkpoint(spark)
    return neardup.duplicate_groups(read(spark, d, "documents"), "doc_id")


def _checkpoint(spark: SparkSession) -> None:
    """The shared folder of the session; one of our own only where none is set."""
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir") and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))


@query("""WITH RECURSIVE g AS (SELECT doc_id, source || ':' || lang AS a, 'n' || CAST(n_chars AS VARCHAR) AS b FROM documents), e AS (SELECT doc_id AS u, min(doc_id) OVER (PARTITION BY a) AS v FROM g UNION ALL SELECT min(doc_id) OVER (PARTITION BY a), doc_id FROM g UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY b) FROM g UNION ALL SELECT min(doc_id) OVER (PARTITION BY b), doc_id FROM g),
r AS (SELECT doc_id AS node, doc_id AS c FROM g UNION SELECT e.u, r.c FROM r JOIN e ON r.node = e.v WHERE r.c <= e.u) SELECT node, min(c) AS component FROM r GROUP BY node""")
def merged_groups(spark, d):
    _checkpoint(spark)
    rows = read(spark, d, "documents").select("doc_id", F.concat("source", F.lit(":"), "lang").alias("a"), F.concat(F.lit("n"), F.col("n_chars").cast("string")).alias("b"))
    return neardup.merge_groupings(rows, "doc_id", ["a", "b"])


SPLIT = f"k AS (SELECT d.doc_id, {CANON.replace('text', 'd.text')} AS canon, CASE WHEN l.toxic = 1 THEN 'HATE' ELSE 'CLEAN' END AS label, l.doc_id IS NOT NULL AS human FROM documents d LEFT JOIN labels l USING (doc_id)), g AS (SELECT md5(canon) AS g, array_to_string(list_sort(list(DISTINCT label)), '+') AS stratum, bool_and(human) AS human FROM k GROUP BY canon), s AS (SELECT g, stratum, CASE WHEN NOT human THEN 'train' WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, {UNIT.format(chr(39) + '42' + chr(39) + ' || chr(0) || stratum || chr(0) || g')} AS u FROM g))"


def _split(spark, d):
    labels = read(spark, d, "labels").select("doc_id", "toxic")
    rows = corpus.with_key(read(spark, d, "documents").select("doc_id", "text")).join(labels, "doc_id", "left")
    rows = rows.select("doc_id", F.md5("canon").alias("g"), F.when(F.col("toxic") == 1, "HATE").otherwise("CLEAN").alias("label"), F.col("toxic").isNotNull().alias("human"))
    return rows, corpus.leakage_safe_split(rows, "g", "label", "human", 42, 0.2, 0.2)


@query(f"WITH {SPLIT} SELECT g, stratum, split FROM s")
def leakage_safe_split(spark, d):
    return _split(spark, d)[1]


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, count(DISTINCT g) AS n_groups FROM (SELECT md5(canon) AS g FROM k) JOIN s USING (g) GROUP BY split")
def split_leak_check(spark, d):
    rows, split = _split(spark, d)
    return rows.groupBy("g").agg(F.count("*").alias("n")).join(split, "g").groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"))


def _near_split(spark, d):
    _checkpoint(spark)
    labels = read(spark, d, "labels").select("doc_id", "toxic")
    rows = read(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    rows = rows.select("doc_id", "text", F.when(F.col("toxic") == 1, "HATE").otherwise("CLEAN").alias("label"), F.col("toxic").isNotNull().alias("human"))

    def vary(rows):
        """A row without a free variant stands for itself."""
        m = _targeted(rows.select("doc_id", F.col("doc_id").cast("string").alias("sample_id"), "text", "label", "target_split"))
        made = obfuscate.augment(m, "sample_id", "text", "label", "target_split", "teencode_targeted", 42, CHAT, fields="perturbed_text string")
        return made.select("doc_id", F.coalesce("perturbed_text", "text").alias("variant"))

    return corpus.two_pass_split(rows, "doc_id", "text", "label", "human", vary, 42, 0.2, 0.2)


@query()
def near_safe_split(spark, d):
    """The split of every document by near-duplicate groups of the texts and of their variants; leakage_safe_split knows exact copies only, as its SQL says."""
    return _near_split(spark, d).select("doc_id", "group", "stratum", "split")


@query()
def near_split_leak_check(spark, d):
    """Rows and merged groups of each split, and the groups of texts and of variants that lie in another split too: none."""
    rows = table(_near_split(spark, d).select("split", "group", "source_group", "variant_group"))
    n = rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("group").alias("n_groups"))
    for kind in ("source_group", "variant_group"):
        each = rows.select("split", kind).distinct()
        crossing = each.join(each.groupBy(kind).count().where("count > 1"), kind).groupBy("split").agg(F.count("*").alias(f"{kind}s_crossing"))
        n = n.join(crossing, "split", "left").fillna(0, [f"{kind}s_crossing"])
    return n


@query(f"SELECT count(*) AS n FROM (SELECT {CANON} AS c FROM documents) WHERE c IN (SELECT {CANON} FROM benchmark)")
def overlap_benchmark(spark, d):
    other = read(spark, d, "benchmark").select(text.canonical("text").alias("c"))
    return read(spark, d, "documents").select(text.canonical("text").alias("c")).join(other, "c", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT source, lang, arg_min(doc_id, doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def pool_first_per_group(spark, d):
    rows = read(spark, d, "documents").select(F.concat_ws("|", "source", "lang").alias("g"), "source", "lang", "doc_id", "n_chars")
    return corpus.first_per_key(rows, "g", [F.col("doc_id")]).select("source", "lang", "doc_id", "n_chars")


@query(f"WITH {LAB}, r AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY sha256('7' || chr(0) || CAST(doc_id AS VARCHAR))) AS rn FROM lab) SELECT label, CASE WHEN rn <= 20 THEN 'clean_original' WHEN rn <= 30 THEN 'blindspot_raw' END AS part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM r WHERE rn <= 30 GROUP BY ALL")
def mix_603010(spark, d):
    t = corpus.take_ranges(keyed_labels(spark, d), "label", hashing.key(F.lit("7"), F.col("doc_id").cast("string")), {"clean_original": 20, "blindspot_raw": 10})
    return t.where("part is not null").groupBy("label", "part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(f"WITH {LAB} SELECT coalesce(source, 'ALL') AS source, coalesce(label, 'ALL') AS label, count(*) AS n FROM lab GROUP BY CUBE (source, label)")
def mix_marginals(spark, d):
    return keyed_labels(spark, d).cube("source", "label").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("ALL")).alias("source"), F.coalesce("label", F.lit("ALL")).alias("label"), "n")


@query(f"WITH {LAB} SELECT source, lang, label, count(*) AS n FROM lab GROUP BY GROUPING SETS ((source, label), (lang, label))")
def nested_counts(spark, d):
    return keyed_labels(spark, d).groupingSets([["source", "label"], ["lang", "label"]], "source", "lang", "label").agg(F.count("*").alias("n")).select("source", "lang", "label", "n")


# ---------------------------------------------------------------- metrics over scores

SCORE = f"sc AS (SELECT s AS system, doc_id, y, round(0.6 * {UNIT.format('s || chr(0) || CAST(doc_id AS VARCHAR)')} + CASE s WHEN 'base' THEN 0.2 ELSE 0.35 END * y, 3) AS p FROM labels0, (VALUES ('base'), ('full')) t(s))"
SC = "labels0 AS (SELECT doc_id, CAST(toxic AS INTEGER) AS y FROM labels), " + SCORE


def scored(spark, d):
    rows = read(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("y")).withColumn("system", F.explode(F.array(F.lit("base"), F.lit("full"))))
    gain = F.when(F.col("system") == "base", 0.2).otherwise(0.35)
    return rows.withColumn("p", F.round(F.lit(0.6) * hashing.unit("system", F.col("doc_id").cast("string")) + gain * F.col("y"), 3))


@query(f"WITH {SC}, x AS (SELECT system, y, CAST(p > 0.5 AS INTEGER) AS pred FROM sc) {_metric_sql('x', 'system')}")
def confusion_metrics(spark, d):
    return metrics.scores(scored(spark, d).withColumn("pred", (F.col("p") > 0.5).cast("int")).groupBy("system").agg(*metrics.confusion()))


@query(f"WITH {SC}, x AS (SELECT system, y, CASE WHEN doc_id % 11 = 0 THEN 1 - y ELSE CAST(p > 0.5 AS INTEGER) END AS pred FROM sc) {_metric_sql('x', 'system')}")
def invalid_as_wrong(spark, d):
    raw = scored(spark, d).withColumn("raw", F.when(F.col("doc_id") % 11 == 0, -1).otherwise((F.col("p") > 0.5).cast("int")))
    return metrics.scores(raw.withColumn("pred", metrics.invalid_as_wrong(F.col("raw"), F.col("y"))).groupBy("system").agg(*metrics.confusion()))


@query(f"WITH {SC}, x AS (SELECT system, y, CAST(p > 0.5 AS INTEGER) AS pred FROM sc) SELECT system, count(*) AS n, count(*) FILTER (y = 1) AS n_hate, round(count(*) FILTER (pred = 1) / count(*), 6) AS predicted_hate_rate FROM x GROUP BY system")
def predicted_rates(spark, d):
    counts = scored(spark, d).withColumn("pred", (F.col("p") > 0.5).cast("int")).groupBy("system").agg(*metrics.confusion())
    return metrics.rates(counts).select("system", "n", "n_hate", "predicted_hate_rate")


@query(f"WITH {SC} SELECT coalesce(system, 'overall') AS system, count(*) AS n, round(count(*) FILTER (doc_id % 11 = 0) / count(*), 6) AS invalid_rate FROM sc GROUP BY GROUPING SETS ((system), ())")
def invalid_generation_rate(spark, d):
    """Rows without a valid prediction, by system and overall."""
    raw = scored(spark, d).withColumn("raw", F.when(F.col("doc_id") % 11 == 0, -1).otherwise((F.col("p") > 0.5).cast("int")))
    n = raw.groupingSets([["system"], []], "system").agg(F.count("*").alias("n"), F.round(F.count_if(~F.col("raw").isin(0, 1)) / F.count("*"), 6).alias("invalid_rate"))
    return n.withColumn("system", F.coalesce("system", F.lit("overall")))


CURVE = "st AS (SELECT system, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sc GROUP BY system, p), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM st WINDOW w AS (PARTITION BY system ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {SC}, {CURVE} SELECT system, round(coalesce(sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0), 0), 6) AS average_precision FROM cu GROUP BY system")
def average_precision(spark, d):
    return metrics.average_precision(scored(spark, d), ["system"])


@query(f"WITH {SC}, {CURVE} SELECT system, round(sum(neg * (2 * tp - pos) / 2.0) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc FROM cu GROUP BY system")
def roc_auc(spark, d):
    return metrics.roc_auc(scored(spark, d), ["system"])


@query(f"WITH {SC}, {CURVE}, pc AS (SELECT *, tp / (tp + fp) AS pr, coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY system ORDER BY p DESC), 1.0) AS before FROM cu) SELECT system, round(coalesce(sum(pos * (pr + before) / 2) / nullif(sum(pos), 0), 0), 6) AS pr_auc FROM pc GROUP BY system")
def pr_auc(spark, d):
    return metrics.pr_area(scored(spark, d), ["system"])


@query(f"WITH {SC}, {CURVE}, al AS (SELECT system, sum(pos) AS p_all, sum(neg) AS n_all FROM cu GROUP BY system) SELECT system, p, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / nullif(p_all, 0), 6) AS tpr, round(fp / nullif(n_all, 0), 6) AS fpr FROM cu JOIN al USING (system)")
def curve_points(spark, d):
    """The points of the curve: a row for each distinct score."""
    c = metrics.curve(scored(spark, d), ["system"])
    total = lambda x: F.sum(x).over(W.partitionBy("system")).cast("double")
    return c.select("system", "p", "tp", "fp", F.round(F.try_divide(F.col("tp"), total("pos")), 6).alias("tpr"), F.round(F.try_divide(F.col("fp"), total("neg")), 6).alias("fpr"))


SWEEP = f"grid AS (SELECT round(0.01 + i * (0.98 / 199), 9) AS t FROM range(200) r(i)), sx AS (SELECT system, t, y, CAST(p > t AS INTEGER) AS pred FROM sc, grid), sw AS ({_metric_sql('sx', 'system, t')})"


@query(f"WITH {SC}, {SWEEP} SELECT system, t, f1 FROM sw QUALIFY row_number() OVER (PARTITION BY system ORDER BY f1 DESC, t) = 1")
def threshold_sweep(spark, d):
    return metrics.best_threshold(metrics.threshold_sweep(scored(spark, d), ["system"]), ["system"])


@query(f"WITH {SC}, {SWEEP}, b AS (SELECT system, t AS tuned FROM sw QUALIFY row_number() OVER (PARTITION BY system ORDER BY f1 DESC, t) = 1), x AS (SELECT system || ':' || k AS system, y, CAST(p > CASE k WHEN 'tuned' THEN tuned ELSE 0.5 END AS INTEGER) AS pred FROM sc JOIN b USING (system), (VALUES ('tuned'), ('default')) q(k)) {_metric_sql('x', 'system')}")
def tuned_vs_default(spark, d):
    s = scored(spark, d)
    best = metrics.best_threshold(metrics.threshold_sweep(s, ["system"]), ["system"]).select("system", F.col("t").alias("tuned"))
    x = s.join(F.broadcast(best), "system").withColumn("kind", F.explode(F.array(F.lit("tuned"), F.lit("default"))))  # best: a row for each system
    x = x.select(F.concat("system", F.lit(":"), "kind").alias("system"), "y", (F.col("p") > F.when(F.col("kind") == "tuned", F.col("tuned")).otherwise(0.5)).cast("int").alias("pred"))
    return metrics.scores(x.groupBy("system").agg(*metrics.confusion()))


@query(f"WITH {SC}, {SWEEP.replace('FROM sc, grid', 'FROM (SELECT * FROM sc WHERE doc_id % 5 = 0), grid')}, b AS (SELECT system, t AS threshold FROM sw WHERE system = 'full' QUALIFY row_number() OVER (PARTITION BY system ORDER BY f1 DESC, t) = 1), x AS (SELECT system, doc_id % 3 AS cond, threshold, y, CAST(p > coalesce(threshold, 0.5) AS INTEGER) AS pred FROM sc LEFT JOIN b USING (system) WHERE doc_id % 5 <> 0), m AS ({_metric_sql('x', 'system, cond, threshold')}) SELECT *, tp + fp + fn + tn AS n, tp + fn AS n_hate, round((tp + fp) / nullif(tp + fp + fn + tn, 0), 6) AS predicted_hate_rate, threshold IS NOT NULL AS tuned FROM m")
def report_matrix(spark, d):
    """Systems by conditions on the test fold; the threshold of one system is tuned on the validation fold, the other keeps the default."""
    s = scored(spark, d).withColumn("cond", F.col("doc_id") % 3)
    held = F.col("doc_id") % 5 == 0
    best = metrics.best_threshold(metrics.threshold_sweep(s.where(held), ["system"]), ["system"]).where(F.col("system") == "full")
    return metrics.report_matrix(s.where(~held), best, ["system", "cond"])


@query(f"WITH {SC}, j AS (SELECT a.y, CAST(a.p > 0.5 AS INTEGER) = a.y AS ra, CAST(b.p > 0.5 AS INTEGER) = b.y AS rb FROM sc a JOIN sc b USING (doc_id) WHERE a.system = 'base' AND b.system = 'full'), n AS (SELECT count(*) FILTER (ra AND NOT rb) AS b, count(*) FILTER (rb AND NOT ra) AS c FROM j) SELECT b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) END, 6) AS p FROM n")
def mcnemar_test(spark, d):
    s = scored(spark, d).withColumn("right", (F.col("p") > 0.5).cast("int") == F.col("y"))
    side = lambda n: s.where(F.col("system") == n).select("doc_id", F.col("right").alias(n))
    n = side("base").join(side("full"), "doc_id").agg(F.count_if(F.col("base") & ~F.col("full")).alias("b"), F.count_if(F.col("full") & ~F.col("base")).alias("c"))
    return n.select("b", "c", F.round(metrics.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query()
def bootstrap_interval(spark, d):
    counts = scored(spark, d).withColumn("pred", (F.col("p") > 0.5).cast("int")).groupBy("system").agg(*metrics.confusion())
    return metrics.bootstrap_f1(counts, ["system"])


@query(f"WITH {SC}, x AS (SELECT system, doc_id % 3 AS cond, y, CAST(p > 0.5 AS INTEGER) AS pred FROM sc), m AS ({_metric_sql('x', 'system, cond')}) SELECT system, max(f1) FILTER (cond = 0) AS c0, max(f1) FILTER (cond = 1) AS c1, max(f1) FILTER (cond = 2) AS c2, round(max(f1) FILTER (cond = 0) - max(f1) FILTER (cond = 1), 6) AS drop01 FROM m GROUP BY system")
def degradation_pivot(spark, d):
    x = scored(spark, d).withColumn("cond", F.col("doc_id") % 3).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    m = metrics.scores(x.groupBy("system", "cond").agg(*metrics.confusion()))
    p = m.groupBy("system").pivot("cond", [0, 1, 2]).agg(F.max("f1"))
    return p.select("system", F.col("0").alias("c0"), F.col("1").alias("c1"), F.col("2").alias("c2"), F.round(F.col("0") - F.col("1"), 6).alias("drop01"))


# ---------------------------------------------------------------- explanation

WORDS = r"regexp_extract_all(coalesce(text, ''), '\S+')"


def _turns(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.white_tokens("text").alias("words"))


_KEYS = ["the", "and", "of"]


@query(f"WITH m AS (SELECT conv_id, turn, list_transform({WORDS}, lambda w: CASE WHEN lower(w) IN ('the', 'and', 'of') THEN 1.0 ELSE 0.0 END) AS h FROM conversations) SELECT conv_id, turn, CAST(list_sum(h) AS DOUBLE) AS total, array_to_string(list_transform(range(1, len(h) + 1), lambda i: CAST(CAST(CASE WHEN i > 1 THEN h[i - 1] + h[i] + (h[i] + coalesce(h[i + 1], 0.0)) ELSE h[i] + coalesce(h[i + 1], 0.0) END AS INTEGER) AS VARCHAR)), ',') AS importance FROM m WHERE len(h) > 0")
def occlusion_importance(spark, d):
    imp = explain.occlusion(F.col("words"), explain.keyword_margin(_KEYS, 0.0), 2)
    hits = explain.keyword_margin(_KEYS, 0.0)
    return _turns(spark, d).where(F.size("words") > 0).select("conv_id", "turn", hits(F.col("words")).alias("total"), F.array_join(F.transform(imp, lambda v: v.cast("int").cast("string")), ",").alias("importance"))


@query(f"WITH m AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_sort(list_slice(list_transform(list_sort(list_transform(range(0, len(w)), lambda i: {{'v': -length(w[i + 1]), 'i': i}})), lambda x: x.i), 1, 3)), ',') AS top FROM m")
def topk_words(spark, d):
    lens = F.transform("words", lambda w: F.length(w).cast("double"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(F.transform(explain.top_words(lens, 3), lambda i: i.cast("string")), ",").alias("top"))


LOC = f"g AS (SELECT conv_id, turn, list_filter(range(0, len(w)), lambda i: length(w[i + 1]) >= 6) AS gold, list_filter(range(0, len(w)), lambda i: length(w[i + 1]) >= 5 AND i % 3 <> 0) AS pred FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations)), c AS (SELECT len(list_intersect(gold, pred)) AS tp, len(pred) - len(list_intersect(gold, pred)) AS fp, len(gold) - len(list_intersect(gold, pred)) AS fn FROM g)"


@query(f"WITH {LOC} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM c")
def localization_micro_macro(spark, d):
    ids = lambda ok: F.filter(F.transform("words", lambda w, i: F.when(ok(F.length(w), i), i)), lambda x: x.isNotNull())
    c = _turns(spark, d).select(*metrics.localisation(ids(lambda n, i: n >= 6), ids(lambda n, i: (n >= 5) & (i % 3 != 0))))
    f = F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg(f), 6).alias("macro_f1")).select("tp", "fp", "fn", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("micro_f1"), "macro_f1")


@query(f"WITH {LOC}, n AS (SELECT count(*) AS n_sentences, CAST(sum(len({WORDS})) AS BIGINT) AS total_words FROM conversations) SELECT n_sentences, total_words, CAST(sum(tp + fp) AS BIGINT) AS predicted_words, CAST(sum(tp + fn) AS BIGINT) AS gold_words, round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS micro_recall FROM c, n GROUP BY ALL")
def localization_counts(spark, d):
    ids = lambda ok: F.filter(F.transform("words", lambda w, i: F.when(ok(F.length(w), i), i)), lambda x: x.isNotNull())
    c = _turns(spark, d).select(F.size("words").alias("n"), *metrics.localisation(ids(lambda n, i: n >= 6), ids(lambda n, i: (n >= 5) & (i % 3 != 0))))
    share = lambda other, name: F.round(F.try_divide(F.sum("tp"), (F.sum("tp") + F.sum(other)).cast("double")), 6).alias(name)
    return c.agg(F.count("*").alias("n_sentences"), F.sum("n").alias("total_words"), (F.sum("tp") + F.sum("fp")).alias("predicted_words"), (F.sum("tp") + F.sum("fn")).alias("gold_words"), share("fp", "micro_precision"), share("fn", "micro_recall"))


SPAN = f"s AS (SELECT conv_id, turn, w, list_transform(range(1, len(w) + 1), lambda i: CAST(list_sum(list_transform(w[1:i], lambda x: length(x))) + i - 1 AS BIGINT)) AS e FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations))"


@query(f"WITH {SPAN} SELECT conv_id, turn, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN (e[i] - 1) // 7 * 7 >= e[i] - length(w[i]) THEN '1' ELSE '0' END), '') AS mask FROM s")
def span_mask(spark, d):
    """Every seventh character is marked."""
    chars = F.length(F.array_join("words", " "))
    marked = F.when(chars > 0, F.sequence(F.lit(0), chars - 1, F.lit(7))).otherwise(F.array().cast("array<int>"))
    return _turns(spark, d).select("conv_id", "turn", F.array_join(F.transform(explain.span_mask(F.col("words"), marked), lambda x: x.cast("string")), "").alias("mask"))


@query(f"SELECT conv_id, turn, md5(array_to_string(list_transform({WORDS}, lambda w: CASE WHEN length(w) >= 9 THEN '**' || w || '**' WHEN length(w) >= 5 THEN '*' || w || '*' ELSE w END), ' ')) AS rendered FROM conversations")
def highlight_render(spark, d):
    values = F.transform("words", lambda w: F.when(F.length(w) >= 9, 0.5).when(F.length(w) >= 7, 0.25).when(F.length(w) >= 5, 0.15).otherwise(0.0))
    return _turns(spark, d).select("conv_id", "turn", F.md5(text.highlight(F.col("words"), values, 0.15)).alias("rendered"))


@query(f"WITH v AS (SELECT length(x) AS n, count(*) FILTER (i % 3 = 0) AS g, count(*) FILTER (i % 3 <> 0) AS o FROM (SELECT unnest(w) AS x, unnest(range(0, len(w))) AS i FROM (SELECT {WORDS} AS w FROM conversations)) GROUP BY 1), t AS (SELECT unnest(range(1, 13)) AS t), k AS (SELECT t, coalesce(sum(g) FILTER (n >= t), 0) AS tp, coalesce(sum(o) FILTER (n >= t), 0) AS fp, coalesce(sum(g) FILTER (n < t), 0) AS fn FROM v, t GROUP BY t) SELECT t, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k")
def localization_sweep(spark, d):
    """Words of at least t letters are predicted; every third word is gold. Words are counted by length before they meet the twelve thresholds."""
    words = _turns(spark, d).select(F.posexplode("words").alias("i", "w")).groupBy(F.length("w").alias("n")).agg(F.count_if(F.col("i") % 3 == 0).alias("g"), F.count_if(F.col("i") % 3 != 0).alias("o"))
    at = words.crossJoin(F.broadcast(spark.range(1, 13).withColumnRenamed("id", "t")))
    part = lambda c, ok, name: F.sum(F.when(ok, F.col(c)).otherwise(F.lit(0))).alias(name)
    k = at.groupBy("t").agg(part("g", F.col("n") >= F.col("t"), "tp"), part("o", F.col("n") >= F.col("t"), "fp"), part("g", F.col("n") < F.col("t"), "fn"))
    return k.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)), 6))


# ---------------------------------------------------------------- variants of messages

#: A lexicon of these queries' own.
CHAT = obfuscate.Lexicon({"and": ("nd", "n"), "the": ("da", "tha"), "you": ("u", "ya"), "please": ("pls", "plz"), "thanks": ("thx", "ty"), "with": ("w",), "are": ("r",), "for": ("4",)}, "chat")


def _messages(spark, d):
    """sample_id, text, label, target_split: whole turns; the labels are drawn by hash."""
    m = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sample_id"), F.col("conv_id").cast("string").alias("duplicate_group_id"), F.col("role").alias("source_dataset"), "text")
    u = hashing.unit(F.lit("split"), F.col("duplicate_group_id"))
    return m.withColumns({"label": F.when(hashing.unit(F.col("sample_id")) < 0.3, "HATE").otherwise("CLEAN"), "target_split": F.when(u < 0.1, "test").when(u < 0.2, "validation").otherwise("train")})


@query()
def variant_controlled(spark, d):
    v = obfuscate.perturb(_messages(spark, d).withColumn("seed", obfuscate.seed_of(F.lit("42"), "sample_id")), "text", "label", "seed", CHAT)
    return v.select("sample_id", "seed", F.col("variant.perturbed_text").alias("perturbed_text"), F.array_join("variant.perturbation_types", ",").alias("types"), F.col("variant.perturbation_count").alias("n_edits"))


@query()
def edit_type_histogram(spark, d):
    """How often each kind of edit stands in the variants, and in how many of them."""
    v = obfuscate.perturb(_messages(spark, d).withColumn("seed", obfuscate.seed_of(F.lit("42"), "sample_id")), "text", "label", "seed", CHAT)
    return metrics.list_histogram(v.select(F.col("variant.perturbation_types").alias("types")), "types")


@query()
def variant_trace_replay(spark, d):
    """Traces that don't lead to their variant: none."""
    v = obfuscate.perturb(_messages(spark, d).withColumn("seed", obfuscate.seed_of(F.lit("42"), "sample_id")), "text", "label", "seed", CHAT).select("text", "variant.*")
    return v.agg(F.count("*").alias("n"), F.count("perturbed_text").alias("n_variants"), F.count_if(quality.replay(F.col("text"), F.col("perturbation_edits")) == F.col("perturbed_text")).alias("n_replayed"))


@query()
def variant_blind_spots(spark, d):
    v = obfuscate.blind_spots(_messages(spark, d).withColumn("seed", obfuscate.seed_of(F.lit("7"), "sample_id")), "text", "seed")
    return v.select("sample_id", F.col("variant.text").alias("variant"), F.array_join("variant.techniques", ",").alias("techniques"))


@query(f"SELECT conv_id, turn, md5(translate(text, 'aeiosgbAEIOSGB', '43105984310598')) AS digits, md5(translate(text, 'aeo', 'аео')) AS homoglyph, md5(translate(text, '{''.join(obfuscate.CYRILLIC)}', '{''.join(obfuscate.CYRILLIC.values())}')) AS cyrillic, md5(list_aggregate(list_transform(string_split(text, ''), lambda c: CASE WHEN c >= '!' AND c <= '~' AND length(c) = 1 AND ascii(c) < 127 THEN chr(ascii(c) + 65248) ELSE c END), 'string_agg', '')) AS fullwidth FROM conversations")
def variant_full_intensity(spark, d):
    t = F.col("text")
    each = {"digits": variants.lookalike_digits(t), "homoglyph": F.translate(t, "aeo", "аео"), "cyrillic": variants.cyrillic(t), "fullwidth": variants.fullwidth(t)}
    return read(spark, d, "conversations").select("conv_id", "turn", *[F.md5(v).alias(k) for k, v in each.items()])


@query("WITH c AS (SELECT conv_id, turn, text AS c0, translate(text, 'aeiosgbAEIOSGB', '43105984310598') AS c1, translate(text, 'aeo', 'аео') AS c2 FROM conversations WHERE text IS NOT NULL), u AS (UNPIVOT c ON c0, c1, c2 INTO NAME condition VALUE t) SELECT condition, count(*) AS n, count(DISTINCT conv_id || ':' || turn) AS n_rows, CAST(sum(length(t)) AS BIGINT) AS chars, count(DISTINCT md5(t)) AS n_texts FROM u GROUP BY condition")
def eval_pairs(spark, d):
    """Every message under three conditions, row by row the same ids: one scan, no join."""
    m = read(spark, d, "conversations").where("text is not null")
    t = F.col("text")
    long = m.select(F.concat_ws(":", "conv_id", "turn").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), v.alias("t")) for k, v in {"c0": t, "c1": variants.lookalike_digits(t), "c2": F.translate(t, "aeo", "аео")}.items()])).alias("x")).select("row_id", "x.*")
    return long.groupBy("condition").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_rows"), F.sum(F.length("t")).alias("chars"), F.count_distinct(F.md5("t")).alias("n_texts"))


def _augmented(spark, d):
    _checkpoint(spark)
    return _augment(_messages(spark, d))


def _targeted(m):
    """m with the lexicon's spans and whether a row is among the two fifths of its stratum that must have one replaced: up to the last of them in the order, so texts don't move."""
    m = m.withColumn("teencode_valid_span_count", obfuscate.valid_spans("text", "label", CHAT)).withColumn("teencode_eligible", F.col("teencode_valid_span_count") > 0)
    m, strata = table(m, "messages"), ["label", "target_split"]
    order = hashing.key(F.lit("quota"), "sample_id")
    last = corpus.exact_quota(m.where("teencode_eligible").select(*strata, order.alias("o")), strata, F.col("o"), 0.4).where("targeted").groupBy(*strata).agg(F.max("o").alias("last"))
    return m.join(F.broadcast(last), strata, "left").select(*m.columns, (F.col("teencode_eligible") & F.coalesce(order <= F.col("last"), F.lit(False))).alias("teencode_targeted"))  # last: a row for each stratum


def _augment(m):
    v = obfuscate.augment(_targeted(m), "sample_id", "text", "label", "target_split", "teencode_targeted", 42, CHAT).withColumnRenamed("text", "original_text")
    spans = F.size(F.filter(F.coalesce("perturbation_types", F.array().cast("array<string>")), lambda x: x == obfuscate.LEXICAL))
    return v.withColumns({"teencode_applied_span_count": spans, "teencode_applied": spans > 0, "label_mapped": F.col("label"), "annotation_type": F.lit("human")})


@query()
def augmented_corpus(spark, d):
    return _augmented(spark, d).select("sample_id", "label", "target_split", "teencode_targeted", "perturbed_text", F.array_join("perturbation_types", ",").alias("types"), "perturbation_mode", F.array_join("quality_flags", ",").alias("flags"))


@query()
def quality_gate(spark, d):
    """Violations by rule; rows without a variant show as empty outputs."""
    return quality.gate(_augmented(spark, d).checkpoint(), CHAT, exempt=tuple(obfuscate.PHRASES), rate=0.4).groupBy("rule").agg(F.count("*").alias("n"))


@query()
def human_review(spark, d):
    return quality.review_sample(_augmented(spark, d).checkpoint(), 60, 42).select("pick", "slot", "sample_id", "label", "target_split", "original_text", "perturbed_text")


@query()
def similarity_percentiles(spark, d):
    """Nearest-rank percentiles of the likeness of texts and variants, per label."""
    v = obfuscate.perturb(_messages(spark, d).withColumn("seed", obfuscate.seed_of(F.lit("42"), "sample_id")), "text", "label", "seed", CHAT)
    s = v.select("label", obfuscate.surface_similarity("text", F.col("variant.perturbed_text")).alias("s")).where("s is not null")
    return metrics.nearest_rank(s, ["label"], "s", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


# ---------------------------------------------------------------- dictionaries, quality, reports


EDGES = "[[:punct:]…（）【】]"
FACES = r"regexp_full_match({0}, '[:;)(DPpOo@=#>/\\|3<^~*]+') OR regexp_full_match({0}, '[:;=xX><]+[)(DPpOo3/\\|]+')"
DICT = rf"""p AS (SELECT text AS a, regexp_replace(regexp_replace(text, 'tion', 'sh', 'g'), 's(\W)', 'ss\1', 'g') AS b FROM documents), r AS (SELECT unnest(regexp_split_to_array(trim(a), '\s+')) AS o, unnest(regexp_split_to_array(trim(b), '\s+')) AS n FROM p),
c AS (SELECT lower(regexp_replace(regexp_replace(o, '^{EDGES}+', ''), '{EDGES}+$', '')) AS original, lower(regexp_replace(regexp_replace(n, '^{EDGES}+', ''), '{EDGES}+$', '')) AS normalized FROM r WHERE o <> n AND NOT ({FACES.format('o')} OR {FACES.format('n')})),
f AS (SELECT original, normalized, count(*) AS freq FROM c WHERE original <> normalized AND original <> '' AND normalized <> '' AND NOT (length(original) > length(normalized) AND right(original, 1) = right(left(original, -1), 1) AND rtrim(original, right(original, 1)) || right(original, 1) = normalized) GROUP BY ALL),
di AS (SELECT * FROM f WHERE freq >= 2 AND original NOT IN ('nation', 'station') QUALIFY row_number() OVER (PARTITION BY original ORDER BY freq DESC, normalized) = 1 AND freq >= 0.7 * sum(freq) OVER (PARTITION BY original))"""


def _dictionary(spark, d):
    changed = F.regexp_replace(F.regexp_replace("text", "tion", "sh"), r"s(\W)", "ss$1")
    pairs = read(spark, d, "documents").select(F.col("text").alias("a"), changed.alias("b"))
    return lexicon.induce_dictionary(lexicon.pair_frequency(pairs, "a", "b"), blocked=("nation", "station"))


@query(f"WITH {DICT} SELECT * FROM di")
def dictionary_induce(spark, d):
    return _dictionary(spark, d)


@query(f"WITH {DICT} SELECT least(length(original), 4) AS length, count(*) AS n FROM di GROUP BY 1")
def dictionary_lengths(spark, d):
    return lexicon.length_histogram(_dictionary(spark, d)).select(F.col("length").cast("long").alias("length"), "n")


@query("WITH e AS (SELECT DISTINCT trim(substr(p_name, 1, 4)) AS variant, trim(substr(p_name, 1, 6)) AS standard FROM part), c AS (SELECT lower(variant) AS k FROM e GROUP BY 1 HAVING count(DISTINCT lower(standard)) > 1), f AS (SELECT lower(variant) AS k, min(variant) AS first FROM e GROUP BY 1), v AS (SELECT DISTINCT lower(variant) AS v FROM e WHERE lower(variant) <> lower(standard)) SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN variant = '' OR standard = '' THEN 'empty' WHEN lower(variant) = lower(standard) THEN 'identity' WHEN lower(variant) IN (SELECT k FROM c) THEN 'dictionary_conflict' WHEN variant <> f.first THEN 'normalized_duplicate' WHEN lower(standard) IN (SELECT v FROM v) THEN 'chain' END AS reason FROM e JOIN f ON f.k = lower(variant)) GROUP BY 1")
def lexicon_compile(spark, d):
    entries = read(spark, d, "part").select(F.substring("p_name", 1, 4).alias("variant"), F.substring("p_name", 1, 6).alias("standard"))
    good, bad = lexicon.compile_lexicon(entries)
    ok = good.select(F.explode("variants"), F.lit("accepted").alias("reason")).select("reason")
    return ok.unionAll(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT source, CAST(n_chars AS DOUBLE) / 1000 AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, round(max(v) FILTER (i = round_even((n - 1) * 0.05, 0)), 6) AS p05, round(max(v) FILTER (i = round_even((n - 1) * 0.5, 0)), 6) AS p50, round(max(v) FILTER (i = round_even((n - 1) * 0.95, 0)), 6) AS p95 FROM r GROUP BY source")
def rank_percentiles(spark, d):
    return metrics.nearest_rank(read(spark, d, "documents").select("source", (F.col("n_chars") / 1000).alias("v")), ["source"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@query("SELECT sha256(string_agg(h, '' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id // 4096 AS b, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS h, count(*) AS n FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(0) || text || chr(0) || lang || chr(0) || source) AS h FROM documents) GROUP BY 1)")
def dataset_fingerprint(spark, d):
    """A tree of hashes: rows where they lie, then ranges of 4,096 ids, then the ranges in order."""
    rows = read(spark, d, "documents").select("doc_id", hashing.key(F.col("doc_id").cast("string"), "text", "lang", "source").alias("h"))
    joined = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), ""), 256)
    ranges = rows.groupBy(F.expr("doc_id div 4096").alias("b")).agg(joined("doc_id").alias("h"), F.count("*").alias("n"))
    return ranges.agg(joined("b").alias("fingerprint"), F.sum("n").alias("n"))


@query(f"SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END, CASE WHEN n_chars < 50 THEN 'short' END], lambda x: x IS NOT NULL)) AS rule FROM documents) GROUP BY rule")
def qa_violations(spark, d):
    rules = {"empty": F.trim("text") == "", "length": F.col("n_chars") != F.length("text"), "language": ~F.col("lang").isin("en", "fr"), "short": F.col("n_chars") < 50}
    hit = F.filter(F.array(*[F.when(c, r) for r, c in rules.items()]), lambda x: x.isNotNull())
    return read(spark, d, "documents").select(F.explode(hit).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query()
def message_scan(spark, d):
    return messages.scan(read(spark, d, "conversations"), ["the", "and"], {"ko": "không"}).select("conv_id", "turn", "label", F.round("confidence", 6).alias("confidence"), "flagged", "level")


# ---------------------------------------------------------------- relational surface


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    return read(spark, d, "lineitem").where("l_shipdate <= date'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_orders(spark, d):
    j = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY c_nationkey")
def customers_without_orders(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, CAST(sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE AS g FROM events)")
def event_sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w)) > F.expr("interval 30 minutes"), F.lit(False))
    return read(spark, d, "events").withColumn("g", gap.cast("int")).select("event_id", "user_id", F.sum("g").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("session"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    e = read(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "total")
