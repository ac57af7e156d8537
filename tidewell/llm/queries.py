"""The thin queries op1 to op10: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import ann, decontaminate, langid, lmscore, minhash, packing, repeats, secrets, sharding, tokens
from tidewell.llm.common import read, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), n_words=3, threshold=(85, 100))


def op2_shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 16)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), 1024)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(read(spark, sf_dir, "documents"))


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and how much of a document lies in passages of over 50 words that another document holds too."""
    cut = repeats.remove_repeats(read(spark, sf_dir, "documents"), 400, min_words=51)
    shared = F.aggregate("passages", F.lit(0), lambda n, x: n + x["e"] - x["s"]).cast("long")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.size("passages").cast("long").alias("n_passages"), shared.alias("passage_bytes"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each encoded length, with sums on both sides of it."""
    hist = tokens.length_histogram(tokens.token_counts(read(spark, sf_dir, "documents").select("text")))
    return tokens.suffix_sums(table(hist, "lengths"))  # written, as the sums read it more than once


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(read(spark, sf_dir, "documents")).drop("bits_per_byte")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_shard_balance, op3_language_id, op4_pack_sequences, op5_secret_scan, op6_repeat_removal, op7_decontaminate, op8_token_counts, op9_lm_score, op10_nearest_neighbours)}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Where SQL can state a query's rows. The others are tested against brute force in tests/llm.
SQL = {
    # exact sets, exact links through an inverted index, least label by recursion over links
    "op1_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
f AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS to_id FROM n UNION SELECT r.d, e.v FROM r JOIN e ON r.to_id = e.u),
k AS (SELECT d, min(to_id) AS component_id FROM r GROUP BY d)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN k ON k.d = n.doc_id
""",
}
