"""A corpus pipeline of five training-data operators over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents.

language   documents without a letter, or without a language model to judge them, go
dedup      one document of each near-duplicate group stays (the least doc_id)
benchmark  documents that hold a benchmark item go
secrets    spans found are replaced by [SECRET]; n_chars follows the text
pack       what is left is cut, tokenized and packed into sequences of 1,024 tokens

Rows with a null doc_id pass the filters: nothing can be said of them by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, langid, minhash, packing, secrets
from tidewell.llm.common import read, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identify(docs.select(*COLUMNS)).where("lang_pred <> 'und'").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    # rows that repeat a doc_id are one document: the least by text and the other columns stays
    named = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return named.join(gone, "doc_id", "left_anti").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(docs.select(*COLUMNS), redacted="clean")
    hit = F.size("spans") > 0
    return found.select("doc_id", F.when(hit, F.col("clean")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(hit, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, 1024)


STAGES = [("language", language), ("dedup", dedup), ("benchmark", benchmark), ("secrets", redact), ("pack", pack)]

#: Several stages are learned or probabilistic by method; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
