"""Readers and writers with contracts. Schemas are fixed, never inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import canonical


def check_columns(df: DataFrame, expected: list[str], ordered: bool = False) -> DataFrame:
    have = df.columns
    if (have != expected) if ordered else (set(have) != set(expected)):
        raise ValueError(f"columns are {have}, expected {expected}")
    return df


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """free_text, label_id; quoted line breaks allowed, a bad label or header fails."""
    header = spark.read.option("encoding", "UTF-8").text(path).limit(1).first()
    names = (header[0].lstrip("﻿") if header else "").split(",")
    if names != ["free_text", "label_id"]:
        raise ValueError(f"header is {names}")
    return spark.read.schema("free_text string, label_id int").option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)


def weak_parquet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """texts, labels, probs and row_id `file:offset`."""
    df = check_columns(spark.read.parquet(*paths), ["texts", "labels", "probs"])
    at = F.concat(F.element_at(F.split("_metadata.file_path", "/"), -1), F.lit(":"), F.col("_metadata.row_index"))
    return df.select("texts", "labels", "probs", at.alias("row_id"))


def jsonl(spark: SparkSession, path: str, labels: list[str] | None = None, strict: bool = True) -> DataFrame:
    """text, label, source (default unknown). Blank lines are skipped. Other labels raise, or go if not strict."""
    df = spark.read.schema("text string, label string, source string").json(path).where("text is not null or label is not null").withColumn("source", F.coalesce("source", F.lit("unknown")))
    if labels is None:
        return df
    ok = F.coalesce(F.col("label").isin(labels), F.lit(False))
    return df.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))))) if strict else df.where(ok)


def index_spans(df: DataFrame, col: str) -> DataFrame:
    """spans array<int> from a literal list; a malformed one is empty and flagged."""
    parsed = F.from_json(F.col(col), "array<int>")
    return df.withColumn("spans", F.coalesce(parsed, F.array().cast("array<int>"))).withColumn("malformed", parsed.isNull())


def span_rows(spark: SparkSession, path: str) -> DataFrame:
    """words, span_mask, label: HATE rows with words and a marked one."""
    df = spark.read.schema("text string, words array<string>, span_mask array<int>, label string").json(path)
    return df.where((F.col("label") == "HATE") & (F.size("words") > 0) & F.exists("span_mask", lambda x: x != 0))


def score_table(spark: SparkSession, path: str) -> DataFrame:
    """system, condition, row_id, y, p: a row for each scored text, one JSON object a line."""
    return spark.read.schema("system string, condition string, row_id string, y int, p double").option("mode", "FAILFAST").json(path)


def dictionary_table(spark: SparkSession, path: str) -> DataFrame:
    """original, normalized of a file that holds one JSON object."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("original", "normalized"))


def aligned_pairs(spark: SparkSession, path: str) -> DataFrame:
    """original, normalized of a CSV with a header; rows without one of them go."""
    df = spark.read.schema("original string, normalized string").option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return df.where("original is not null and normalized is not null")


def report_cells(spark: SparkSession, path: str) -> DataFrame:
    """system, condition, metrics map<string,double> of a report with results by system and condition; what is no number is null."""
    schema = "results map<string,map<string,map<string,string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    rows = whole.select(F.explode("r.results").alias("system", "c")).select("system", F.explode("c").alias("condition", "m"))
    return rows.select("system", "condition", F.transform_values("m", lambda _, v: v.try_cast("double")).alias("metrics"))


def cached_selection(rows: DataFrame, pins: dict[str, str], source: str, text: str, label: str, expected: dict[str, int]) -> DataFrame:
    """The rows of a source from a selection made before. An error if a pinned column differs anywhere, a canonical text is empty
    or repeated, or a label's number isn't the expected one."""
    own = rows.where(F.col("source_dataset") == source)
    wrong = [F.count_if(~F.col(c).eqNullSafe(F.lit(v))).alias(f"{c} differs") for c, v in pins.items()]
    key = canonical(text)
    repeated = own.groupBy(key.alias("k")).count().agg(F.count_if((F.col("k") == "") | (F.col("count") > 1)).alias("empty or repeated texts"))
    found = own.agg(*wrong, F.lit(0).alias("__")).drop("__").first().asDict() | repeated.first().asDict()
    counts = {r[0]: r[1] for r in own.groupBy(label).count().limit(len(expected) + 1).collect()}
    bad = {k: v for k, v in found.items() if v}
    if bad or counts != expected:
        raise ValueError(f"selection is not as pinned: {bad}, rows {counts}, expected {expected}")
    return own


def bounded(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of an explicit order: a scan limit is the feature."""
    return df.orderBy(*order).limit(n)


def bounded_report(df: DataFrame, n: int) -> DataFrame:
    """One row: rows_scanned and scan_complete of a scan bounded to n rows."""
    return df.agg(F.least(F.count("*"), F.lit(n)).alias("rows_scanned"), (F.count("*") <= n).alias("scan_complete"))


def files_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes, lines (of .jsonl files; an unended last one counts) of the files of a folder.
    Spark's file source passes over files without a byte, so an empty one counts as absent."""
    content = F.decode("content", "ISO-8859-1")
    ended = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    lines = ended + F.when((content != "") & ~content.endswith("\n"), 1).otherwise(0)
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.when(name.endswith(".jsonl"), lines).alias("lines"))


def compare_checksums(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status for expected paths: MISSING, EXTRA (expected to be absent: sha256 null), OK or DIFFERENT."""
    j = expected.join(actual.select("path", F.col("sha256").alias("found")), "path", "left")
    return j.select("path", F.when(F.col("found").isNull(), "MISSING").when(F.col("sha256").isNull(), "EXTRA").when(F.col("found") == F.col("sha256"), "OK").otherwise("DIFFERENT").alias("status"))


def write_splits(df: DataFrame, path: str, split: str = "target_split", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(split).json(path)


def write_parquet(df: DataFrame, path: str, version: str, mode: str = "errorifexists") -> None:
    df.select(*[F.col(c).alias(c, metadata={"schema_version": version}) for c in df.columns]).write.mode(mode).option("compression", "zstd").parquet(path)


def write_rejected(df: DataFrame, path: str, reason: str = "reason", mode: str = "errorifexists") -> DataFrame:
    """Rows with a reason go to their own sink; the others are returned."""
    df.where(F.col(reason).isNotNull()).write.mode(mode).json(path)
    return df.where(F.col(reason).isNull()).drop(reason)


def write_projection(df: DataFrame, path: str, force: bool = False) -> None:
    """text, label as JSON lines; what is there stays unless force is given."""
    df.select("text", "label").write.mode("overwrite" if force else "errorifexists").json(path)


def _write_text(spark: SparkSession, value: str, path: str, mode: str) -> None:
    """One small text through Spark, so that any store it can write to will do."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode(mode).option("lineSep", "\n").text(path)


#: Rows of a report that the driver renders: systems by conditions, splits by labels.
REPORT_ROWS = 10_000


def report_rows(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_manifest(spark: SparkSession, parts: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> dict:
    """One JSON object with sorted keys: the rows of each aggregated table under its name. Returns it."""
    manifest = {name: sorted(report_rows(df), key=lambda r: json.dumps(r, sort_keys=True, default=str)) for name, df in parts.items()}
    _write_text(spark, json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True, default=str), path, mode)
    return manifest


def markdown_table(df: DataFrame) -> str:
    """A small table in Markdown; numbers with a fraction have four places, nulls a dash."""
    say = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["-"] * len(df.columns), *[[say(v) for v in r.values()] for r in report_rows(df)]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def dataset_card(title: str, about: str, tables: dict[str, DataFrame]) -> str:
    """A card in Markdown: a heading, a text, and a section for each aggregated table."""
    return "\n\n".join([f"# {title}", about, *[f"## {name}\n\n{markdown_table(df)}" for name, df in tables.items()]]) + "\n"


def write_card(spark: SparkSession, card: str, path: str, mode: str = "errorifexists") -> None:
    _write_text(spark, card, path, mode)


def write_review_csv(df: DataFrame, path: str, blank: list[str], mode: str = "errorifexists") -> None:
    """Arrays as JSON text, blank columns for reviewers."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested} | {c: F.lit("") for c in blank}).write.mode(mode).option("header", True).csv(path)
