"""SQL names for text and hash functions, so that spark.sql can call them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidewell.functions import hashing, text

#: Functions over Arrow, and SQL expressions of one text t.
ARROW = {"tw_nfc": text.nfc, "tw_fold": text.fold, "tw_plain_after_marked": text.plain_after_marked, "tw_blake2b_64": hashing.blake2b_64}
EXPRESSIONS = {
    "tw_separators": ("STRING", f"regexp_replace(t, r'(?<=[{text.LETTERS}])[{text.SEPARATORS}](?=[{text.LETTERS}])', '')"),
    "tw_elongation": ("STRING", rf"regexp_replace(t, r'([{text.LETTERS}])\1{{2,}}', '$1')"),
    "tw_tokens": ("ARRAY<STRING>", r"transform(regexp_extract_all(coalesce(t, ''), r'([\p{L}\p{Nl}\p{No}]+)', 1), x -> lower(x))"),
    "tw_key": ("STRING", "sha2(t, 256)"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Register every name for this session; the names."""
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    for name, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    return [*ARROW, *EXPRESSIONS]
