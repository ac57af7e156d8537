"""Tokens of public vocabularies, and exact token counts from a histogram of lengths.

Ids are those of the `tokenizers` file byte_bpe_50k.json with add_special_tokens=False.
The same vocabulary as ranks gives the same ids several times faster, so that library
does the work; a text that holds the special token's string goes to `tokenizers` itself.

Null text counts as empty: no tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPECIAL = "<|endoftext|>"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _plain(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def encode(text: str | None, json_path: str | None = None, ranks_path: str | None = None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    if SPECIAL in text:
        return np.array(_plain(json_path or public_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoder(ranks_path or public_path("byte_bpe_50k.tiktoken")).encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The other columns of docs and the number of tokens of the text."""
    kept = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in docs.columns if c not in (text, out)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]), f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(encode(t.as_py(), json_path, ranks_path)) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*batch.schema.names[1:], out])

    return kept.mapInArrow(run, schema)


def length_histogram(counted: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): one row for each length that occurs. Rows with a null length count as 0."""
    return counted.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = 256) -> DataFrame:
    """For each length L of a histogram, exactly:

    docs_at_most, tokens_at_most  documents of at most L tokens and their tokens,
    docs_longer, tokens_longer    the rest (suffix sums),
    truncated_tokens              what a context limit of L keeps: sum of min(length, L),
    quantile                      share of documents of at most L tokens.

    Sums run within blocks of lengths, then over the blocks' totals, so no task sorts the whole histogram.
    """
    h = hist.select("n_tokens", "n_docs", F.expr(f"n_tokens div {block}").alias("b"))
    down = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    after = h.groupBy("b").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = after.select("b", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_after"))
    total = h.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("all_tokens"))
    inside = W.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    longer = lambda x, rest: (F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(rest)).cast("long")
    out = h.join(after, "b").select("n_tokens", "n_docs", longer("n_docs", "d_after").alias("docs_longer"), longer(F.col("n_docs") * F.col("n_tokens"), "t_after").alias("tokens_longer"))
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.select(
        "n_tokens", "n_docs",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_at_most"), (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_at_most"),
        "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> Column | int:
    """Tokens kept under any context limit, from suffix_sums: a driver-side lookup of one row."""
    if limit <= 0:
        return 0
    row = sums.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).first()
    if row is None:
        first = sums.orderBy("n_tokens").first()
        return 0 if first is None else limit * (first["docs_longer"] + first["n_docs"])
    return row["tokens_at_most"] + row["docs_longer"] * limit


def length_quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents doesn't exceed."""
    row = sums.where(F.col("quantile") >= q).orderBy("n_tokens").first()
    return None if row is None else row["n_tokens"]
