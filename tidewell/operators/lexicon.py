"""Keyword lists and dictionaries learned from corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.text import fold, tokens


def document_frequency(df: DataFrame, text: str = "text", y: str = "y") -> DataFrame:
    """word, hate_docs, docs: distinct words of each document."""
    return df.select(y, F.explode(F.array_distinct(tokens(text))).alias("word")).groupBy("word").agg(F.count_if(F.col(y) == 1).alias("hate_docs"), F.count("*").alias("docs"))


def induce_keywords(freq: DataFrame, min_count: int = 5, min_ratio: float = 0.75, top: int = 400) -> DataFrame:
    """The list is a top-k by its definition: (ratio, hate_docs, word) descending."""
    ratio = F.col("hate_docs") / F.col("docs")
    return freq.where((F.col("docs") >= min_count) & (ratio >= min_ratio)).withColumn("ratio", F.round(ratio, 6)).orderBy(F.desc(ratio), F.desc("hate_docs"), F.desc("word")).limit(top)


def flag_keywords(df: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with pred 1 where a token is in words (top-k rows, so broadcast)."""
    hit = df.select(key, F.explode(F.array_distinct(tokens(text))).alias("word")).join(F.broadcast(words.select("word")), "word", "left_semi").select(key).distinct()
    return df.join(hit.withColumn("hit", F.lit(1)), key, "left").withColumn("pred", F.coalesce("hit", F.lit(0))).drop("hit")


#: Signs cut from the ends of dictionary tokens, and the two shapes of emoticons.
CUT = r"[\p{Punct}…（）【】]"
EMOTICON_SIGNS = r"^[:;)(DPpOo@=#>/\\|3<^~*]+$"
EMOTICON_FACE = r"^[:;=xX><]+[)(DPpOo3/\\|]+$"


def is_emoticon(word: Column) -> Column:
    """Signs and letters of faces only, or eyes followed by a mouth."""
    return word.rlike(EMOTICON_SIGNS) | word.rlike(EMOTICON_FACE)


def is_elongated(original: Column, normalized: Column) -> Column:
    """The original repeats its last character, and with one of them it is the normal form."""
    return (normalized != "") & original.rlike(r"(?s)(.)\1$") & (F.regexp_replace(original, r"(?s)(.)\1+$", "$1") == normalized)


def differs_in_marks(original: Column, normalized: Column) -> Column:
    """Unequal, but equal without diacritics."""
    return (original != normalized) & (fold(original) == fold(normalized))


def pair_frequency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """original, normalized, freq of aligned tokens that differ, lower case and without signs at their ends.

    Only rows of equal token counts align. Emoticons and elongations are no pairs. A null text aligns with nothing.
    """
    x, y = F.split(F.trim(a), r"\s+"), F.split(F.trim(b), r"\s+")
    clean = lambda c: F.lower(F.regexp_replace(c, f"^{CUT}+|{CUT}+$", ""))
    words = pairs.where(F.size(x) == F.size(y)).select(F.explode(F.arrays_zip(x.alias("o"), y.alias("n"))).alias("p")).select("p.o", "p.n")
    words = words.where((F.col("o") != F.col("n")) & ~is_emoticon(F.col("o")) & ~is_emoticon(F.col("n")))
    rows = words.select(clean(F.col("o")).alias("original"), clean(F.col("n")).alias("normalized"))
    rows = rows.where((F.col("original") != F.col("normalized")) & (F.col("original") != "") & (F.col("normalized") != "") & ~is_elongated(F.col("original"), F.col("normalized")))
    return rows.groupBy("original", "normalized").agg(F.count("*").alias("freq"))


def induce_dictionary(freq: DataFrame, min_freq: int = 2, share: float = 0.7, blocked: tuple[str, ...] = ()) -> DataFrame:
    """The leading normal form of each token if it has `share` of the frequency, or is the only one; blocked originals have none."""
    w = W.partitionBy("original")
    kept = freq.where((F.col("freq") >= min_freq) & ~F.col("original").isin(*blocked)).withColumns({"total": F.sum("freq").over(w), "rn": F.row_number().over(w.orderBy(F.desc("freq"), "normalized"))})
    return kept.where((F.col("rn") == 1) & (F.col("freq") >= share * F.col("total"))).select("original", "normalized", "freq")


def length_histogram(dictionary: DataFrame) -> DataFrame:
    """length (4 stands for all from 4 on), n."""
    return dictionary.groupBy(F.least(F.length("original"), F.lit(4)).alias("length")).agg(F.count("*").alias("n"))


def compile_lexicon(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(standard, variants) and the rejected (variant, standard, reason) of a (variant, standard) table.

    Rejected in turn: empty or identical, several standards for a variant, chains (a standard that is a variant itself).
    """
    e = entries.select(F.trim("variant").alias("variant"), F.trim("standard").alias("standard")).distinct()
    many = e.groupBy(F.lower("variant").alias("k")).agg((F.countDistinct(F.lower("standard")) > 1).alias("conflict"), F.min("variant").alias("first"))
    chained = e.where(F.lower("variant") != F.lower("standard")).select(F.lower("variant").alias("v")).distinct()
    j = e.join(many, F.lower("variant") == F.col("k")).join(chained, F.lower("standard") == F.col("v"), "left")
    reason = F.when((F.col("variant") == "") | (F.col("standard") == ""), "empty").when(F.lower("variant") == F.lower("standard"), "identity").when(F.col("conflict"), "dictionary_conflict").when(F.col("variant") != F.col("first"), "normalized_duplicate").when(F.col("v").isNotNull(), "chain")
    j = j.withColumn("reason", reason)
    good = j.where("reason is null").groupBy("standard").agg(F.array_sort(F.collect_set("variant")).alias("variants"))
    return good, j.where("reason is not null").select("variant", "standard", "reason")
