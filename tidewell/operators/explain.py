"""Word importance by occlusion, top words and end-to-end message scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value worked out once for a row, which an expression named inside a lambda isn't."""
    return F.get(F.transform(F.array(value), f), 0)


def occlusion(words: Column, margin, window: int = 1) -> Column:
    """Importance of each word: the sum of the drops of margin(words) over the windows that cover it, cut at the end."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 1)
        rest = lambda s: F.concat(F.slice(w, F.lit(1), s), F.slice(w, s + window + 1, F.greatest(F.size(w) - s - window, F.lit(0))))
        cover = lambda drops, i: F.slice(drops, F.greatest(i - window + 2, F.lit(1)), F.least(F.lit(window), i + 1))
        drops = let(margin(w), lambda full: F.transform(at, lambda s: full - margin(rest(s))))
        return let(drops, lambda d: F.transform(at, lambda i: F.aggregate(cover(d, i), F.lit(0.0), lambda acc, x: acc + x)))

    return F.when(F.size(words) > 0, let(words, of)).otherwise(F.array().cast("array<double>"))


def peak(values: Column) -> Column:
    """Shares of the greatest value; all zero if that isn't positive."""
    return let(values, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.when(top > 0, x / top).otherwise(F.lit(0.0)))))


def top_words(values: Column, k: int) -> Column:
    """Indices of the k greatest values, ties to the first, in order of position."""
    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, k), lambda x: x["i"]))


def above(values: Column, threshold) -> Column:
    return F.filter(F.transform(values, lambda v, i: F.when(v >= threshold, i)), lambda x: x.isNotNull())


def keyword_margin(keywords: list[str], bias: float = 0.5):
    """A scorer of word arrays: hits among keywords less the bias."""
    listed = F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")
    return lambda words: F.size(F.filter(words, lambda w: F.array_contains(listed, F.lower(w)))).cast("double") - bias


def span_mask(words: Column, spans: Column) -> Column:
    """1 for each word that holds one of the character positions, words being joined by single spaces."""
    ends = F.aggregate(words, F.array().cast("array<int>"), lambda acc, w: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1) + 1, F.lit(0)) + F.length(w))))
    return F.zip_with(words, ends, lambda w, e: F.exists(spans, lambda i: (i >= e - F.length(w)) & (i < e)).cast("int"))
