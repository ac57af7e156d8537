"""Hashes that order and sample rows alike on every run and every partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.batches import row_udf


def key(*parts: Column | str) -> Column:
    """SHA-256 in hexadecimal of the parts, joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *[F.col(p) if isinstance(p, str) else p for p in parts]), 256)


def unit(*parts: Column | str) -> Column:
    """A double in [0, 1): the first 52 bits of key."""
    return F.conv(F.substring(key(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("sv_"), F.substring(key(*parts), 1, 24))


#: Hexadecimal, as signed numbers don't hold unsigned 64-bit seeds.
blake2b_64 = row_udf(T.StringType(), lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())
