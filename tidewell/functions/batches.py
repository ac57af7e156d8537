"""Row functions over Arrow batches, a slice of bounded bytes and rows at a time.

A batch of Spark holds up to 10,000 rows, whatever they weigh once they are Python objects. Here a worker holds the objects of one
slice only, and each slice's results leave before the next slice is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

#: Bytes of text and rows of one slice; a longer text makes a slice of its own.
BYTES, ROWS = 1 << 20, 512


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    n = len(columns[0])
    size = np.zeros(n, np.int64)
    for c in columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    end = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < n:
        b = min(n, a + ROWS, max(a + 1, int(np.searchsorted(end, end[a] + BYTES, "right")) - 1))
        yield tuple(c.slice(a, b - a) for c in columns)
        a = b


def column_udf(returns: str | DataType, build: Callable[[pa.DataType], Callable[..., pa.Array]], once: bool = False):
    """A UDF over columns. build gets the Arrow type to return, once in each worker, and gives a function of a slice's columns.

    once: the optimizer must not work it out again for a filter that stands above; for costly ones.
    """
    kind = _parse_datatype_string(returns) if isinstance(returns, str) else returns

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = build(to_arrow_type(kind))
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            if not len(columns[0]):
                yield pa.nulls(0, to_arrow_type(kind))
            for part in slices(columns):
                yield f(*part)

    made = F.arrow_udf(run, kind)
    return made.asNondeterministic() if once else made


def row_udf(returns: str | DataType, one: Callable, once: bool = False):
    """A UDF that works one row at a time; of a struct, one gives a tuple of its fields or None for nulls alone."""

    def build(arrow: pa.DataType) -> Callable[..., pa.Array]:
        if not pa.types.is_struct(arrow):
            return lambda *columns: pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns))], arrow)
        empty = (None,) * arrow.num_fields
        return lambda *columns: struct_array([one(*row) or empty for row in zip(*(c.to_pylist() for c in columns))], arrow)

    return column_udf(returns, build, once)


def struct_array(rows: list[tuple], arrow: pa.StructType) -> pa.Array:
    """Rows of fields, each field's values turned into an array at once."""
    columns = list(zip(*rows)) if rows else [()] * arrow.num_fields
    return pa.StructArray.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], fields=[arrow.field(i) for i in range(arrow.num_fields)])

