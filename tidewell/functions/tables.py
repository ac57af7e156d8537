"""Tables in the shared folder, which cut lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or what was set as checkpoint folder. Only a local session without one gets a folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidewell.shared.dir", None)
    if not path and (set_later := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        path = set_later.get()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("tidewell.shared.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back. A lost executor costs nothing that is behind it.

    The folder is removed by discard, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """A list of the tables that are written inside, for discard."""
    _open.append(made := [])
    try:
        yield made
    finally:
        _open[:] = [x for x in _open if x is not made]


def kept(df: DataFrame, made: list[DataFrame], name: str = "t") -> DataFrame:
    """df as a table, once the tables that it came from are removed."""
    out = table(df, name)
    discard(*(t for t in made if t is not out))
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that nothing still to be computed reads: what came of them must have been written."""
    drop(*tables)
    if tables:
        sweep(tables[0].sparkSession)


def drop(*tables: DataFrame) -> None:
    """discard without a look at what shuffles are left: for small tables in loops."""
    for t in tables:
        _remove(t.sparkSession, t.stored_at)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles no plan refers to any more; it removes their files meanwhile."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass
