"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset, a
temporary folder serves, but only for a local master: on a cluster such a
folder would exist on one machine alone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The paths that the innermost ``temporary_tables`` of this thread has to delete.
_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    folder = tempfile.mkdtemp(prefix="spark-demolake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing still to run reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after a failure, the tables that were written inside.

    Knows only what its own thread wrote, and of nested blocks each its own: calls in other threads lose nothing.
    """
    owned: list[str] = []
    token = _owned.set(owned)
    try:
        yield
    finally:
        _owned.reset(token)
        for path in owned:
            delete(spark, path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` once as Parquet in the shared folder; returns the table read back, and its path.

    Cuts the lineage: a lost executor costs only the tasks that read this table.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The table alone; see ``stored``."""
    return stored(df, name)[0]


#: About so many rows a task sorts at once.
AT_ONCE = 500_000


def spread(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same rows; many are dealt by ``by`` into so many partitions that each has about ``AT_ONCE``, as the session's number doesn't grow with the table.

    For windows over ``by`` one after another, whose sorts hold memory at the same time. Counts the rows first.
    """
    parts = -(-rows.count() // AT_ONCE)
    return rows.repartition(parts, *by) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
