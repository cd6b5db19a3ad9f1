"""Tables written to the folder that driver and executors share: where lineage is cut, and what is read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of stored tables that nobody has discarded, in this process.
_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one on a single machine and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orrerix-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy", row_group: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and any executor can read it.

    ``codec`` zstd is for large tables that are kept a while; ``row_group`` is
    the size of a row group in bytes, for sorted tables of which parts are read.
    ``discard`` deletes a table once nothing reads it any more, ``clear`` whatever
    is left when the results have been written.
    """
    spark = df.sparkSession
    at = path(spark, name)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(at, compression=codec)
    made = spark.read.schema(df.schema).parquet(at)
    made.orrerix_path = at
    _KEPT[at] = spark
    return made


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no result reads; other DataFrames are left alone."""
    for df in tables:
        _delete(df.sparkSession, getattr(df, "orrerix_path", None))


def clear(spark: SparkSession) -> int:
    """Delete every stored table of this session that is left, and say how many: for a caller that has written its results."""
    paths = [p for p, of in _KEPT.items() if of is spark]
    for p in paths:
        _delete(spark, p)
    return len(paths)


def _delete(spark: SparkSession, at: str | None) -> None:
    if at and _KEPT.pop(at, None):
        # the session's own file systems: PySpark has no other way to them
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
