"""Writing tables, and results kept by what they are computed from."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def parquet(df: DataFrame, path: str, single: bool = False, append: bool = False) -> None:
    """A Parquet set; ``single`` makes one file, for small tables that other programs read."""
    (df.coalesce(1) if single else df).write.mode("append" if append else "overwrite").parquet(path)


def parquet_if_any(df: DataFrame, path: str) -> bool:
    """Write unless there is no row; whether it was written."""
    if df.isEmpty():
        return False
    parquet(df, path)
    return True


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled inside quoted fields; arrays must be made text before."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def vector_index(df: DataFrame, path: str, uri: str = "uri", embedding: str = "embedding") -> None:
    """(index, uri, embedding) of normalised vectors; the index is a stable number, not a position."""
    rows = df.where(F.col(embedding).isNotNull()).select(F.xxhash64(uri, embedding).alias("index"), F.col(uri).cast("string").alias(uri), F.transform(vector.normalised(F.col(embedding)), lambda x: x.cast("float")).alias(embedding))
    parquet(rows.where(F.col(embedding).isNotNull()), path)


def table(df: DataFrame, name: str, *bucket_by: str, buckets: int = 0) -> None:
    """A table of the catalog, bucketed by keys that later joins share, so that these need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(name)


def sql_append(df: DataFrame, url: str, name: str, writers: int = 8, **options: str) -> None:
    """Rows appended to a database's table by so many tasks at a time; its driver must be on the class path. Repeated rows are averaged by readers."""
    df.coalesce(writers).write.format("jdbc").mode("append").options(url=url, dbtable=name, **options).save()


def sqlite_append(df: DataFrame, path: str, name: str) -> int:
    """Rows appended to a table of a SQLite file, made if it isn't there: all of them in one transaction, or none. How many."""
    from . import sqlite

    return sqlite.append(df, path, name)


def load_vector_index(spark: SparkSession, path: str) -> DataFrame:
    """(index, uri, embedding) as ``vector_index`` wrote them."""
    return spark.read.schema("index long, uri string, embedding array<float>").parquet(path)


def memo_key(df: DataFrame) -> str:
    """A key of what a table is computed from: its plan in canonical form, columns and, of files it reads, their paths, sizes and times.

    The hash alone has 32 bits; the plan's text, with all of its fields, tells
    apart what it takes for one.
    """
    spark, fields = df.sparkSession, "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(fields)
    spark.conf.set(fields, str(2**31 - 1))
    try:
        plan = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        spark.conf.set(fields, before)
    parts = [str(df.semanticHash()), plan, str(df.schema)]
    for path in sorted(df.inputFiles()):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
        parts.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(parts).encode()).hexdigest()


def memo(df: DataFrame, folder: str, refresh: bool = False) -> DataFrame:
    """The rows of ``df`` as they were kept for the same plan over the same files, or computed and kept now."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{memo_key(df)}.parquet"
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)
