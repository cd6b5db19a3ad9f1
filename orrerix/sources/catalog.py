"""Datasets by name, and files found by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbooks import workbooks


@dataclass(frozen=True)
class Catalog:
    """Parquet tables below one folder, by any path that Spark reads."""

    spark: SparkSession
    folder: str

    def table(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*columns) if columns else df

    def register(self, *names: str) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(name)


def files(spark: SparkSession, folder: str, pattern: str, holding: str = "") -> DataFrame:
    """(path) of files anywhere below a folder whose name fits a glob pattern and holds a text, in order."""
    # with nothing but the path asked for, Spark doesn't open the files
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    return found.where(F.contains(F.element_at(F.split("path", "/"), -1), F.lit(holding))).orderBy("path")


def concatenated(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of several Parquet sets, by column name; columns that one lacks are null."""
    made = None
    for path in paths:
        df = spark.read.parquet(path)
        made = df if made is None else made.unionByName(df, allowMissingColumns=True)
    if made is None:
        raise ValueError("no paths")
    return made


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a declared schema, quotes doubled inside quoted fields."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


#: Rows that a reader on the driver takes at most.
MOST_ROWS = 1_000_000


def sqlite(spark: SparkSession, path: str, query: str, schema: str, args: tuple = (), most: int = MOST_ROWS) -> DataFrame:
    """A query of a local SQLite file, run on the driver: for small dimension tables, and an error beyond ``most`` rows."""
    import contextlib
    import sqlite3

    with contextlib.closing(sqlite3.connect(path)) as db:
        rows = db.execute(query, args).fetchmany(most + 1)
    return spark.createDataFrame(_few(rows, most), schema)


def _few(rows: list, most: int) -> list:
    if len(rows) > most:
        raise ValueError(f"more than {most} rows on the driver; export the table to files instead")
    return rows


def headed_text(spark: SparkSession, path: str, token: str, separator: str = ",") -> DataFrame:
    """A delimited text whose header is the first line that holds ``token``, case and all; every column is text.

    Blank fields stay empty strings; lines before the header are left out.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    first = lines.where(F.contains("value", F.lit(token))).orderBy("line").first()
    if first is None:
        raise ValueError(f"no line holds {token!r}")
    names = [n.strip() for n in first.value.split(separator)]
    parts = F.split("value", f"\\Q{separator}\\E", -1)
    return lines.where((F.col("line") > first.line) & (F.trim("value") != "")).select(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def excel_sheet(spark: SparkSession, path: str, sheet: str, token: str, most: int = MOST_ROWS) -> DataFrame:
    """A sheet of one workbook as ``workbooks`` reads it, without path and row; an error where it can't be read or has more than ``most`` rows below its header."""
    made = workbooks(spark, path, sheet, token)
    try:
        n = made.limit(most + 1).count()
    except Exception as e:
        raise ValueError(str(e)[:500]) from e
    if n > most:
        raise ValueError(f"more than {most} rows")
    return made.drop("path", "row")


def json_list(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The records of a list in a JSON document, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("record")).select("record.*")
