"""SQLite as a data source: ranges in several tasks, filters in the statement, and all rows of a write or none."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from orrerix.sources import sqlite


@pytest.fixture
def file(tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "my table" (k INTEGER, v REAL, t TEXT, b BOOLEAN, "odd ""name" TEXT)')
        db.executemany('INSERT INTO "my table" VALUES (?, ?, ?, ?, ?)', [(i, i / 2 if i % 3 else None, f"t{i % 5}", i % 2, None) for i in range(1000)])
    return path


def test_ranges_are_read_in_several_tasks(spark, file):
    df = sqlite.table(spark, file, "my table", partitions=4)
    assert df.dtypes == [("k", "bigint"), ("v", "double"), ("t", "string"), ("b", "boolean"), ('odd "name', "string")]
    assert df.select(F.spark_partition_id().alias("p"), "k").groupBy("p").count().where("count = 250").count() == 4
    rows = {r.k: r for r in df.collect()}
    assert set(rows) == set(range(1000)) and rows[7].v == 3.5 and rows[3].v is None and rows[7].b is True and rows[9].t == "t4"
    with sqlite3.connect(file) as db:
        db.execute("CREATE TABLE w (k INTEGER PRIMARY KEY, t TEXT) WITHOUT ROWID")
        db.execute("INSERT INTO w VALUES (5, 'x')")
        db.execute("CREATE TABLE none (k INTEGER)")
    assert [tuple(r) for r in sqlite.table(spark, file, "w").collect()] == [(5, "x")]
    assert sqlite.table(spark, file, "none").collect() == []
    with pytest.raises(Exception, match="no table"):
        sqlite.table(spark, file, "absent").collect()


def test_conditions_are_in_the_statement(spark, file):
    conditions = [("t", "=", "t1"), ("k", ">", 10), ("k", "in", [11, 16]), ("v", "is not null", None)]
    source = sqlite.SqliteSource({"path": file, "table": "my table", "where": json.dumps(conditions)})
    text, values = source.reader(source.schema()).statement(sqlite._Range(1, 9))
    assert text.endswith('WHERE rowid >= ? AND rowid < ? AND "t" = ? AND "k" > ? AND "k" IN (?, ?) AND "v" IS NOT NULL') and values == [1, 9, "t1", 10, 11, 16]
    assert [r.k for r in sqlite.table(spark, file, "my table", conditions).orderBy("k").collect()] == [11, 16]
    # a row that can't be read is never asked for
    with sqlite3.connect(file) as db:
        db.execute("INSERT INTO \"my table\" VALUES (5000, 'not a number', 'bad', 0, NULL)")
    assert sqlite.table(spark, file, "my table", [("k", "<", 1000)]).where("t = 't1'").count() == 200
    with pytest.raises(Exception, match="could not convert"):
        sqlite.table(spark, file, "my table").collect()
    with pytest.raises(Exception, match="not a condition"):
        sqlite.table(spark, file, "my table", [("k", "; DROP", 1)]).collect()


def test_plans_of_one_table_share_no_filter(spark, file):
    """Spark's own pushdown of filters leaks from one plan to the next, so it is off; this holds what follows from that."""
    df = sqlite.table(spark, file, "my table")
    assert [df.where("k < 10").count(), df.count(), df.where("k < 10").unionAll(df.where("k >= 990")).count()] == [10, 1000, 20]


def test_a_failed_write_leaves_nothing(spark, file):
    def some(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield batch
        if TaskContext.get().partitionId() == 3:
            raise RuntimeError("killed")

    df = spark.range(400).select(F.col("id").alias("k"), F.col("id").cast("string").alias("t")).repartition(4)
    with pytest.raises(Exception, match="killed"):
        sqlite.append(df.mapInArrow(some, "k long, t string"), file, "my table")
    with sqlite3.connect(file) as db:
        assert db.execute('SELECT count(*) FROM "my table"').fetchone() == (1000,)
    assert sqlite.staged(file) == []
    assert sqlite.append(df, file, "my table") == 400 and sqlite.staged(file) == []
    with sqlite3.connect(file) as db:
        assert db.execute('SELECT count(*), count(v) FROM "my table"').fetchone() == (1400, 666)
    wrong = spark.range(5).withColumnRenamed("id", "no such column")
    with pytest.raises(Exception, match="no column"):
        sqlite.append(wrong, file, "my table")
    assert sqlite.staged(file) == [] and sqlite.append(df.limit(0), file, "my table") == 0


def test_types_overwriting_and_a_new_table(spark, tmp_path):
    path = str(tmp_path / "n.sqlite")
    df = spark.createDataFrame([(1, 2.5, True, "x", bytearray(b"\x00y")), (None, None, None, None, None)], "a long, b double, c boolean, d string, e binary").withColumn("day", F.lit("2024-01-02").cast("date"))
    assert sqlite.append(df, path, "t") == sqlite.append(df, path, "t") == 2
    assert sqlite.append(df, path, "t", overwrite=True) == 2
    got = sqlite.table(spark, path, "t").orderBy(F.col("a").desc_nulls_last()).collect()
    assert [tuple(r) for r in got] == [(1, 2.5, True, "x", bytearray(b"\x00y"), "2024-01-02"), (None, None, None, None, None, "2024-01-02")]
