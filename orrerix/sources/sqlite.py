"""SQLite files as a Spark data source: read by ranges of row ids in many tasks, appended to by one commit.

``register(spark)`` makes the format ``sqlite`` known: options ``path`` and
``table``, for reading ``partitions`` and ``where``, conditions that go into the
statements that tasks send.  They are the reader's own because Spark 4.1 keeps
the filters pushed for one plan of a Python source for the later plans of the
same DataFrame, which then lack rows.  A write first stages a file for each task beside the
database; when all have ended one transaction takes their rows in, and when any
has failed none does.  The file must be one that driver and executors all see.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: A column, one of OPERATORS, and a value: none for a null test, a list for "in".
Condition = tuple[str, str, object]
OPERATORS = ("=", "<", "<=", ">", ">=", "in", "is null", "is not null")
#: Declared types of columns, and those that columns get.
_READ = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "BOOLEAN": T.BooleanType()}
_WRITTEN = {"long": "INTEGER", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _open(path: str, write: bool = False) -> contextlib.closing:
    """A connection; readers can't change or make a file."""
    path = path.removeprefix("file://")
    return contextlib.closing(sqlite3.connect(path, timeout=60, isolation_level=None) if write else sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=60))


@dataclass
class _Range(InputPartition):
    """Row ids from the one up to the other, which isn't in it; all rows without ids."""

    low: int | None
    high: int | None


@dataclass
class _Staged(WriterCommitMessage):
    file: str | None
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "8"))
        self.schema, self.conditions, self.values = schema, [], []
        for column, operator, value in json.loads(options.get("where", "[]")):
            if operator not in OPERATORS or column not in schema.names:
                raise ValueError(f"not a condition: {column} {operator}")
            values = list(value) if operator == "in" else [] if "null" in operator else [value]
            marks = f" ({', '.join('?' * len(values))})" if operator == "in" else " ?" * len(values)
            self.conditions.append(f"{_name(column)} {operator.upper()}{marks}")
            self.values += values

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]  # a table without row ids
        if low is None:
            return [_Range(0, 0)]
        n = max(1, min(self.parts, high - low + 1))
        edges = [low + (high + 1 - low) * k // n for k in range(n + 1)]
        return [_Range(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def statement(self, part: _Range) -> tuple[str, list]:
        conditions, values = list(self.conditions), list(self.values)
        if part.low is not None:
            conditions, values = ["rowid >= ?", "rowid < ?", *conditions], [part.low, part.high, *values]
        where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
        return f"SELECT {', '.join(_name(f.name) for f in self.schema.fields)} FROM {_name(self.table)}{where}", values

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        with _open(self.path) as db:
            rows = db.execute(*self.statement(partition))
            while some := rows.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([_column(c, f) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)


def _column(values: tuple, field: pa.Field) -> pa.Array:
    """Values of a column whose type SQLite doesn't insist on; what isn't of the declared type raises."""
    if pa.types.is_floating(field.type):
        values = tuple(None if v is None else float(v) for v in values)
    elif pa.types.is_boolean(field.type):
        values = tuple(None if v is None else bool(v) for v in values)
    return pa.array(values, field.type)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = options["path"].removeprefix("file://"), options["table"], schema, overwrite
        self.folder = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        task, n, sink = TaskContext.get(), 0, None
        file = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}.arrow"
        try:
            for batch in iterator:
                if sink is None:
                    os.makedirs(self.folder, exist_ok=True)
                    sink = pa.ipc.new_file(file, batch.schema)
                sink.write_batch(batch)
                n += batch.num_rows
        finally:
            if sink is not None:
                sink.close()
        return _Staged(file if sink is not None else None, n)

    def commit(self, messages: list[_Staged | None]) -> None:
        names = ", ".join(_name(f.name) for f in self.schema.fields)
        declared = ", ".join(f"{_name(f.name)} {_WRITTEN.get(f.dataType.simpleString(), 'TEXT')}" for f in self.schema.fields)
        try:
            with _open(self.path, write=True) as db:
                db.execute("BEGIN IMMEDIATE")
                try:
                    db.execute(f"CREATE TABLE IF NOT EXISTS {_name(self.table)} ({declared})")
                    if self.overwrite:
                        db.execute(f"DELETE FROM {_name(self.table)}")
                    for m in messages:
                        if m is not None and m.file is not None:
                            with pa.memory_map(m.file) as source, pa.ipc.open_file(source) as staged:
                                for k in range(staged.num_record_batches):
                                    columns = [_plain(c) for c in staged.get_batch(k).columns]
                                    db.executemany(f"INSERT INTO {_name(self.table)} ({names}) VALUES ({', '.join('?' * len(columns))})", zip(*columns, strict=True))
                    db.execute("COMMIT")
                except BaseException:
                    db.execute("ROLLBACK")
                    raise
        finally:
            self._clear()

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        # attempts that were lost left files without a message, so the folder goes as a whole
        shutil.rmtree(self.folder, ignore_errors=True)


def _plain(column: pa.Array) -> list:
    """What SQLite stores: numbers, text, bytes and nulls as they are, all else as text."""
    kind = column.type
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) or pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_null(kind):
        return column.to_pylist()
    return [None if v is None else str(v) for v in column.to_pylist()]


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with _open(self.options["path"]) as db:
            rows = db.execute(f"SELECT name, type FROM pragma_table_info({_text(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']!r} in {self.options['path']}")
        return T.StructType([T.StructField(name, _READ.get(kind.upper(), T.StringType())) for name, kind in rows])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), schema, overwrite)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SqliteSource)


def table(spark: SparkSession, path: str, name: str, where: Sequence[Condition] = (), partitions: int = 8, schema: str | None = None) -> DataFrame:
    """The rows of a table of a SQLite file that meet all conditions, read by ranges of row ids; columns and types are the declared ones unless a schema is given."""
    register(spark)
    reader = spark.read.format("sqlite").options(path=path, table=name, partitions=str(partitions), where=json.dumps([list(c) for c in where]))
    return (reader.schema(schema) if schema else reader).load()


def append(df: DataFrame, path: str, name: str, overwrite: bool = False) -> int:
    """All rows of ``df`` appended to a table of a SQLite file, made if it isn't there, in one transaction; how many.

    A failed write leaves the file as it was, and no staged files.  Decimals,
    dates, times and nested values become text.
    """
    register(df.sparkSession)
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"))
    observed.write.format("sqlite").mode("overwrite" if overwrite else "append").options(path=path, table=name).save()
    return seen.get["n"]


def staged(path: str) -> list[str]:
    """Folders of writes to a file that are under way, or were left by a driver that was lost."""
    return sorted(glob.glob(f"{glob.escape(path.removeprefix('file://'))}.staged-*"))
