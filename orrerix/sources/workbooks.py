"""Sheets of workbooks (.xlsx), a task's work for each file: rows are streamed from the file's XML on the executor.

Spark lists the files and hands each to a task; the header is the first row with
a token in a cell, wherever it stands in each file.  What the driver sees are the
names of columns.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str | None, otherwise: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else otherwise


def sheet_rows(book: zipfile.ZipFile, sheet: str) -> Iterator[dict[int, str]]:
    """The rows of a sheet one after the other, as column number -> text; empty cells are absent."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, item in ET.iterparse(book.open("xl/sharedStrings.xml")):
            if item.tag == f"{_MAIN}si":
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
                item.clear()
    target = next((s.get(f"{_REL}id") for s in ET.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet") if s.get("name") == sheet), None)
    if target is None:
        raise ValueError(f"no sheet {sheet!r}")
    files = {r.get("Id"): r.get("Target") for r in ET.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    for _, row in ET.iterparse(book.open("xl/" + files[target].removeprefix("/xl/"))):
        if row.tag != f"{_MAIN}row":
            continue
        cells = {}
        for k, cell in enumerate(row.iter(f"{_MAIN}c")):
            value = cell.find(f"{_MAIN}v")
            if cell.get("t") == "inlineStr":
                cells[_column(cell.get("r"), k)] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif value is not None and value.text is not None:
                cells[_column(cell.get("r"), k)] = shared[int(value.text)] if cell.get("t") == "s" else value.text
        yield cells
        row.clear()


def _headed(content: bytes, sheet: str, token: str) -> tuple[dict[int, str], Iterator[dict[int, str]]]:
    """The named columns of a sheet and the rows below its header."""
    rows = sheet_rows(zipfile.ZipFile(io.BytesIO(content)), sheet)
    for row in rows:
        if any(token in c for c in row.values()):
            return {k: v for k, v in sorted(row.items()) if v}, rows
    raise ValueError(f"no row of {sheet!r} holds {token!r}")


def workbooks(spark: SparkSession, paths: str | Sequence[str], sheet: str, token: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(path, row, the columns): all rows below the header of a sheet of every file, cells as text, missing ones null.

    ``paths`` are files, folders or patterns that Spark reads.  Without
    ``columns`` those of all headers, in the order in which names first stand in
    them; a file that lacks one has nulls.  Rows are numbered from the header
    on, empty ones are left out; a file without the sheet or the token raises.
    Columns named path or row need ``columns``, and so do repeated names.
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if columns is None:

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    names = list(_headed(content.as_py(), sheet, token)[0].values())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], ["path", "place", "name"])

        found = files.repartition(tasks, "path").mapInArrow(heads, "path string, place int, name string")
        again = found.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        columns = [r.name for r in found.groupBy("name").agg(F.min(F.struct("place", "path")).alias("first")).orderBy("first", "name").collect()]  # as many as columns
        if (again or 0) > 1 or {"path", "row"} & set(columns):
            raise ValueError(f"columns {columns} need other names")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), [pa.string(), pa.int64(), *[pa.string()] * len(columns)], strict=True)], schema.names)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, rows = _headed(content.as_py(), sheet, token)
                place, held = {v: k for k, v in reversed(names.items())}, []
                for n, row in enumerate(rows, 1):
                    if row:
                        held.append((path, n, *(row.get(place.get(c, -1)) for c in columns)))
                    if len(held) == 10_000:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    return files.repartition(tasks, "path").mapInArrow(read, schema)
