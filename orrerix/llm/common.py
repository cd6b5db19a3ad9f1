"""What the operators share: reading tables, the shared scratch folder, record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import clear, discard, shared_dir, stored
from ..scratch import path as scratch

__all__ = ["by_batch", "clear", "discard", "in_arrow", "partitions", "scratch", "shared_dir", "sliced", "stored", "table", "text_or_empty"]

#: Bytes of a record batch that an operator works on at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded size, whatever the session sends; a row that is larger goes alone."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = batch.num_rows - at
            while n > 1 and batch.slice(at, n).nbytes > BATCH_BYTES:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` over batches of a bounded size."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(sliced(batches))

    return df.mapInArrow(bounded, schema)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function of one record batch to the iterator that ``mapInArrow`` wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield from made.to_batches() if isinstance(made, pa.Table) else [made]

    return run
