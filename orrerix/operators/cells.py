"""A stored vector index that is searched without being read whole.

Vectors are written by cell: the cell of the nearest of a set of centres, with
each cell's radius beside its centre.  No inner product of a vector q with a
member of a cell exceeds q . centre + |q| radius, so a search

1. looks into the cells with the largest such bounds until these hold enough
   vectors, which gives each query a k-th best similarity to beat;
2. looks into the other cells whose bound reaches that.

All other cells aren't read: the cell is the partition of the stored table.  The
results are those of a search of the whole table, whatever the centres are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, stored
from .relational import top_per_group
from .similarity import BLOCK, _best_pairs

#: Cells at most, bytes of the sample that centres are fitted to, and of queries that are broadcast.
MOST_CELLS, SAMPLE_BYTES, BROADCAST_BYTES = 1024, 32 << 20, 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T)


def _fitted(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample by the means of its nearest rows; empty ones go."""
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)] if len(sample) else sample
    for _ in range(rounds):
        if not len(centres):
            break
        near = _squares(sample, centres).argmin(axis=1)
        centres = np.array([sample[near == k].mean(axis=0) for k in np.unique(near)])
    return centres


def _bounds(x: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest inner product that each vector can have in each cell."""
    size = np.linalg.norm(x, axis=1)[:, None]
    return x @ centres.T + size * radius[None, :] * (1 + 1e-9) + 1e-9 * (1 + size)


def _first(bounds: np.ndarray, n: np.ndarray, need: int) -> np.ndarray:
    """Whether a cell, of n vectors, is among those with the largest bounds that together hold so many."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    chosen = np.zeros(bounds.shape, bool)
    np.put_along_axis(chosen, order, before < need, axis=1)
    return chosen


class Cells:
    """An index at ``path``: its columns with a ``cell``, and the cells (cell, n, radius, centre)."""

    def __init__(self, spark: SparkSession, path: str, embedding: str = "embedding"):
        schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()[0]))
        self.vectors, self.embedding = spark.read.schema(schema).parquet(f"{path}/vectors"), embedding
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS rows
        self.ids = np.array([r.cell for r in rows], int)
        self.n, self.radius = np.array([r.n for r in rows], int), np.array([r.radius for r in rows], float)
        self.centres = np.array([r.centre for r in rows], float)
        #: Cells that the last search read.
        self.read: set[int] = set()

    @classmethod
    def build(cls, vectors: DataFrame, path: str, embedding: str = "embedding", cells: int | None = None) -> Cells:
        """Write ``vectors`` by cell and open them; rows without a vector are left out, all vectors have one width.

        Without ``cells`` about as many as half the root of the rows, MOST_CELLS at most.
        """
        spark = vectors.sparkSession
        rows = vectors.where(F.col(embedding).isNotNull())
        n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(embedding)), F.lit(1))).first()
        wanted = min(MOST_CELLS, cells or max(1, int(n**0.5 / 2)))
        # a bounded sample, drawn by the hash of the vectors, by which results don't change
        sample = rows.select(embedding).orderBy(F.xxhash64(embedding)).limit(max(1, min(64 * wanted, SAMPLE_BYTES // (8 * max(1, width))))).collect()
        centres = _fitted(np.array([r[0] for r in sample], float).reshape(len(sample), width), wanted)
        at = rows.columns.index(embedding)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    d = _squares(_matrix(part.column(at)), centres)
                    cell = d.argmin(axis=1)
                    # the distance itself, not the root of a difference: the radius is a bound
                    away = np.linalg.norm(_matrix(part.column(at)) - centres[cell], axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*part.schema.names, "cell", "away of row"])

        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away of row", T.DoubleType())])
        # adaptive execution splits a cell with many rows into several files and puts small ones together
        rows.mapInArrow(run, schema).hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
        found = {r.cell: (r.n, r.radius) for r in spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away of row").alias("radius")).collect()}
        table = [(k, *found[k], centres[k].tolist()) for k in sorted(found)]
        spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
        spark.createDataFrame(table, "cell int, n long, radius double, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path, embedding)

    def _probes(self, asked: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """(cell, names a, matrix a): blocks of queries for each cell that they look into; ``chosen`` says which by bounds and the third column."""
        ids, centres, radius = self.ids, self.centres, self.radius

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if len(ids) else ():
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    x = _matrix(part.column(1))
                    for cell, rows in enumerate(chosen(_bounds(x, centres, radius), part.column(2).to_numpy(zero_copy_only=False).astype(float)).T):
                        if rows.any():
                            own = np.flatnonzero(rows)
                            names = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(0).take(pa.array(own)))
                            yield pa.record_batch([pa.array([ids[cell]], pa.int32()), names, pa.array([x[own].tobytes()], pa.binary())], names=["cell", "names a", "matrix a"])

        kind = T.ArrayType(asked.schema[0].dataType)
        return stored(asked.mapInArrow(run, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("names a", kind), T.StructField("matrix a", T.BinaryType())])), "probes")

    def _blocks(self, cells: list[int], target: str) -> DataFrame:
        """(cell, names b, matrix b) of the cells, whose files alone are read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell):
                    own = np.flatnonzero(cell == c)
                    for start in range(0, len(own), BLOCK):
                        part = batch.take(pa.array(own[start : start + BLOCK]))
                        names = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                        yield pa.record_batch([pa.array([c], pa.int32()), names, pa.array([_matrix(part.column(1)).tobytes()], pa.binary())], names=["cell", "names b", "matrix b"])

        rows = self.vectors.where(F.col("cell").isin(cells)).select(target, self.embedding, "cell")
        return rows.mapInArrow(run, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("names b", T.ArrayType(rows.schema[0].dataType)), T.StructField("matrix b", T.BinaryType())]))

    def _met(self, probes: DataFrame, target: str, above: float | None, k: int | None) -> DataFrame:
        """(source, target, similarity): the best pairs of the probes' blocks with their cells', for each pair of blocks."""
        known = probes.groupBy("cell").agg(F.sum(F.length("matrix a")).alias("bytes")).collect()  # a row for each cell
        self.read |= {r.cell for r in known}
        blocks = self._blocks([r.cell for r in known], target)
        asked = F.broadcast(probes) if sum(r.bytes for r in known) <= BROADCAST_BYTES else probes
        kinds = [T.StructField(n, x.schema[c].dataType.elementType) for n, x, c in (("source", probes, "names a"), ("target", blocks, "names b"))]
        pairs = blocks.join(asked, "cell").select("names a", "matrix a", "names b", "matrix b")
        found = pairs.mapInArrow(_best_pairs(above, k), T.StructType([*kinds, T.StructField("similarity", T.DoubleType())]))
        return found.groupBy("source", "target").agg(F.max("similarity").alias("similarity"))

    def above(self, asked: DataFrame, least: float, target: str = "index") -> DataFrame:
        """(source, target, similarity): for asked(source, embedding) all targets with a similarity larger than ``least``, the best of their vectors."""
        self.read = set()
        queries = asked.where("embedding is not null").select("source", "embedding", F.lit(least).alias("least"))
        return self._met(self._probes(queries, lambda bounds, floor: bounds > floor[:, None]), target, least, None)

    def nearest(self, asked: DataFrame, k: int, target: str = "index", least: float | None = None) -> DataFrame:
        """(source, target, similarity): for asked(source, embedding) the k targets with the largest similarity, larger than ``least``, ties by target.

        A source may have several vectors and so may a target (column ``target``
        of the index): the best of their pairs counts.  Null queries find nothing.
        """
        self.read, n = set(), self.n
        queries = asked.where("embedding is not null").select("source", "embedding")
        some = self._probes(queries.withColumn("floor", F.lit(0.0)), lambda bounds, _: _first(bounds, n, 4 * k))
        first = stored(self._met(some, target, least, k), "nearest")
        reached = top_per_group(first, "source", k, F.desc("similarity"), "target").groupBy("source").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("floor"))
        floor = F.coalesce("floor", F.lit(float("-inf") if least is None else least))
        rest = queries.join(reached, "source", "left").select("source", "embedding", floor.alias("floor"))
        others = self._probes(rest, lambda bounds, beat: (bounds >= beat[:, None]) & ~_first(bounds, n, 4 * k))
        found = first.unionByName(self._met(others, target, least, k)).groupBy("source", "target").agg(F.max("similarity").alias("similarity"))
        made = stored(top_per_group(found, "source", k, F.desc("similarity"), "target").select("source", "target", "similarity"), "nearest")
        discard(some, others, first)
        return made
