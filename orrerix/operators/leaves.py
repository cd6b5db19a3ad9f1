"""Hierarchical clustering of the rows of a matrix with its distances dealt to many tasks.

Every cluster is a row of its distances to all others.  A round asks each row for
its nearest neighbour, merges all pairs that are nearest to each other, and folds
their rows and columns; rows move once in a round, to where the pair meets.
Average and Ward linkage are reducible: a merge never brings a cluster nearer to
another than either of its parts was, so these merges are the ones that taking
the nearest pair each time would make, in another order.  What the driver holds
is a number for each cluster; once few are left one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, stored
from .cluster import leaf_order, linkage
from .selection import numbered

#: Rows at most, bytes of their vectors at most, clusters that one task finishes, and rows of a block of distances.
MOST, VECTOR_BYTES, FEW, BLOCK = 20_000, 64 << 20, 512, 256


def _folded(how: str, x: np.ndarray, y: np.ndarray, sx, sy, other, height) -> np.ndarray:
    """Distances to a merge of two clusters of sizes sx and sy, from those to its parts."""
    if how == "average":
        return (sx * x + sy * y) / (sx + sy)
    return np.sqrt(np.maximum(0, ((sx + other) * x**2 + (sy + other) * y**2 - other * height**2) / (sx + sy + other)))


def vectors_of(cells: DataFrame, row: str, column: str, value: str, most: int = MOST) -> tuple[DataFrame, DataFrame, int, int]:
    """(id, vector binary), (id, name), rows and columns of a matrix of cells; rows are numbered by name, cells that aren't there are 0.

    Counted before anything is made: more rows than ``most``, or vectors beyond
    VECTOR_BYTES, raise; so does a repeated cell when it is run.
    """
    own = cells.select(F.col(row).alias("row"), F.col(column).alias("column"), F.col(value).cast("double").alias("value")).where("row is not null and column is not null")
    n, width = own.agg(F.count_distinct("row"), F.count_distinct("column")).first()
    if n > most or n * width * 8 > VECTOR_BYTES:
        raise ValueError(f"a matrix of more than {most} rows or {VECTOR_BYTES} bytes isn't clustered: {n} rows, {width} columns")
    names = stored(numbered(own.select("row").distinct(), "row").select(F.col("id").cast("int").alias("id"), F.col("row").alias("name")), "names")
    places = numbered(own.select("column").distinct(), "column", name="place")
    placed = own.join(names, F.col("row") == F.col("name")).join(places, "column").groupBy("id").agg(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.coalesce("value", F.lit(0.0)).alias("value"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells_of in batch.column(1).to_pylist():
                x = np.zeros(width)
                at = [c["place"] for c in cells_of]
                if len(set(at)) < len(at):
                    raise ValueError("a repeated cell")
                x[at] = [c["value"] for c in cells_of]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vector"])

    return stored(placed.mapInArrow(run, "id int, vector binary"), "vectors"), names, n, width


def _distances(vectors: DataFrame, n: int, width: int) -> DataFrame:
    """(id, dist binary): every row's Euclidean distances to all, in the order of ids."""
    whole = vectors.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "vector"))), lambda x: x["vector"]).alias("all"))  # one row of VECTOR_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = None
        for batch in batches:
            if y is None and batch.num_rows:
                y = np.frombuffer(b"".join(batch.column(2)[0].as_py())).reshape(n, width)
                squares = (y**2).sum(axis=1)
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(part.num_rows, width)
                d = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + squares[None, :] - 2 * x @ y.T))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in d], pa.binary())], ["id", "dist"])

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vectors.repartition(tasks, "id").join(F.broadcast(whole)).mapInArrow(run, "id int, dist binary")


def _nearest(rows: DataFrame, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every cluster, in the order of ``alive``, the place of the nearest other one (of equals the first) and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, dist in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                d = np.frombuffer(dist.as_buffer()).copy()
                own = int(np.searchsorted(alive, i))
                d[own] = np.inf
                near = int(d.argmin())
                found.append((own, near, d[near]))
            own, near, gap = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(near, pa.int32()), pa.array(gap, pa.float64())], ["own", "near", "gap"])

    near, gap = np.empty(len(alive), int), np.empty(len(alive))
    for r in rows.mapInArrow(run, "own int, near int, gap double").collect():  # three numbers a cluster
        near[r.own], gap[r.own] = r.near, r.gap
    return near, gap


def _merged(rows: DataFrame, how: str, alive: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, heights: np.ndarray, made: np.ndarray) -> DataFrame:
    """The rows of the next round: ``pairs`` are places in ``alive``, ``made`` the numbers of their merges."""
    gone = np.zeros(len(alive), bool)
    gone[pairs.ravel()] = True
    stay, (a, b) = np.flatnonzero(~gone), pairs.T
    target = alive.copy()
    target[a] = target[b] = made
    goes = {int(i): int(t) for i, t in zip(alive, target, strict=True)}
    after = np.concatenate([alive[stay], made])
    of = {int(m): k for k, m in enumerate(made)}

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([goes[i] for i in batch.column(0).to_pylist()], pa.int32()), batch.column(0), batch.column(1)], ["target", "id", "dist"])

    def fold(to: int, parts: list[np.ndarray]) -> bytes:
        x, size = parts[0], sizes[np.searchsorted(alive, to)] if to not in of else 0
        if to in of:
            k = of[to]
            size = sizes[a[k]] + sizes[b[k]]
            x = _folded(how, parts[0], parts[1], sizes[a[k]], sizes[b[k]], sizes, heights[k])
        new = np.concatenate([x[stay], _folded(how, x[a], x[b], sizes[a], sizes[b], size, heights)])
        new[np.searchsorted(after, to)] = 0
        return new.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            out = []
            for to, dist in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if to != at and parts:
                    out.append((at, fold(at, parts)))
                    parts = []
                at = to
                parts.append(np.frombuffer(dist.as_buffer()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["id", "dist"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([fold(at, parts)], pa.binary())], ["id", "dist"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(tag, "target int, id int, dist binary").repartition(tasks, "target").sortWithinPartitions("target", "id")
    return stored(dealt.mapInArrow(run, "id int, dist binary"), "distances")


def _in_order(merges: list[tuple], n: int) -> np.ndarray:
    """Merges of provisional numbers by height, numbered as they come, the smaller child first."""
    number = dict(zip(range(n), range(n), strict=True))
    out = []
    for k, (a, b, h, size, made) in enumerate(sorted(merges, key=lambda m: (m[2], m[4]))):
        x, y = sorted((number[a], number[b]))
        number[made] = n + k
        out.append((x, y, h, size))
    return np.array(out, float).reshape(-1, 4)


def merges_of(vectors: DataFrame, n: int, width: int, how: str = "ward", few: int = FEW) -> np.ndarray:
    """Merges (left, right, height, size) of the rows 0 to n - 1, as ``cluster.linkage`` gives them; of equal heights the order may differ."""
    if how not in ("average", "ward"):
        raise ValueError(how)
    rows = stored(_distances(vectors, n, width), "distances")
    alive, sizes, merges, new = np.arange(n), np.ones(n), [], n
    while len(alive) > max(2, few):
        near, gap = _nearest(rows, alive)
        own = np.arange(len(alive))
        first = own[(near[near] == own) & (own < near)]
        first = first[np.argsort(gap[first], kind="stable")]
        pairs, heights, made = np.column_stack([first, near[first]]), gap[first], np.arange(new, new + len(first))
        merges += [(int(alive[x]), int(alive[y]), float(h), float(sizes[x] + sizes[y]), int(m)) for (x, y), h, m in zip(pairs, heights, made, strict=True)]
        last, rows = rows, _merged(rows, how, alive, sizes, pairs, heights, made)
        discard(last)
        stay = np.setdiff1d(own, pairs.ravel())
        sizes, alive, new = np.concatenate([sizes[stay], sizes[pairs].sum(axis=1)]), np.concatenate([alive[stay], made]), new + len(first)
    left = {r.id: np.frombuffer(r.dist) for r in rows.collect()}  # `few` rows of as many distances at most
    discard(rows)
    if len(alive) > 1:
        rest = linkage(np.array([left[i] for i in alive]), how, sizes)
        number = [*map(int, alive), *range(new, new + len(rest))]
        merges += [(number[int(x)], number[int(y)], float(h), float(size), number[len(alive) + k]) for k, (x, y, h, size) in enumerate(rest)]
    return _in_order(merges, n)


def order(cells: DataFrame, row: str, column: str, value: str, how: str = "ward", most: int = MOST, few: int = FEW) -> DataFrame:
    """(name, position): the rows of a matrix of cells in the order of a clustering's leaves, smaller numbers on the left.

    Null names are left out; null and absent cells are 0; an empty table gives no rows.
    """
    vectors, names, n, width = vectors_of(cells, row, column, value, most)
    made = leaf_order(merges_of(vectors, n, width, how, few), n) if n else []
    places = names.sparkSession.createDataFrame([(i, p) for p, i in enumerate(made)], "id int, position int")  # two numbers a row
    discard(vectors)
    return names.join(places, "id").select("name", "position")
