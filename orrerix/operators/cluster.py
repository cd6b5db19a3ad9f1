"""Clustering and regression.

Clusters of sets by average linkage are found component by component, without a
matrix of all pairs; the orders of a map's leaves come from the whole matrix,
which one task holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, stored
from . import similarity
from .components import components
from .selection import numbered

#: Rows or columns of a matrix that one task clusters (its distances take eight bytes for each pair).
MOST = 5000


def linkage(distance: np.ndarray, how: str, sizes: np.ndarray | None = None) -> np.ndarray:
    """Merges (left, right, height, size) of agglomerative clustering; clusters made later have later numbers.

    ``sizes`` says for how many rows alike each row stands.

    ``how`` is average or ward, the latter on Euclidean distances.  Ties take the
    pair with the smallest numbers, and the child with the smaller number is on
    the left.  Each cluster remembers its nearest other one, so that a merge
    costs about as much as a row, not as the matrix.
    """
    if how not in ("average", "ward"):
        raise ValueError(how)
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    size, number, alive, out = np.ones(n) if sizes is None else np.array(sizes, float), np.arange(n), np.arange(n), []  # of slots; slots that are alive in the order of their numbers
    near, gap = np.zeros(n, np.int64), np.full(n, np.inf)  # the nearest slot (of equals the smallest number) and how far it is

    def look(x: int) -> None:
        others = alive[alive != x]
        if len(others):
            near[x] = others[np.argmin(d[x, others])]
            gap[x] = d[x, near[x]]

    for x in range(n):
        look(x)
    for new in range(n, 2 * n - 1):
        a = alive[np.argmin(gap[alive])]
        b = near[a]
        a, b = (a, b) if number[a] < number[b] else (b, a)
        h = d[a, b]
        rest = alive[(alive != a) & (alive != b)]
        total = size[a] + size[b]
        if how == "average":
            made = (size[a] * d[a, rest] + size[b] * d[b, rest]) / total
        else:
            made = np.sqrt(np.maximum(0, ((size[a] + size[rest]) * d[a, rest] ** 2 + (size[b] + size[rest]) * d[b, rest] ** 2 - size[rest] * h**2) / (total + size[rest])))
        out.append((number[a], number[b], h, total))
        lost = rest[(near[rest] == a) | (near[rest] == b)]
        # the new cluster takes the slot of a, with the largest number of all
        d[a, rest] = d[rest, a] = made
        size[a], number[a], alive = total, new, np.append(rest, a)
        closer = rest[made < gap[rest]]
        near[closer], gap[closer] = a, d[closer, a]
        for x in [*lost[~np.isin(lost, closer)], a]:
            look(x)
    return np.array(out, float).reshape(-1, 4)


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right."""
    if n <= 1:
        return list(range(n))
    stack, out = [n + len(merges) - 1], []
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            stack += [int(merges[x - n, 1]), int(merges[x - n, 0])]
    return out


def cut(merges: np.ndarray, n: int, height: float) -> list[int]:
    """Cluster numbers of the leaves where merges at or above the height are undone, by first leaf."""
    up = list(range(n + len(merges)))
    for k, (a, b, h, _) in enumerate(merges):
        if h < height:
            up[int(a)] = up[int(b)] = n + k

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    first: dict[int, int] = {}
    return [first.setdefault(root(i), len(first)) for i in range(n)]


def euclidean(x: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)
    return np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * x @ x.T))


def _bounded(cells: DataFrame, group: str, row: str, column: str, most: int) -> DataFrame:
    """The cells of groups, or an error for a group with more rows or columns: counted before any matrix is made."""
    sizes = cells.groupBy(group).agg(F.greatest(F.count_distinct(row), F.count_distinct(column)).alias("size of matrix"))
    error = F.raise_error(F.lit(f"a matrix of more than {most} rows or columns isn't clustered in one task")).cast(cells.schema[group].dataType)
    return cells.join(sizes, group).withColumn(group, F.when(F.col("size of matrix") <= most, F.col(group)).otherwise(error)).drop("size of matrix")


def _whole(cells: pd.DataFrame, row: str, column: str, value: str) -> pd.DataFrame:
    return cells.pivot(index=row, columns=column, values=value).fillna(0).sort_index().sort_index(axis=1)


def average_clusters(matrix: DataFrame, key_type: str = "long", below: float = 0.5, most: int = MOST) -> DataFrame:
    """(key, cluster) of a full similarity matrix (i, j, similarity): average linkage on 1 - similarity, cut at ``below``; more than ``most`` keys raise."""

    def run(_: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        wide = _whole(cells, "i", "j", "similarity")
        return pd.DataFrame({"key": wide.index, "cluster": cut(linkage(1 - wide.to_numpy(), "average"), len(wide), below)})

    return _bounded(matrix.withColumn("matrix", F.lit(0)), "matrix", "i", "j", most).groupBy("matrix").applyInPandas(run, f"key {key_type}, cluster int")


def _tanimoto(sets: list) -> np.ndarray:
    """The coefficients of all pairs of sets, from products of some columns of their members at a time."""
    size = np.array([len(x) for x in sets])
    of, member = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate(sets), return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)))
    for at in range(0, int(member.max(initial=-1)) + 1, 4096):
        there = np.zeros((len(sets), 4096), np.float32)
        some = (member >= at) & (member < at + 4096)
        there[of[some], member[some] - at] = 1
        shared += there @ there.T
    return shared / (size[:, None] + size[None, :] - shared)


def clusters_of_sets(sets: DataFrame, key: str, items: str, below: float = 0.5, most: int = MOST) -> DataFrame:
    """(key, cluster, component): average linkage of the sets of items on 1 - Tanimoto coefficient, cut at ``below`` (under 1).

    Two clusters merge below the cut only if a pair of their members is nearer
    than that, so no cluster crosses a component of such pairs: the pairs come
    from ``tanimoto_join``, the components from star rounds, and each component
    is a task's matrix of its own.  Equal sets are one row of the matrix with
    their number as weight.  A component of more than ``most`` different sets
    raises before any matrix is made.  Clusters are numbered from 0 by their
    least key; component is the least key of the component.  Repeated keys count
    once; empty sets are clusters of one, and null keys and sets are left out.
    """
    if not 0 < below < 1:
        raise ValueError("the cut lies between 0 and 1")
    kind = sets.schema[key].dataType.simpleString()
    own = sets.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(items)).alias("set")).where("key is not null and set is not null").groupBy("key").agg(F.first("set").alias("set"))
    full = stored(own.where(F.size("set") > 0), "sets")
    alike = full.groupBy("set").agg(F.min("key").alias("of"), F.count(F.lit(1)).alias("weight"))
    alike = stored(alike, "sets")
    reach = components(similarity.tanimoto_join(alike, "of", "set", 1 - below), "a", "b")
    sizes = reach.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    error = F.raise_error(F.concat(F.lit(f"a component of more than {most} sets isn't clustered in one task: "), F.col("rows").cast("string"))).cast(kind)
    members = alike.join(reach.withColumnRenamed("node", "of"), "of").join(sizes, "component").select(F.when(F.col("rows") <= most, F.col("component")).otherwise(error).alias("component"), "of", "weight", "set")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("of")
        merges = linkage(1 - _tanimoto(part["set"].tolist()), "average", part["weight"].to_numpy())
        first = part["of"].groupby(cut(merges, len(part), below)).transform("min") if len(part) > 1 else part["of"]
        return pd.DataFrame({"of": part["of"], "first": first, "component": part["component"]})

    made = members.groupBy("component").applyInPandas(run, f"of {kind}, first {kind}, component {kind}")
    alone = alike.join(reach, F.col("of") == F.col("node"), "left_anti").select("of", F.col("of").alias("first"), F.col("of").alias("component"))
    of_sets = made.unionByName(alone).join(alike.select("of", "set"), "of")
    empty = own.where(F.size("set") == 0).select("key", F.col("key").alias("first"), F.col("key").alias("component"))
    placed = stored(full.join(of_sets, "set").select("key", "first", "component").unionByName(empty), "clusters")
    discard(full, alike, reach)
    # least keys are those of clusters, since clusters of equal sets have the least of all
    names = numbered(placed.select("first").distinct(), "first", name="cluster")
    return placed.join(names, "first").select("key", "cluster", "component")


def ward_order(cells: DataFrame, row: str, column: str, value: str, by_columns: bool = False, how: str = "ward", most: int = MOST) -> DataFrame:
    """(name, position): rows, or columns, of the matrix of cells in the order of a clustering's leaves; cells that aren't there are 0; more than ``most`` raise."""
    kind = cells.schema[column if by_columns else row].dataType.simpleString()

    def run(_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        wide = _whole(part, row, column, value)
        wide = wide.T if by_columns else wide
        order = leaf_order(linkage(euclidean(wide.to_numpy(float)), how), len(wide))
        return pd.DataFrame({"name": wide.index[order], "position": range(len(wide))})

    return _bounded(cells.select(row, column, value, F.lit(0).alias("matrix")), "matrix", row, column, most).groupBy("matrix").applyInPandas(run, f"name {kind}, position int")


def cluster_maps(cells: DataFrame, row: str, column: str, value: str, category: str | None = None, how: str = "average", most: int = MOST) -> DataFrame:
    """(category, row, column, value, row_position, column_position): the cells of each category's matrix with both orders of its leaves.

    Without a category one map of all cells.  Cells that aren't there count 0 and
    give no row; a null category is none.  Each category is a task of its own.
    """
    names = {n: cells.schema[n].dataType.simpleString() for n in (row, column, value)}
    group = F.lit("all") if category is None else F.col(category).cast("string")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        wide = _whole(part, row, column, value)
        for axis, name in ((wide, "row_position"), (wide.T, "column_position")):
            order = leaf_order(linkage(euclidean(axis.to_numpy(float)), how), len(axis))
            place = pd.Series(range(len(order)), index=axis.index[order])
            part[name] = part[row if name == "row_position" else column].map(place).astype(int)
        return part

    bounded = _bounded(cells.select(group.alias("category"), row, column, value).where("category is not null"), "category", row, column, most)
    made = bounded.groupBy("category").applyInPandas(run, ", ".join(["category string", *(f"`{n}` {t}" for n, t in names.items()), "row_position int", "column_position int"]))
    return made


def kmeans(df: DataFrame, columns: list[str], k: int = 3, seed: int = 42, name: str = "cluster") -> DataFrame:
    """Rows with the number of their cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=columns, outputCol="features of row").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="features of row", predictionCol=name).fit(made).transform(made).drop("features of row")


def kmeans_of(df: DataFrame, features: str, k: int = 3, seed: int = 42, name: str = "cluster") -> DataFrame:
    """Rows with the number of their cluster, by an array of doubles of one length."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    made = df.withColumn("features of row", array_to_vector(F.col(features)))
    return KMeans(k=k, seed=seed, featuresCol="features of row", predictionCol=name).fit(made).transform(made).drop("features of row")


def regression(df: DataFrame, columns: list[str], target: str, train: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Least squares: all rows with a prediction, and R squared on the rows that were learned from."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    to = VectorAssembler(inputCols=columns, outputCol="features of row")
    model = LinearRegression(featuresCol="features of row", labelCol=target, predictionCol="predicted", solver="normal").fit(to.transform(train if train is not None else df))
    return model.transform(to.transform(df)).drop("features of row"), model.summary.r2


def held_out_r2(predicted: DataFrame, target: str, held_out: DataFrame, key: str) -> DataFrame:
    """(n, r2): R squared of ``predicted`` on the rows that weren't learned from, against their own mean; null for no variance."""
    rows = predicted.join(held_out.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(target) - F.col("predicted")) ** 2).alias("left"), (F.var_pop(target) * F.count(F.lit(1))).alias("all"))
    return rows.select("n", F.when(F.col("all") > 0, 1 - F.col("left") / F.col("all")).alias("r2"))
