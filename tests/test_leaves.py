"""Leaf orders from distances in many tasks equal those of one task."""

import numpy as np
import pytest

from orrerix.operators import cluster, leaves


def cells_of(x):
    return [(f"r{i:05}", f"c{j:03}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v]


CELLS = "row string, place string, value double"


@pytest.mark.parametrize("how", ["average", "ward"])
@pytest.mark.parametrize("n,few", [(60, 2), (150, 20), (1, 2), (2, 2)])
def test_merges_equal_those_of_one_task(spark, how, n, few):
    x = np.random.default_rng(n).normal(size=(n, 5))
    vectors, names, rows, width = leaves.vectors_of(spark.createDataFrame(cells_of(x), CELLS).repartition(3), "row", "place", "value")
    got, want = leaves.merges_of(vectors, rows, width, how, few), cluster.linkage(cluster.euclidean(x), how)
    assert np.array_equal(got[:, :2], want[:, :2]) and np.allclose(got[:, 2:], want[:, 2:])
    order = leaves.order(spark.createDataFrame(cells_of(x), CELLS), "row", "place", "value", how, few=few).orderBy("position").collect()
    assert [int(r.name[1:]) for r in order] == cluster.leaf_order(want, n) and [r.position for r in order] == list(range(n))


def test_orders_of_ties_copies_and_nothing(spark):
    """Equal rows and a chain whose nearest neighbours are one after the other; every row has one place."""
    x = np.r_[np.ones((30, 3)), np.column_stack([np.cumsum(1.0 / np.arange(1, 40)), np.zeros(39), np.ones(39)])]
    made = leaves.order(spark.createDataFrame(cells_of(x), CELLS), "row", "place", "value", few=4).collect()
    assert sorted(r.position for r in made) == list(range(69))
    copies = sorted(r.position for r in made if int(r.name[1:]) < 30)
    assert copies == list(range(copies[0], copies[0] + 30))
    df = spark.createDataFrame([("a", "x", 1.0), (None, "x", 2.0), ("b", "x", None)], CELLS)
    assert {r.name for r in leaves.order(df, "row", "place", "value").collect()} == {"a", "b"}
    assert leaves.order(df.limit(0), "row", "place", "value").collect() == []
    with pytest.raises(Exception, match="repeated cell"):
        leaves.order(df.union(df), "row", "place", "value").collect()
    with pytest.raises(ValueError, match="more than 1 rows"):
        leaves.order(df, "row", "place", "value", most=1)


def test_five_thousand_rows_in_several_tasks(spark):
    x = np.random.default_rng(3).normal(size=(5000, 3))
    flat = [(i, j, float(x[i, j])) for i in range(5000) for j in range(3)]
    df = spark.createDataFrame(flat, "row int, place int, value double")
    got = leaves.order(df, "row", "place", "value", "ward").orderBy("position").toPandas()["name"].tolist()
    assert got == cluster.leaf_order(cluster.linkage(cluster.euclidean(x), "ward"), 5000)
