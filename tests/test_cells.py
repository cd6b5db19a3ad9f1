"""The stored vector index: searches equal those of the whole table, and read only some cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerix.operators.cells import Cells

SCHEMA = "index long, uri string, embedding array<double>"


def clustered(n, seed, width=8, clusters=12, scale=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, width))
    x = (x / np.linalg.norm(x, axis=1)[:, None])[np.arange(n) % clusters] + rng.normal(scale=scale, size=(n, width))
    return [(i, f"u{i % 90}", [float(v) for v in row]) for i, row in enumerate(x)]


def plain(rows, asked, k, column, least=None):
    best = {}
    for source, q in asked:
        for row in rows:
            if row[2] is not None and q is not None:
                pair = (source, row[column])
                best[pair] = max(best.get(pair, -np.inf), float(np.dot(q, row[2])))
    out = set()
    for source in {s for s, _ in asked}:
        own = sorted(((-v, t) for (s, t), v in best.items() if s == source and (least is None or v > least)))
        out |= {(source, t, round(-v, 9)) for v, t in own[:k]}
    return out


def got(df):
    return {(r.source, r.target, round(r.similarity, 9)) for r in df.collect()}


@pytest.mark.parametrize("scale,cells", [(0.05, None), (1.0, 6), (0.1, 1)])
def test_nearest_equals_the_whole_table(spark, tmp_path, scale, cells):
    rows = clustered(700, 1, scale=scale) + [(1000, "none", None), (1001, "zero", [0.0] * 8), (1002, "far", [9.0] * 8)]
    index = Cells.build(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "c"), cells=cells)
    asked = [(f"q{i % 5}", rows[i * 37][2]) for i in range(15)] + [("null", None), ("zero", [0.0] * 8)]
    queries = spark.createDataFrame(asked, "source string, embedding array<double>")
    for k, column, name in ((1, 0, "index"), (5, 0, "index"), (7, 1, "uri"), (800, 0, "index")):
        assert got(index.nearest(queries, k, name)) == plain(rows, asked, k, column)
    assert got(index.nearest(queries, 5, "uri", 0.9)) == plain(rows, asked, 5, 1, 0.9)
    assert got(index.above(queries, 0.8)) == plain(rows, asked, 10**6, 0, 0.8)


def test_cells_that_cannot_matter_are_not_read(spark, tmp_path):
    rows = clustered(3000, 2, scale=0.02)
    index = Cells.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "c"))
    asked = [("one", rows[0][2]), ("two", rows[1][2])]
    queries = spark.createDataFrame(asked, "source string, embedding array<double>")
    assert got(index.nearest(queries, 10)) == plain(rows, asked, 10, 0)
    assert len(index.ids) > 10 and 0 < len(index.read) <= 0.4 * len(index.ids)
    assert got(index.above(queries, 0.95)) == plain(rows, asked, 10**6, 0, 0.95) and len(index.read) <= 0.4 * len(index.ids)
    plan = index._blocks(sorted(index.read), "index")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    # the files of other cells can be gone
    files = index.vectors.where(~F.col("cell").isin(sorted(index.read))).select(F.input_file_name()).distinct().collect()
    assert files and all(f"cell={c}/" not in f[0] for f in files for c in index.read)


def test_opened_again_repeated_and_empty(spark, tmp_path):
    rows = [(i % 4, "same", [1.0, 2.0]) for i in range(200)] + [(9, "other", [2.0, 1.0])]
    made = Cells.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "c"))
    again = Cells(spark, str(tmp_path / "c"))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "source int, embedding array<double>")
    assert made.ids.tolist() == again.ids.tolist() and got(again.nearest(queries, 3)) == {(1, 0, 2.0), (1, 1, 2.0), (1, 2, 2.0)}
    none = Cells.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert none.nearest(queries, 3).collect() == [] and none.above(queries, 0.0).collect() == []
    assert made.nearest(queries.limit(0), 3).collect() == []
