import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrerix.functions import vector
from orrerix.operators import cluster
from orrerix.operators import similarity as sim

VECTORS = [(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [0.6, 0.8]), (3, "c", [0.6, 0.8]), (4, "d", None)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "index int, uri string, embedding array<double>")


def test_limit_comes_before_the_choice_of_targets(spark, vectors):
    c = spark.createDataFrame([("c",)], "uri string")
    assert sim.prompt_similars(vectors, [1.0, 0.0], c, 2).count() == 0
    assert [tuple(r) for r in sim.prompt_similars(vectors, [1.0, 0.0], c, 10).collect()] == [("c", 0.6)]


def test_best_of_several_vectors(spark, vectors):
    a = spark.createDataFrame([("a",)], "uri string")
    for block in (1, 4096):
        got = {(r.source, r.target): round(r.similarity, 6) for r in sim.uri_similars(vectors, a, vectors.select("uri"), block=block).collect()}
        assert got == {("a", "a"): 1.0, ("a", "b"): 0.8, ("a", "c"): 0.8}
    assert sim.uri_similars(vectors, a, vectors.select("uri"), above=0.8).count() == 1  # strictly above
    assert sim.uri_similars(vectors, a.where("false"), vectors.select("uri")).count() == 0


def test_queries_are_broadcast_by_their_bytes(vectors, monkeypatch):
    a = vectors.where("uri = 'a'").select("uri")
    want = sorted(map(tuple, sim.uri_similars(vectors, a, vectors.select("uri")).collect()))
    hinted = lambda: "strategy=broadcast" in sim._paired(vectors.where("embedding is not null").select("uri", "embedding"), vectors.select("uri", "embedding"), 4)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(sim, "BROADCAST_BYTES", 64)
    assert hinted()
    monkeypatch.setattr(sim, "BROADCAST_BYTES", 63)
    assert not hinted() and sorted(map(tuple, sim.uri_similars(vectors, a, vectors.select("uri")).collect())) == want


def test_vectors_are_dealt_once_each_to_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK_BYTES", 5 * 8 * 2)
    rows = [(k % 3, [float(k % 40), 1.0]) for k in range(960)]  # 120 different ones
    df = spark.createDataFrame(rows, "uri int, embedding array<double>").coalesce(1)
    seen, real = [], sim._paired
    monkeypatch.setattr(sim, "_paired", lambda *a: seen.append(real(*a)) or seen[0])
    made = sim.uri_similars(df, df.where("uri = 0"), df.where("uri > 0"), block=16)
    assert {tuple(r) for r in made.collect()} == {(0, 1, 39.0 * 39 + 1), (0, 2, 39.0 * 39 + 1)}
    blocks = seen[0].select(F.size("names a").alias("a"), F.length("matrix a").alias("bytes"), F.size("names b").alias("b"), F.spark_partition_id().alias("part")).collect()
    assert sum(r.a * r.b for r in blocks) == 40 * 80 and max(r.bytes for r in blocks) <= 80
    assert len({r.part for r in blocks}) > 1


def test_normalised(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(vector.normalised(F.col("v"))).collect()] == [[0.6, 0.8], None, None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(0, 9), max_size=6), min_size=2, max_size=12), st.sampled_from([0.3, 0.5, 0.75, 1.0]))
def test_join_equals_all_pairs(spark, sets, threshold):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "k int, s array<int>")
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
    assert {(r.a, r.b) for r in sim.tanimoto_join(df, "k", "s", threshold).collect()} == want


def test_tanimoto_of_words_and_sets(spark):
    from orrerix.chem.smiles import words

    a, b = [1, 63, 64, 2047], [1, 64, 5]
    df = spark.createDataFrame([(a, b, words(a), words(b))], "a array<int>, b array<int>, x array<long>, y array<long>")
    row = df.select(vector.tanimoto_sets(F.col("a"), F.col("b")).alias("s"), vector.tanimoto_words(F.col("x"), F.col("y")).alias("w"), vector.tanimoto_sets(F.col("a"), F.col("a")).alias("one")).first()
    assert row.s == row.w == 2 / 5 and row.one == 1.0


def test_examples(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1, 2, 3]), (3, [9])], "k int, bits array<int>")
    examples = [("x", [1, 2]), ("y", [3])]
    assert {r.k: round(r.max_similarity, 3) for r in sim.max_similarity(df, examples, "bits").collect()} == {1: 1.0, 2: 0.667, 3: 0.0}
    near = {(r.example, r.k) for r in sim.nearest_analogues(df, examples, "k", "bits", k=1).collect()}
    assert near == {("x", 2), ("y", 2)}


def test_linkage_by_hand():
    x = np.array([[0.0], [1.0], [5.0]])
    merges = cluster.linkage(cluster.euclidean(x), "average")
    assert merges[:, :2].tolist() == [[0, 1], [2, 3]] and np.allclose(merges[:, 2], [1.0, 4.5])
    ward = cluster.linkage(cluster.euclidean(x), "ward")
    assert np.allclose(ward[:, 2], [1.0, np.sqrt(4 / 3) * 4.5])
    assert cluster.cut(merges, 3, 2.0) == [0, 0, 1] and sorted(cluster.leaf_order(merges, 3)) == [0, 1, 2]


def test_average_clusters(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3, 4]), (3, [7, 8])], "k int, s array<int>")
    got = {r.key: r.cluster for r in cluster.average_clusters(sim.pairwise_matrix(df, "k", "s")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_regression_finds_a_plane(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i - i % 3 + 1) for i in range(30)], "a double, b double, y double")
    made, r2 = cluster.regression(df, ["a", "b"], "y")
    assert r2 > 0.999999 and made.where("abs(predicted - y) > 1e-6").count() == 0
