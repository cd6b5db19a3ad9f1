"""Exact quantiles by counting, dense numbers by prefix sums, components and component-wise clusters, against plain programs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrerix.operators import cluster, selection
from orrerix.operators.components import components
from orrerix.plans import catalogue
from orrerix.scratch import stored

from .test_clusters import plain_linkage

SHARES = [0.0, 0.1, 1 / 3, 0.5, 0.75, 0.999, 1.0]


def close(got, want):
    return got == pytest.approx(want, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(1).normal(size=5001), np.random.default_rng(2).lognormal(sigma=40, size=3000) * np.random.default_rng(3).choice([-1, 1], 3000), np.full(2000, 7.5), np.arange(-500, 501),
        np.r_[np.full(999, 1.0), 1.0 + 2.0**-52, np.full(999, 1.0 + 2.0**-51)], np.r_[0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308] , np.r_[1.7976931348623157e308, -1.7976931348623157e308, 1e300], np.array([4.0]), np.r_[np.zeros(1000), 3, -3, np.zeros(1000)],
    ],
)
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "v double").repartition(3)
    (got,) = selection.quantiles(df, "v", SHARES).collect()
    low, high = (np.quantile(values, SHARES, method=m) for m in ("lower", "higher"))
    place = np.array(SHARES) * (len(values) - 1)
    with np.errstate(over="ignore"):
        want = np.where(low == high, low, low + (high - low) * (place - np.floor(place)))
    assert close(got.quantiles, want.tolist())


def test_quantiles_of_groups_above_and_below_the_limit(spark):
    """Null keys, groups of nulls, keys named like the function's own columns; large groups are counted, small ones ordered."""
    rng = np.random.default_rng(5)
    rows = [(k, "a" if k % 2 else None, float(v)) for k, n in ((1, 3000), (2, 2500), (3, 20), (4, 1)) for v in np.round(rng.normal(size=n), 2)] + [(5, "a", None), (None, "a", 2.0), (None, "a", 4.0)]
    df = spark.createDataFrame(rows, "x int, low string, found double")
    got = {(r.x, r.low): r.quantiles for r in selection.quantiles(df, "found", SHARES, ["x", "low"], few=100).collect()}
    whole = {(r.x, r.low): r.quantiles for r in selection.quantiles(df, "found", SHARES, ["x", "low"]).collect()}
    assert set(got) == set(whole) == {(1, "a"), (2, None), (3, "a"), (4, None), (5, "a"), (None, "a")}
    for k, v in whole.items():
        assert (v is None and got[k] is None) or close(got[k], v)
    assert got[5, "a"] is None and got[None, "a"][3] == 3.0


def test_quantiles_of_nan_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    (got,) = selection.quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]).collect()
    assert got.quantiles[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and np.isnan(got.quantiles[4])
    assert selection.quantiles(df.limit(0), "v", [0.5]).collect() == [(None,)]
    assert selection.quantiles(df.limit(0), "v", [0.5], [], name="q").columns == ["q"]
    with pytest.raises(ValueError, match="from 0 to 1"):
        selection.quantiles(df, "v", [1.5])


def test_quantiles_keep_values_out_of_one_task(spark):
    """No exchange of rows: what is shuffled are counts of at most some thousands of parts."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    found = selection._selected(df.select(F.col("v").alias("x")), [], [0.5])
    assert found.agg(F.min("found")).first()[0] == float(np.sort((np.arange(200_000) * 7919) % 200_003)[99_999])
    plan = df.groupBy(selection._magnitude(F.col("v"))).count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_numbers_without_gaps(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 40, 3000).tolist()
    df = spark.createDataFrame([(int(v), None if v % 9 == 0 else f"t{v}") for v in values], "k int, t string").repartition(5)
    got = selection.numbered(df, "k").toPandas()
    assert sorted(got["id"]) == list(range(3000)) and got.sort_values("id")["k"].is_monotonic_increasing
    down = selection.numbered(df, "t", "-k", name="n", start=1).toPandas().sort_values("n")
    assert down["n"].tolist() == list(range(1, 3001)) and down.columns.tolist() == ["k", "t", "n"]
    want = sorted(zip(df.toPandas()["t"], df.toPandas()["k"]), key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert [(t, k) for t, k in zip(down["t"], down["k"])] == want
    assert selection.numbered(df.limit(0), "k").collect() == []


def test_ten_million_rows_are_numbered_in_many_tasks(spark):
    df = spark.range(10_000_000).select((F.col("id") * 48271 % 10_000_019).alias("k"))
    made = selection.numbered(df, "k")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "Window" in plan.split("SinglePartition")[0]  # that of the counts of ranges, a row each
    n, last, wrong = made.select("k", "id").agg(F.count(F.lit(1)), F.max("id"), F.bit_xor(F.xxhash64("id"))).first()
    assert n == 10_000_000 and last == n - 1 and wrong == spark.range(n).agg(F.bit_xor(F.xxhash64("id"))).first()[0]
    assert made.where("k < 100").orderBy("k").select("id").toPandas()["id"].is_monotonic_increasing


def test_one_hot_value_is_dealt_to_several_ranges(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(selection, "stored", lambda df, name: seen.append(made := stored(df, name)) or made)
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("k"), "id")
    made = selection.numbered(df, "k", name="n")
    assert sorted(r.n for r in made.collect()) == list(range(4000))
    assert seen[0].where("k = 5").select(F.shiftright("place of row", 33)).distinct().count() > 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_equal_a_plain_program(spark, links):
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in links] + [("n01", None)], "a string, b string")
    least = {x: x for p in links if p[0] != p[1] for x in p}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == {f"n{a:02}": f"n{b:02}" for a, b in least.items()}


def plain_clusters(sets, below=0.5):
    keys = sorted(sets)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    d = np.array([[0.0 if a == b else 1 - like(sets[a], sets[b]) for b in keys] for a in keys])
    return dict(zip(keys, cluster.cut(plain_linkage(d, "average"), len(keys), below), strict=True))


@pytest.mark.parametrize("below", [0.3, 0.5, 0.8])
def test_clusters_of_sets_equal_the_whole_matrix(spark, below):
    """Families of like sets, copies, empty sets and loners."""
    rng = np.random.default_rng(8)
    sets = {}
    for family in range(9):
        core = set(rng.choice(200, 10, replace=False).tolist())
        for k in range(int(rng.integers(1, 9))):
            sets[f"k{family}-{k}"] = {x for x in core if rng.random() < 0.8} | set(rng.choice(200, 2).tolist())
    sets |= {f"copy {i}": sets["k0-0"] for i in range(5)} | {"empty": set()}
    df = spark.createDataFrame([(k, [*v, *v]) for k, v in sets.items()] + [("k0-0", list(sets["k0-0"])), (None, [1]), ("lost", None)], "name string, bits array<int>").repartition(4)
    got = {r.key: r.cluster for r in cluster.clusters_of_sets(df, "name", "bits", below).collect()}
    assert got == plain_clusters(sets, below) and len(set(got.values())) < len(got)


def test_clusters_of_sets_raise_for_a_large_component(spark):
    df = spark.createDataFrame([(k, [1, 2, 3, 4, 5, 6, 7, 8, 100 + k]) for k in range(12)] + [(50, [9])], "k int, s array<int>")
    assert {r.key: r.component for r in cluster.clusters_of_sets(df, "k", "s").collect()} == {k: 0 for k in range(12)} | {50: 50}
    with pytest.raises(Exception, match="more than 11 sets"):
        cluster.clusters_of_sets(df, "k", "s", most=11).collect()
    with pytest.raises(ValueError, match="between 0 and 1"):
        cluster.clusters_of_sets(df, "k", "s", 1.0)
    assert cluster.clusters_of_sets(df.limit(0), "k", "s").collect() == []


def test_molecule_clusters_query(spark, sf):
    """The registered query against the matrix of all its molecules."""
    from orrerix.chem import smiles as s

    got = catalogue.QUERIES["molecule_clusters"](spark, sf).toPandas()
    texts = {r.smiles for r in catalogue._molecules(catalogue.Catalog(spark, sf)).distinct().collect()}
    bits = {t: set(s.circular_fingerprint(m)) for t in texts if t is not None and (m := s.parse(t)) is not None}
    want = plain_clusters(bits)
    assert len(got) and {t: c for t, c in zip(got["smiles"], got["cluster"])} == {t: want[t] for t in got["smiles"]}
