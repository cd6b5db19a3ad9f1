import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrerix.operators import relational as rel


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_keys_match_only_on_request(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), ("k", 3)], "k string, a int")
    b = spark.createDataFrame([(None, 9), ("k", 8)], "k string, b int")
    assert rel.inner(a, b, "k").count() == 1
    assert rel.inner(a, b, "k", null_matches=True).count() == 3
    assert len(pd.merge(a.toPandas(), b.toPandas(), on="k")) == 3  # what pandas does


def test_any_missing_and_missing_pairs(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "i string")
    tokens = spark.createDataFrame([(1,), (2,)], "t int")
    known = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("b", 7)], "i string, t int")
    assert rows(rel.any_missing(ids, tokens, known, "i", "t")) == [("b",), ("c",)]
    assert rows(rel.missing_pairs(rel.product(ids, tokens), known, ["i", "t"])) == [("b", 2), ("c", 1), ("c", 2)]
    assert rel.any_missing(ids, tokens.where("false"), known, "i", "t").count() == 0


def test_first_value_that_is_not_null_per_column(spark):
    df = spark.createDataFrame([("g", 1, None, 10), ("g", 2, "z", None), (None, 3, "y", 1)], "k string, o int, a string, b int")
    assert rows(rel.first_per_group(df, "k", ["o"])) == [("g", 1, "z", 10)]


def test_sum_of_nulls_is_zero_and_null_keys_drop(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), ("b", 2.0)], "k string, v double")
    assert rows(rel.total(df, "k", "v")) == [("a", 0.0), ("b", 2.0)]


def test_titles_get_numbers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "u int, t string")
    assert rows(rel.numbered_repeats(df, "t", ["u"])) == [(1, "a_1"), (2, "b"), (3, "a_2")]
    assert rows(rel.numbered_repeats(df, "t", ["u"], between=" ")) == [(1, "a 1"), (2, "b"), (3, "a 2")]


def test_pivot_raises_on_repeated_cells_and_fills(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("s", "y", 2.0)], "r string, c string, v double")
    assert rows(rel.pivot(df, "r", "c", "v", ["x", "y"], 0.0)) == [("r", 1.0, 0.0), ("s", 0.0, 2.0)]
    with pytest.raises(Exception, match="repeated cell"):
        rel.pivot(df.unionAll(df), "r", "c", "v", ["x", "y"]).collect()


def test_pivot_and_melt_round_trip(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "y", 2.0), ("s", "x", 3.0), ("s", "y", 4.0)], "r string, variable string, value double")
    back = rel.melt(rel.pivot(df, "r", "variable", "value"), ["r"], ["x", "y"])
    assert rows(back.select("r", "variable", "value")) == rows(df)


def test_quantile_bins_equal_pandas(spark):
    values = list(range(1, 11))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r.v: r.bin for r in rel.quantile_bins(df, "v", 5).collect()}
    assert [got[float(v)] for v in values] == (pd.qcut(values, 5, labels=False) + 1).tolist()
    ties = spark.createDataFrame([(1.0,)] * 4 + [(2.0,)], "v double")
    with pytest.raises(Exception, match="bounds of bins are equal"):
        rel.quantile_bins(ties, "v", 5).collect()
    assert rel.quantile_bins(ties, "v", 5, merge_equal=True).count() == 5


def test_top_per_group_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("g", i, 1.0) for i in (3, 1, 2)], "g string, u int, s double")
    assert rows(rel.top_per_group(df, "g", 2, F.desc("s"), "u")) == [("g", 1, 1.0), ("g", 2, 1.0)]


def test_nearest_to_median(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate((1, 2, 3, 10, 20))], "g string, u int, v double")
    assert {r.u for r in rel.nearest_to_median(df, "g", "v", 2, "u").collect()} == {2, 1}


def test_filled_mean_counts_absent_cells(spark):
    df = spark.createDataFrame([("a", "x", 4.0), ("b", "x", 2.0), ("b", "y", 2.0)], "r string, c string, v double")
    assert rows(rel.filled_mean(df, "r", "c", "v")) == [("a", 2.0), ("b", 2.0)]


def test_sample_and_split_repeat(spark):
    df = spark.range(1000)
    assert rows(rel.sample(df, 10, "id")) == rows(rel.sample(df.repartition(7), 10, "id"))
    a, b = rel.split(df, 0.8, "id")
    assert a.count() + b.count() == 1000 and 740 < a.count() < 860


def test_requirements(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="repeated"):
        rel.require_distinct(df, "k")
    with pytest.raises(ValueError, match="missing"):
        rel.require_all(df, spark.createDataFrame([(2,)], "k int"), "k")


def test_default_keeps_every_wanted_row(spark):
    wanted = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos int, k string")
    values = spark.createDataFrame([("a", 2.0)], "k string, v double")
    assert [(r.pos, r.v) for r in rel.with_default(wanted, values, "k", "v").orderBy("pos").collect()] == [(0, 2.0), (1, 0.0), (2, 2.0)]


def test_a_product_that_is_too_large_raises(spark):
    a, b = spark.range(4).toDF("x"), spark.range(3).toDF("y")
    assert rel.product(a, b, most=12).count() == 12 and rel.product(a, b.limit(0)).count() == 0
    with pytest.raises(Exception, match="at most 11 pairs"):
        rel.product(a, b, most=11).collect()
