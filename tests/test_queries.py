"""Every registered query of the engine against its SQL, and the driver contract."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from orrerix.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(df):
    def shown(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        return repr(round(float(v), 5)) if isinstance(v, float | np.floating) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert entry.entry(spark).columns == ["uri", "title", "chemical_name", "prediction"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["zstandard", "orrerix.llm"])
def test_other_queries_outlive_the_optional_subpackage(missing):
    """A package that isn't installed, or the subpackage itself gone, takes only the subpackage's queries."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {entry.ROOT!r})
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
print("names", len(entry.queries()), len(entry.oracle_sql()))
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert f"names {len(catalogue.QUERIES)} {len(catalogue.ORACLE)}\n" in said.stdout, said.stderr[-2000:]


def test_top_n_stays_above_the_semi_join(spark, sf):
    plan = catalogue.QUERIES["prompt_topk_then_filter"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("GlobalLimit")


def test_scans_read_only_what_is_asked(spark, sf):
    plan = catalogue.QUERIES["sum_by_key"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_workers_of_a_session_begun_elsewhere_find_the_package(tmp_path, duck):
    import os
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import sys; sys.path.insert(0, {entry.ROOT!r})
import __spark_entry__ as entry
print("rows", entry.queries()["substructure_filter"](spark, "/root/testdata/sf0.001").where("phthalate").count())
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=240)
    (want,) = duck.execute("SELECT count(*) FROM part WHERE p_partkey % 3 = 0").fetchone()
    assert f"rows {want}\n" in said.stdout, said.stderr[-2000:]
