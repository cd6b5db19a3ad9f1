"""A graph stored by predicate gives what the table of triples gives, in an order that doesn't depend on how a query is written."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from orrerix.plans import bgp, store

X = {"x": "http://x/"}


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        rows += [(f"http://x/e{i}", "http://x/knows", f"http://x/e{rng.randrange(60)}", "iri", None) for _ in range(5)]
        rows.append((f"http://x/e{i}", bgp.TYPE, f"http://x/T{i % 3}", "iri", None))
        rows.append((f"http://x/e{i}", "http://x/name", f"n{i % 7}", "literal", None))
        rows.append((f"http://x/e{i}", "http://x/size", str(i % 4), "literal", "http://www.w3.org/2001/XMLSchema#integer"))
    rows += [("http://x/e1", "http://x/rare", "http://x/e2", "iri", None), ("_:b", "http://x/rare", "_:c", "blank", None), ("http://x/e3", "http://x/name", "3", "literal", None), ("http://x/e4", "http://x/knows", "http://x/e4", "iri", None), ("http://x/rare", "http://x/name", "a predicate", "literal", None)]
    return spark.createDataFrame(rows + rows[:4], "s string, p string, o string, o_kind string, o_datatype string").repartition(3).cache()


@pytest.fixture(scope="module")
def made(graph, tmp_path_factory):
    return store.build(graph, str(tmp_path_factory.mktemp("store")))


QUERIES = [
    ["?a x:knows ?b", "?b x:knows ?c", "?a x:rare ?r"], ["?a x:name ?n", "?b x:name ?n", "?a x:rare ?b2"], ["?a x:size 3", "?a x:name ?n"], ['?a x:size "3"'], ['?a x:name "3"'], ["x:e1 ?p ?o"], ["?s ?p ?o", "?s x:rare ?r"], ["?a x:knows ?a"],
    ["?a a x:T1", "?a x:knows ?b", "?b a x:T2", "FILTER(?a != x:e1)"], ["?a x:nothing ?b", "?b x:knows ?c"], ["?a x:rare ?b", "?c x:size 2"], ["?a x:knows ?b", 'FILTER(?b = x:e5 || ?a = "never")'], ["x:e1 x:rare x:e2", "?s x:rare ?o"], ["?p x:name ?n", "?s ?p ?o"], ["?a x:knows ?b", "FILTER(?a = ?b)"],
]


@pytest.mark.parametrize("patterns", QUERIES, ids=range(len(QUERIES)))
def test_results_equal_those_of_the_table(graph, made, patterns):
    plain, by_predicate = bgp.Query(graph, X), made.query(X)
    for p in patterns:
        plain.where(p), by_predicate.where(p)
    want = plain.execute()
    got = by_predicate.select(*want.columns).execute()
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*got.columns).collect()))


def test_order_does_not_depend_on_the_writing(made):
    patterns = ["?a x:knows ?b", "?b x:name ?n", "?a x:rare ?r", "?r x:size ?z"]
    orders = set()
    for some in permutations(patterns):
        q = made.query(X)
        for p in some:
            q.where(p)
        orders.add(tuple(q.order()))
    (order,) = orders
    assert "rare" in order[0] and "knows" in order[-1] or "name" in order[-1]


def test_only_the_predicates_of_a_query_are_read(made):
    q = made.query(X).select("?a", "?b").where("?a x:rare ?b")
    df, _ = q._joined()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predicate" in plan
    assert len(df.collect()) == 2
    read = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert 0 < read < len(made.triples.inputFiles()) / 3
    assert df.columns == ["a", "b"] and [t for _, t in df.dtypes] == ["bigint", "bigint"]  # terms are numbers until the end


def test_types_limits_unbound_and_opened_again(spark, made, graph, tmp_path):
    assert {r.z for r in made.query(X).select_typed({"z": int}).where("?a x:size ?z").execute().collect()} == {0, 1, 2, 3}
    assert made.query(X).select("?s").where("?s ?p ?o").limit(2).execute().count() == 2
    with pytest.raises(ValueError, match="binds"):
        made.query(X).select("?q").where("?s ?p ?o").execute()
    empty = store.build(graph.limit(0), str(tmp_path / "e"))
    assert empty.query(X).select("?s").where("?s x:name ?o").execute().collect() == []
    again = store.build(graph, str(tmp_path / "g")) and store.Store(spark, str(tmp_path / "g"))
    assert again.query(X).select("?s").where("?s x:rare ?o").execute().count() == 2


def test_terms_with_many_rows_are_broadcast_and_all_others_are_not(graph, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "HOT", 4)
    monkeypatch.setattr(store, "MOST_HOT", 10**9)
    plans, hot, real = [], [], store._joined_terms

    def seen(rows, on, spread, known, few, *names):
        hot.append({r[0] for r in few.collect()})
        made = real(rows, on, spread, known, few, *names)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(store, "_joined_terms", seen)
    built = store.build(graph, str(tmp_path / "hot"))
    assert len(hot) == 3 and {bgp.TYPE, "http://x/knows"} < hot[1] and {"http://x/T0", "n1", "3"} < hot[2] and "http://x/rare" not in hot[1]
    for patterns in QUERIES:
        plain, by_predicate = bgp.Query(graph, X), built.query(X)
        for p in patterns:
            plain.where(p), by_predicate.where(p)
        want = plain.execute()
        got = by_predicate.select(*want.columns).execute()
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*got.columns).collect()))
    assert len(plans) > 20 and all("SortMergeJoin" in p for p in plans)
