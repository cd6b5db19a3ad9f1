"""What a task does or holds mustn't grow with rows that say the same, or with what rows become: by plans, calls and results."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrerix.functions import services
from orrerix.plans import catalogue, stages
from orrerix.sources import triples as nt


def below(df):
    """(operator, operators below it) of each line of the optimised plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deep = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    names = [x.lstrip(" :+-") for x in lines]
    out = []
    for i, name in enumerate(names):
        end = next((j for j in range(i + 1, len(names)) if deep[j] <= deep[i]), len(names))
        out.append((name, names[i + 1 : end]))
    return out


def once_per_text(df):
    found = [under for name, under in below(df) if name.startswith("ArrowEvalPython")]
    return bool(found) and all(any(x.startswith("Aggregate") for x in under) for under in found)


@pytest.mark.parametrize("name", ["enriched_by_molecule", "molecule_descriptors", "substructure_filter", "substructure_places"])
def test_molecule_functions_run_once_for_each_text(spark, sf, name):
    assert once_per_text(catalogue.QUERIES[name](spark, sf))


@pytest.mark.parametrize(("name", "module"), [("molecule_clusters", stages), ("morgan_tanimoto", catalogue.scratch)])
def test_fingerprints_are_made_once_for_each_text(spark, sf, monkeypatch, name, module):
    seen, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name, *a: seen.append(df) or real(df, name, *a))
    catalogue.QUERIES[name](spark, sf)
    assert once_per_text(seen[0])


def test_a_registry_number_is_matched_with_one_chemical(spark):
    substances = spark.createDataFrame([(k, '{"CAS": "1-1-1"}') for k in range(50)] + [(None, '{"CAS": "1-1-1"}'), (99, "{}"), (98, '{"CAS": null}')], "sid int, data string")
    chemicals = spark.createDataFrame([(f"c{k:02}", "1-1-1") for k in range(40)] + [("a", None)], "ChemicalID string, CasRN string")
    made = stages.matched(substances, chemicals)
    assert {tuple(r) for r in made.collect()} == {(k, "c00") for k in range(50)}
    (under,) = [under for name, under in below(made) if name.startswith("Join")]
    assert any(x.startswith("Aggregate") for x in under)


def test_a_failing_batch_takes_few_calls():
    calls = []

    def scorer(batch):
        calls.append(len(batch))
        if (batch["v"] % 500 == 7).any():
            raise ValueError("no score")
        return batch["v"] * 2

    batch = pd.DataFrame({"v": range(2000)}, index=range(5, 2005))
    (made,) = services.safe(scorer)(iter([batch]))
    bad = made["v"] % 500 == 7
    assert made[bad]["error"].tolist() == ["no score"] * 4 and made[bad]["result"].isna().all()
    assert made[~bad]["error"].isna().all() and (made[~bad]["result"] == made[~bad]["v"] * 2).all()
    assert len(calls) < 100
    (none,) = services.safe(scorer)(iter([batch.iloc[:0]]))
    assert none.columns.tolist() == ["v", "result", "error"] and none.empty


def test_rows_alike_in_what_a_scorer_reads_are_scored_once():
    calls = []

    def scorer(batch):
        calls.append(len(batch))
        if (batch["v"] == 7).any():
            raise ValueError("no score")
        return batch["v"] * 2

    batch = pd.DataFrame({"k": range(2000), "v": [None if k % 50 == 3 else k % 50 for k in range(2000)]}, index=range(5, 2005))
    (made,) = services.safe(scorer, ["v"])(iter([batch]))
    (plain,) = services.safe(scorer)(iter([batch]))
    assert made.equals(plain)
    assert made["error"].tolist() == ["no score" if k % 50 == 7 else None for k in range(2000)]
    calls.clear()
    list(services.safe(scorer, ["v"])(iter([batch])))
    assert len(calls) < 20 and sum(calls) < 300
    (none,) = services.safe(scorer, ["v"])(iter([batch.iloc[:0]]))
    assert none.columns.tolist() == ["k", "v", "result", "error"] and none.empty


def test_wanted_pairs_are_made_distinct_after_they_are_dealt(spark):
    known = spark.createDataFrame([(1, 2, 0.5), (1, 2, 1.5), (2, 3, None)], "inchi long, property_token long, positive_prediction double")
    ids, tokens = spark.createDataFrame([(1,), (2,), (2,)], "inchi long"), spark.createDataFrame([(2,), (3,)], "property_token long")
    made = stages.completed(known, ids.crossJoin(tokens), lambda batch: batch["property_token"] / 4)
    assert sorted(map(tuple, made.collect()), key=lambda r: r[:2]) == [(1, 2, 1.0), (1, 3, 0.75), (2, 2, 0.5), (2, 3, None)]
    plan = below(made)
    product = [i for i, (name, _) in enumerate(plan) if name.startswith("Join Cross") or name.startswith("Join Inner")]
    for i in product:
        above = [name for k, (name, under) in enumerate(plan[:i]) if k + len(under) >= i]
        nearest = next(name for name in reversed(above) if name.startswith(("Join", "Aggregate")))
        assert nearest.startswith("Join Left")
    assert product


def test_rows_are_dealt_before_they_become_triples(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, t string")
    made = nt.construct(rows, F.concat(F.lit("x:"), "k"), {"p:t": (F.col("t"), "literal", None), "p:k": (F.col("k"), "literal", "x:int")})
    assert sorted(map(tuple, made.distinct().collect())) == [("x:1", "p:k", "1", "literal", "x:int"), ("x:1", "p:t", "a", "literal", None), ("x:2", "p:k", "2", "literal", "x:int")]
    assert made.count() == 5
    (under,) = [under for name, under in below(made) if name.startswith("Generate")]
    assert any(x.startswith("RepartitionByExpression") for x in under)


def test_a_long_text_is_matched_once(spark):
    lines = [
        ('<s> <p> "a \\"b\\" \\\\u0041 \\u0041\\n\\uFEFF\\U0001F600!"@en-GB . # "c"', ("s", "p", 'a "b" \\u0041 A\n\ufeff\U0001f600!', "literal", "@en-GB")),
        ('\t<s x> <p<q>\t"1"^^<x:int>.', ("s x", "p<q", "1", "literal", "x:int")),
        ("_:b<c <p> _:d. .", ("_:b<c", "p", "_:d.", "blank", None)),
        ("_:b <p> _:c.# x", ("_:b", "p", "_:c", "blank", None)),
        ('<s> <p> "" .', ("s", "p", "", "literal", None)),
        ("<s> <p> <> .", ("s", "p", "", "iri", None)),
    ]
    made = nt.parse_ntriples(spark.createDataFrame([(x,) for x, _ in lines] + [(" # no",), ("",), (None,)], "value string"))
    assert {tuple(r) for r in made.collect()} == {x for _, x in lines}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("++|") == 1
    for bad in ('<s> <p> ".', '<s> <p> "x\\" .', '<s> <p> "x"^^ .', '<s> <p> "x" y .', "<s> <p> <o>", "<s> <o> .", '"s" <p> <o> .', "<s> _:p <o> .", '<s> <p> "x"@ .'):
        with pytest.raises(Exception, match="not a triple"):
            nt.parse_ntriples(spark.createDataFrame([(bad,)], "value string")).select("p").collect()
