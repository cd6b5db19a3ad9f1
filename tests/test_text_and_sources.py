import json
import sqlite3

import pandas as pd
from pyspark.sql import functions as F

from orrerix.chem import columns as chem
from orrerix.chem import smiles as s
from orrerix.functions import services, text
from orrerix.sources import catalog
from orrerix.streaming.incremental import PredictionTable


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_alias_lists(spark):
    raw = "a: one\n\n  b : two:three \nplain\n\tTab\t\na: last"
    got = {(r.alias, r.name) for r in text.alias_list(spark.createDataFrame([(1, raw), (2, None)], "k int, t string"), "k", "t").collect()}
    assert got == {("a", "last"), ("b", "two:three"), ("plain", "plain"), ("Tab", "Tab")}


def test_last_alias_wins(spark):
    df = spark.createDataFrame([("n", "x", 0), ("n", "y", 1)], "name string, alias string, pos int")
    assert text.last_alias(df).first().alias == "y"


def test_quoted_phrases(spark):
    assert column(spark, ["none", 'a "b c" d "e', '""', 'x "y" "z"'], text.quoted_phrases) == [[], ["b c", "e"], [""], ["y", "z"]]
    for prompt, want in (("none", [True, True]), ('the "ACID"', [True, False]), ('""', [True, True]), ('"q" or "b', [False, True])):
        assert column(spark, ["Acid rain", "Base"], lambda t, p=prompt: text.holds_phrase(t, F.lit(p))) == want


def test_first_key_present(spark):
    docs = ['{"casrn":"1"}', '{"CasRN":["2","3"]}', '{"CAS":"4"}', '{"casrn":null,"CAS":"5"}', '{"CAS":[]}', "not json", None]
    assert column(spark, docs, lambda d: text.first_key_present(d, "casrn", "CasRN", "CAS")) == ["1", "2", "4", None, None, None, None]


def test_assay_uris(spark):
    rows = [("ice", "A b", "{}"), ("bindingdb", "", '{"Link to Target in BindingDB": "http://b/1"}'), ("pubchem", "", '{"aid": 12.0}'), ("chembl", "", '{"chembl_id": "C5"}'), ("other", "", "{}")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, t string, d string").coalesce(1).select(text.assay_uri(F.col("s"), F.col("t"), F.col("d"), "u/")).collect()]
    assert got == ["u/ice/A_b", "http://b/1", "u/pubchem/12", "u/chembl/C5", None]


def test_small_text_functions(spark):
    assert column(spark, [None, "x"], lambda c: text.text_or_nan(c, True)) == ["nan", "x"] and column(spark, [None], text.text_or_nan) == [None]
    assert column(spark, ["http://a/b#c-d"], text.local_name) == ["b_c_d"] and column(spark, ["#ff8000"], text.hex_colour) == [[255, 128, 0]]


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "processed_1.txt").write_text("about\nmore\nname,Endpoint,v\na,x,1\nb,,2\n\n")
    (tmp_path / "other.txt").write_text("-")
    found = [r.path for r in catalog.files(spark, str(tmp_path), "*.txt", "processed").collect()]
    assert len(found) == 1
    got = catalog.headed_text(spark, found[0], "Endpoint")
    assert got.columns == ["name", "Endpoint", "v"] and [tuple(r) for r in got.collect()] == [("a", "x", "1"), ("b", "", "2")]
    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        db.execute("CREATE TABLE t (a TEXT, b INT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [("x", 1), ("y", 2)])
    assert catalog.sqlite(spark, str(tmp_path / "d.sqlite"), "SELECT a, b FROM t WHERE b > ?", "a string, b int", (1,)).collect()[0].a == "y"
    (tmp_path / "e.json").write_text(json.dumps({"examples": [{"title": "t", "prompt": "p"}]}))
    assert catalog.json_list(spark, str(tmp_path / "e.json"), "examples").first().title == "t"
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "b.parquet"))
    assert catalog.concatenated(spark, str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")).where("x is null").count() == 3
    got.write.csv(str(tmp_path / "c"), header=True)
    assert catalog.csv(spark, str(tmp_path / "c"), "name string, Endpoint string, v int").agg(F.sum("v")).first()[0] == 3


#: Diesters with chains of two to eight carbons, some of them branched or unlike.
PHTHALATES = ["CCOC(=O)C1=CC=CC=C1C(=O)OCC", "CCCCOC(=O)C1=CC=CC=C1C(=O)OCCCC", "CC(C)COC(=O)C1=CC=CC=C1C(=O)OCC(C)C", "CCCCCCOC(=O)C1=CC=CC=C1C(=O)OCCC", "CCC(CC)CCCOC(=O)C1=CC=CC=C1C(=O)OCCCCCC"]


def test_phthalates_match_all_patterns(spark):
    for pattern in (lambda c: chem.matches(c, chem.ACID), lambda c: chem.matches(c, chem.DIMETHYL_ESTER), chem.is_diester):
        assert column(spark, [*PHTHALATES, "CCO", "C1CC(", None], pattern) == [True] * 5 + [False] * 3


def test_molecules():
    assert s.parse("c1ccccc1").n_rings() == 1 and s.circular_fingerprint(s.parse("c1ccccc1")) == s.circular_fingerprint(s.parse("C1=CC=CC=C1"))
    assert s.circular_fingerprint(s.parse("OCC")) == s.circular_fingerprint(s.parse("CCO"))
    water = s.descriptors(s.parse("O"))
    assert abs(water["exact_weight"] - 18.010565) < 1e-5 and s.parse("[Na+].[Cl-]") is not None and s.parse("%") is None
    assert s.descriptors(s.parse("CC(=O)OCC"))["rotatable_bonds"] == 2 and abs(s.descriptors(s.parse("CC(=O)O"))["fraction_sp3"] - 0.5) < 1e-9


def test_services(spark):
    stored = spark.createDataFrame([("abc", [1.0])], "value string, embedding array<float>")
    texts = spark.createDataFrame([("abc",), ("zz",)], "t string")
    assert {r.t: r.embedding for r in services.embedded(texts, "t", stored).collect()} == {"abc": [1.0], "zz": None}
    assert {r.t: r.embedding for r in services.embedded(texts, "t", service=lambda v: [[float(len(x))] for x in v]).collect()} == {"abc": [3.0], "zz": [2.0]}
    compounds = spark.createDataFrame([("Dbp", 2, "i2", [1, 2]), ("dbp", 1, "i1", [1, 2]), ("x", 3, "i3", [2, 3])], "name string, cid int, inchi string, bits array<int>")
    assert {r.name: r.inchi for r in services.looked_up(spark.createDataFrame([("DBP",), ("?",)], "name string"), compounds).collect()} == {"DBP": "i1", "?": None}
    assert services.similar_compounds(spark.createDataFrame([("x",)], "name string"), compounds, 1).count() == 1

    def scorer(batch):
        if (batch["v"] < 0).any():
            raise ValueError("negative")
        return batch["v"] * 2.0

    got = spark.createDataFrame([(1.0,), (-1.0,)], "v double").coalesce(1).mapInPandas(services.safe(scorer), "v double, result double, error string").collect()
    assert {(r.v, r.result, r.error) for r in got} == {(1.0, 2.0, None), (-1.0, None, "negative")}


def test_predictions_are_made_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def scorer(batch: pd.DataFrame) -> pd.Series:
        for i, t in zip(batch["inchi"], batch["property_token"], strict=True):
            (log / f"{i}-{t}").open("a").write("x")
        return batch["property_token"] / 10.0

    table = PredictionTable(spark, str(tmp_path / "p"), scorer)
    pairs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "inchi string, property_token long")
    assert {tuple(r) for r in table.predict(pairs).collect()} == {("a", 1, 0.1), ("b", 2, 0.2)}
    table.predict(pairs.unionByName(spark.createDataFrame([("c", 3)], pairs.schema))).collect()
    assert {p.name: len(p.read_text()) for p in log.iterdir()} == {"a-1": 1, "b-2": 1, "c-3": 1}
    table.append(spark.createDataFrame([("a", 1, 0.3)], "inchi string, property_token long, positive_prediction double"))
    assert abs(table.view().where("inchi = 'a'").first().positive_prediction - 0.2) < 1e-9
    tokens = spark.createDataFrame([(1,), (2,)], "property_token long")
    got = table.predict_all(spark.createDataFrame([("a",), ("n",)], "inchi string"), tokens)
    assert {(r.inchi, r.property_token) for r in got.collect()} == {("a", 1), ("a", 2), ("n", 1), ("n", 2)}
    source = tmp_path / "requests"
    spark.createDataFrame([("s", 5)], pairs.schema).write.parquet(str(source))
    run = table.follow(spark.readStream.schema(pairs.schema).parquet(str(source)), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    assert table.view().where("inchi = 's'").first().positive_prediction == 0.5
