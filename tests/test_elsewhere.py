"""Sources and sinks outside of the lake: endpoints, named graphs, SQL tables, workbooks, services."""

import json
import re
import sqlite3
import threading
import urllib.parse
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerix.functions import services
from orrerix.sources import catalog, graphs, sinks


@pytest.fixture
def store():
    """An endpoint with 25 answers, two of them without a label; the second page fails once."""
    answers, asked = [{"s": f"s{i:02d}", **({"label": f"l{i}"} if i % 13 else {})} for i in range(25)], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            asked.append(query)
            if "COUNT" in query:
                rows = [{"n": str(len(answers))}]
            else:
                n, at = re.search(r"LIMIT (\d+)(?: OFFSET (\d+))?", query).groups()
                low, high = (re.search(rf'STR\(\?s\) {sign} "((?:[^"\\]|\\.)*)"', query) for sign in (">=", "<"))
                text = lambda m: re.sub(r"\\(.)", r"\1", m[1])
                kept = [a for a in (sorted(answers, key=lambda a: a["s"]) if "STR(" in query else answers) if (not low or a["s"] >= text(low)) and (not high or a["s"] < text(high))]
                rows = kept[int(at or 0) : int(at or 0) + int(n)]
            body = json.dumps({"results": {"bindings": [{k: {"type": "literal", "value": v} for k, v in r.items()} for r in rows]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", answers, asked
    server.shutdown()


def test_endpoint_is_read_by_pages(spark, store):
    url, answers, asked = store
    df = graphs.endpoint(spark, graphs.over_http(url), "PREFIX x: <http://x/>", ("s", "label"), "?s x:is x:it . OPTIONAL { ?s x:label ?label }", page=10, at_once=2)
    assert df.rdd.getNumPartitions() == 2
    assert sorted((r.s, r.label) for r in df.collect()) == [(a["s"], a.get("label")) for a in answers]
    assert sum("OFFSET" in q for q in asked) == 3 and all(q.startswith("PREFIX x:") for q in asked)


def test_endpoint_is_read_by_ranges_of_a_key(spark, store):
    """Repeated keys over the ends of pages, more of one key than a page holds, and a quote in a key."""
    url, answers, asked = store
    answers += [{"s": 's04"x', "label": f"again {k}"} for k in range(9)] + [{"s": "s24", "label": f"last {k}"} for k in range(4)]
    df = graphs.endpoint_by_key(spark, graphs.over_http(url), "PREFIX x: <http://x/>", ("s", "label"), "?s x:is x:it . OPTIONAL { ?s x:label ?label }", "s", page=4, at_once=3)
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r.s, r.label) for r in df.collect()), key=key) == sorted(((a["s"], a.get("label")) for a in answers), key=key)
    pages = [q for q in asked if "COUNT" not in q and "OFFSET" not in q]
    assert sum("OFFSET" in q for q in asked) == 2 and len(pages) > 8 and any("LIMIT 16" in q for q in pages) and sum("FILTER" not in q for q in pages) <= 1
    assert graphs.endpoint_by_key(spark, lambda q: [{"n": "0"}], "", ("s",), "?s ?p ?o", "s").collect() == []


def test_endpoint_without_answers(spark):
    assert graphs.endpoint(spark, lambda q: [{"n": "0"}], "", ("s",), "?s ?p ?o").collect() == []


def test_named_graphs(spark, tmp_path):
    kind, path = "s string, p string, o string, o_kind string, o_datatype string", str(tmp_path / "graphs")
    one, two = (spark.createDataFrame([(f"{n}{i}", "p", "o", "iri", None) for i in range(3)], kind) for n in "ab")
    graphs.save_graph(one, path, "one")
    graphs.save_graph(two, path, "two")
    graphs.save_graph(two.limit(1), path, "one")
    assert graphs.load_graph(spark, path, "one").count() == 1 and graphs.load_graph(spark, path, "two").columns == one.columns
    assert sorted(map(tuple, graphs.load_graph(spark, path, "two").collect())) == sorted(map(tuple, two.collect()))


def test_sqlite_append(spark, tmp_path):
    path, df = str(tmp_path / "p.sqlite"), spark.createDataFrame([("a", 1, 0.5), ("b", None, None)], "inchi string, property_token long, positive_prediction double")
    assert sinks.sqlite_append(df, path, "predictions") == sinks.sqlite_append(df, path, "predictions") == 2
    with sqlite3.connect(path) as db:
        assert sorted(db.execute("SELECT * FROM predictions").fetchall(), key=repr) == sorted([("a", 1, 0.5), ("b", None, None)] * 2, key=repr)
    with pytest.raises(ValueError, match="more than 3 rows"):
        catalog.sqlite(spark, path, "SELECT inchi FROM predictions", "inchi string", most=3)


def test_vector_index_is_written_and_read(spark, tmp_path):
    path = str(tmp_path / "index")
    df = spark.createDataFrame([("u", [3.0, 4.0]), ("v", [0.0, 0.0]), ("w", None)], "uri string, embedding array<double>")
    sinks.vector_index(df, path)
    (row,) = sinks.load_vector_index(spark, path).collect()
    assert row.uri == "u" and np.allclose(row.embedding, [0.6, 0.8])
    from orrerix.operators import similarity as sim

    loaded = sinks.load_vector_index(spark, path)
    assert sim.by_index(loaded, spark.createDataFrame([(row["index"],), (5,)], "index long")).count() == 1


def workbook(path, rows=None):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, kind, v: f'<c r="{r}" t="{kind}"><v>{v}</v></c>' if kind != "inlineStr" else f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = rows or [[("A1", "s", 0)], [("A2", "s", 1), ("B2", "s", 2), ("D2", "inlineStr", "note")], [("A3", "n", 1.5), ("D3", "inlineStr", "x")], [], [("B5", "s", 0)]]
    sheet = "".join(f'<row r="{i + 1}">{"".join(cell(*c) for c in row)}</row>' for i, row in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Endpoint Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>about</t></si><si><t>Endpoint</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')


def test_excel_sheet(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    workbook(path)
    df = catalog.excel_sheet(spark, path, "Endpoint Data", "Endpoint")
    assert df.columns == ["Endpoint", "value", "note"] and [tuple(r) for r in df.collect()] == [("1.5", None, "x"), (None, "about", None)]
    for sheet, token, most in (("Endpoint Data", "endpoint", 9), ("other", "Endpoint", 9), ("Endpoint Data", "Endpoint", 1)):
        with pytest.raises(Exception, match="more than 1 rows|no sheet|holds"):
            catalog.excel_sheet(spark, path, sheet, token, most)


def test_workbooks_with_headers_in_different_rows(spark, tmp_path):
    """Two files in two tasks; columns of both headers."""
    workbook(tmp_path / "a.xlsx")
    workbook(tmp_path / "b.xlsx", [[("A1", "n", 7)], [], [("C3", "inlineStr", "value"), ("A3", "inlineStr", "My Endpoint")], [("C4", "n", 3)]])
    df = catalog.workbooks(spark, str(tmp_path / "*.xlsx"), "Endpoint Data", "Endpoint")
    assert df.columns == ["path", "row", "Endpoint", "My Endpoint", "value", "note"]
    got = sorted((r.path[-6:], *tuple(r)[1:]) for r in df.collect())
    assert got == [("a.xlsx", 1, "1.5", None, None, "x"), ("a.xlsx", 3, None, None, "about", None), ("b.xlsx", 1, None, None, "3", None)]
    some = catalog.workbooks(spark, [str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")], "Endpoint Data", "Endpoint", ["value"])
    assert some.columns == ["path", "row", "value"] and some.count() == 3
    assert some.select(F.spark_partition_id().alias("p"), "path").distinct().groupBy("path").count().where("count > 1").count() == 0
    assert "content" not in some.columns and some._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_services_with_a_caller(spark):
    values = spark.createDataFrame([("a",), ("bbb",)], "value string")
    assert {r.value: r.strength for r in services.reranked(values, "p", service=lambda p, v: [len(p + x) for x in v]).collect()} == {"a": 2, "bbb": 4}
    stored = spark.createDataFrame([("p", [1.0, 0.0]), ("a", [0.5, 0.0])], "value string, embedding array<double>")
    assert {r.value: r.strength for r in services.reranked(values, "p", stored).collect()} == {"a": 10, "bbb": 1}
    assays = values.withColumnRenamed("value", "assay")
    assert [tuple(r) for r in services.linked_terms(assays, "e", service=lambda a, e: [(float(len(x)), e + x) for x in a], above=1.5).collect()] == [("bbb", 3.0, "ebbb")]
    for f in (services.reranked, services.linked_terms):
        with pytest.raises(ValueError, match="neither"):
            f(values, "p")


def test_first_synonyms(spark):
    compounds = spark.createDataFrame([("x", [1, 2]), ("y", [1, 2, 3]), ("z", [9])], "name string, bits array<int>")
    synonyms = spark.createDataFrame([("y", "later", 2), ("y", "first", 1)], "name string, synonym string, pos int")
    got = services.first_synonyms(spark.createDataFrame([("x",)], "name string"), compounds, synonyms).collect()
    assert [(r.name, r.similar, round(r.similarity, 3)) for r in got] == [("x", "first", 0.667)]


def test_numbers_of_a_table(spark):
    from orrerix.operators.selection import numbered

    df = spark.range(5).select(F.col("id").alias("k"))
    assert [r.id for r in numbered(df, "k").orderBy("k").collect()] == [0, 1, 2, 3, 4]
