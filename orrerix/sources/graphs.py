"""Graphs that live elsewhere: behind a query endpoint, or in a table of named graphs."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One answer of an endpoint: the bindings of a query from an offset on.
Fetch = Callable[[str], list[dict[str, str | None]]]


def over_http(url: str, timeout: float = 60.0) -> Fetch:
    """Ask an endpoint by the standard protocol for JSON results; unbound variables are absent."""

    def fetch(query: str) -> list[dict[str, str | None]]:
        body = urllib.parse.urlencode({"query": query}).encode()
        asked = urllib.request.Request(url, body, {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"})
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            found = json.load(answer)
        return [{k: v["value"] for k, v in row.items()} for row in found["results"]["bindings"]]

    return fetch


def endpoint(spark: SparkSession, fetch: Fetch, prefixes: str, select: tuple[str, ...], where: str, page: int = 10_000, at_once: int = 4) -> DataFrame:
    """The answer to a query, a text column for each variable of ``select`` (without question marks), read page by page on the executors.

    The endpoint is asked for the number of answers first, then each page is a
    request of its own, in the order of all variables, and at most ``at_once`` run
    at a time.  A page that fails is asked for again by Spark's retries.
    """
    variables = " ".join(f"?{v}" for v in select)
    (count,) = fetch(f"{prefixes} SELECT (COUNT(*) AS ?n) WHERE {{ SELECT {variables} WHERE {{ {where} }} }}")
    pages = -(-int(count["n"]) // page)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"]:
                rows = fetch(f"{prefixes} SELECT {variables} WHERE {{ {where} }} ORDER BY {variables} LIMIT {page} OFFSET {k * page}")
                yield pd.DataFrame([[r.get(v) for v in select] for r in rows], columns=list(select), dtype=object)

    return spark.range(0, pages, 1, max(1, min(at_once, pages))).mapInPandas(run, ", ".join(f"`{v}` string" for v in select))


def endpoint_by_key(spark: SparkSession, fetch: Fetch, prefixes: str, select: tuple[str, ...], where: str, key: str, page: int = 10_000, at_once: int = 4) -> DataFrame:
    """As ``endpoint``, in ranges of the text of one variable that every answer binds, each a task's.

    The endpoint is asked for as many bounds as there are ranges, and a task
    walks its range by ``FILTER`` on the last key that it has seen, so no page
    costs the skipping of those before it.  Answers that share the last key of a
    full page are asked for anew with the next one; where all of a page share
    one, a page of twice the size is asked for.  A task that is started anew
    begins its own range only.
    """
    variables, text = " ".join(f"?{v}" for v in select), f"STR(?{key})"
    (count,) = fetch(f"{prefixes} SELECT (COUNT(*) AS ?n) WHERE {{ SELECT {variables} WHERE {{ {where} }} }}")
    n = int(count["n"])
    parts = max(1, min(at_once, -(-n // page)))
    keys = [fetch(f"{prefixes} SELECT {variables} WHERE {{ {where} }} ORDER BY {text} LIMIT 1 OFFSET {n * k // parts}")[0][key] for k in range(1, parts)]
    bounds = sorted({*keys})
    ranges = list(zip([None, *bounds], [*bounds, None], strict=True)) if n else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high in zip(frame["low"], frame["high"], strict=True):
                low, size = low if isinstance(low, str) else None, page
                while True:
                    limits = [f"{text} >= {_quoted(low)}"] if low is not None else []
                    limits += [f"{text} < {_quoted(high)}"] if isinstance(high, str) else []
                    within = f"FILTER({' && '.join(limits)})" if limits else ""
                    rows = fetch(f"{prefixes} SELECT {variables} WHERE {{ {where} {within} }} ORDER BY {text} LIMIT {size}")
                    full = len(rows) == size
                    if full and rows[0][key] == rows[-1][key]:
                        size *= 2
                        continue
                    done = [r for r in rows if not full or r[key] != rows[-1][key]]
                    yield pd.DataFrame([[r.get(v) for v in select] for r in done], columns=list(select), dtype=object)
                    if not full:
                        break
                    low, size = rows[-1][key], page

    asked_ranges = spark.createDataFrame(ranges, "low string, high string").repartition(max(1, len(ranges)), F.col("low"), F.col("high"))
    return asked_ranges.mapInPandas(run, ", ".join(f"`{v}` string" for v in select))


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'


def save_graph(triples: DataFrame, path: str, identifier: str) -> None:
    """Keep triples as a named graph of a table at ``path``; a graph of that name is replaced, others stay."""
    spark, rows = triples.sparkSession, triples.withColumn("graph", F.lit(identifier))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("graph").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def load_graph(spark: SparkSession, path: str, identifier: str) -> DataFrame:
    """The triples of a named graph; only its own files are read."""
    return spark.read.parquet(path).where(F.col("graph") == identifier).drop("graph")
