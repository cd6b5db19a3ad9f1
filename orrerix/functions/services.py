"""Places for what the network would give: embeddings, reranking, predictions, compound look-up.

Each takes a table that stands in for the service; a caller with a service
passes a function of a batch instead, which runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import top_per_group
from .vector import dot, tanimoto_sets

#: Characters of a text that an embedding sees.
EMBEDDED_CHARS = 10_000


def embedded(texts: DataFrame, text: str, stored: DataFrame | None = None, service: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``texts`` with an ``embedding`` of the first EMBEDDED_CHARS characters: from stored(value, embedding), or by a service."""
    cut = texts.withColumn("value", F.substring(text, 1, EMBEDDED_CHARS))
    if service is None:
        if stored is None:
            raise ValueError("neither stored vectors nor a service")
        return cut.join(stored.select("value", "embedding"), "value", "left").drop("value")

    @F.pandas_udf("array<float>")
    def ask(values: pd.Series) -> pd.Series:
        return pd.Series(service(values.tolist()))

    return cut.withColumn("embedding", ask("value")).drop("value")


def strengths(similars: DataFrame, group: str, value: str = "similarity") -> DataFrame:
    """Similarities as strengths from 1 to 10 within a group, ten the nearest: the offline stand-in for a reranker."""
    return similars.withColumn("strength", 11 - F.ntile(10).over(Window.partitionBy(group).orderBy(F.desc(value), "uri")))


def looked_up(names: DataFrame, compounds: DataFrame) -> DataFrame:
    """names(name) with the inchi of compounds(name, cid, inchi): of several the one with the smallest cid; unknown names raise nothing and have null."""
    one = compounds.groupBy(F.lower("name").alias("key")).agg(F.min_by("inchi", "cid").alias("inchi"))
    return names.withColumn("key", F.lower("name")).join(one, "key", "left").drop("key")


def similar_compounds(names: DataFrame, compounds: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """(name, similar, similarity): the n compounds most like each named one by their bits, for a stated list of names."""
    asked = names.select("name").distinct().join(compounds, "name").select("name", F.col("bits").alias("own"))
    other = compounds.select(F.col("name").alias("similar"), F.explode(F.array_distinct("bits")).alias("bit"), "bits")
    near = other.join(asked.withColumn("bit", F.explode("own")), "bit").where("name <> similar").select("name", "similar", "own", "bits").distinct()
    scored = near.withColumn("similarity", tanimoto_sets(F.col("own"), F.col("bits"))).where(F.col("similarity") >= least)
    return top_per_group(scored.select("name", "similar", "similarity"), "name", n, F.desc("similarity"), "similar")


def first_synonyms(names: DataFrame, compounds: DataFrame, synonyms: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """(name, similar, similarity): as ``similar_compounds``, with the first of synonyms(name, synonym, pos) for each one that has any."""
    first = synonyms.groupBy(F.col("name").alias("similar")).agg(F.min_by("synonym", "pos").alias("first"))
    return similar_compounds(names, compounds, n, least).join(first, "similar", "left").select("name", F.coalesce("first", "similar").alias("similar"), "similarity")


def reranked(values: DataFrame, prompt: str, stored: DataFrame | None = None, service: Callable[[str, list[str]], list[int]] | None = None) -> DataFrame:
    """values(value) with a strength from 1 to 10 for the prompt.

    A service gives strengths of a batch of values.  Without one, the prompt and
    the values are looked up in stored(value, embedding), and tenths of the
    values by nearness to the prompt get ten to one; a value without a vector,
    and every value of a prompt without one, has strength 1.
    """
    if service is not None:

        @F.pandas_udf("int")
        def ask(batch: pd.Series) -> pd.Series:
            return pd.Series(service(prompt, batch.tolist()))

        return values.withColumn("strength", ask("value"))
    if stored is None:
        raise ValueError("neither stored vectors nor a service")
    asked = stored.where(F.col("value") == prompt).select(F.col("embedding").alias("asked for")).limit(1)
    near = values.select("value").distinct().join(stored.select("value", "embedding"), "value").join(F.broadcast(asked))
    placed = near.select("value", dot(F.col("embedding"), F.col("asked for")).alias("similarity"))
    ranked = placed.select("value", (11 - F.ntile(10).over(Window.orderBy(F.desc("similarity"), "value"))).alias("strength"))  # a prompt's own few values
    return values.join(ranked, "value", "left").withColumn("strength", F.coalesce("strength", F.lit(1)))


def linked_terms(assays: DataFrame, event: str, stored: DataFrame | None = None, service: Callable[[list[str], str], list[tuple[float, str]]] | None = None, above: float = 0.0) -> DataFrame:
    """(assay, relevance_score, explanation) of assays(assay) for an event, those above a score, best first.

    A service gives score and explanation of a batch; without one the score is
    the similarity of stored(value, embedding), and the explanation says so.
    """
    if service is not None:

        @F.pandas_udf("relevance_score double, explanation string")
        def ask(batch: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(service(batch.tolist(), event), columns=["relevance_score", "explanation"])

        made = assays.select("assay", ask("assay").alias("found")).select("assay", "found.*")
    else:
        if stored is None:
            raise ValueError("neither stored vectors nor a service")
        asked = stored.where(F.col("value") == event).select(F.col("embedding").alias("asked for")).limit(1)
        near = assays.select("assay").distinct().join(stored.select(F.col("value").alias("assay"), "embedding"), "assay").join(F.broadcast(asked))
        scored = near.select("assay", dot(F.col("embedding"), F.col("asked for")).alias("relevance_score"))
        made = scored.withColumn("explanation", F.format_string("similarity %.2f of the stored vectors", F.col("relevance_score")))
    return made.where(F.col("relevance_score") > above).orderBy(F.desc("relevance_score"), "assay")


def safe(scorer: Callable[[pd.DataFrame], pd.Series], reads: list[str] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas``: a batch with ``result`` and ``error``; a batch that fails is tried in halves, down to the rows that fail by themselves.

    ``reads`` names the columns that a row's score depends on: rows of a batch
    that have them alike are then scored once, so a row that fails costs no
    calls for each of its copies.
    """

    def scored(batch: pd.DataFrame) -> tuple[list, list]:
        results, errors, parts = [None] * len(batch), [None] * len(batch), [(0, len(batch))]
        while parts:
            start, end = parts.pop()
            part = batch.iloc[start:end]
            try:
                results[start:end] = part.assign(result=scorer(part))["result"].tolist()
            except Exception as e:
                if end - start > 1:
                    middle = (start + end) // 2
                    parts += [(middle, end), (start, middle)]
                elif end > start:  # the row's error is its result
                    errors[start] = str(e)
        return results, errors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if reads:
                of = batch.groupby(reads, dropna=False, sort=False).ngroup().tolist()  # groups in the order of their first rows
                made = [[x[k] for k in of] for x in scored(batch[~batch.duplicated(reads)])]
            else:
                made = scored(batch)
            yield batch.assign(**{n: pd.Series(v, batch.index, dtype=object) for n, v in zip(("result", "error"), made, strict=True)})

    return run
