"""Ranking of pathway events and outcomes for entities against a prompt."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as rel
from ..operators import similarity as sim
from ..operators.cells import Cells


@dataclass(frozen=True)
class Domain:
    """The tables that ranking reads.

    vectors(index, uri, embedding); pathways(aop, mie, ao, mie_title);
    predictions(inchi, property_token, positive_prediction), pairs repeated at
    times; properties(uri, token, title), several tokens to a uri; titles(uri, title).
    """

    vectors: DataFrame
    pathways: DataFrame
    predictions: DataFrame
    properties: DataFrame

    @property
    def mies(self) -> DataFrame:
        return self.pathways.select(F.col("mie").alias("uri")).distinct()

    @property
    def one_property(self) -> DataFrame:
        """One token and title for each property uri: those of the smallest token."""
        return rel.first_per_group(self.properties, "uri", ["token", "title"])

    @property
    def averaged(self) -> DataFrame:
        """Predictions as they are read: repeated ones averaged."""
        return rel.mean(self.predictions, ["inchi", "property_token"], "positive_prediction", "prediction")


def property_cells(domain: Domain, path: str) -> Cells:
    """An index of the properties' vectors, written to ``path``, for any number of look-ups."""
    return Cells.build(domain.vectors.join(domain.properties.select("uri").distinct(), "uri", "left_semi"), path)


def link_properties(domain: Domain, k: int = 3, above: float | None = None, cells: Cells | None = None) -> DataFrame:
    """(mie, property_uri, similarity): the k properties nearest to each event; of an index of their vectors only what can be among these is read."""
    if cells is not None:
        asked = domain.vectors.join(domain.mies.select("uri").distinct(), "uri", "left_semi").select(F.col("uri").alias("source"), "embedding")
        return cells.nearest(asked, k, "uri", above).select(F.col("source").alias("mie"), F.col("target").alias("property_uri"), "similarity")
    pairs = sim.uri_similars(domain.vectors, domain.mies, domain.properties, above)
    named = pairs.select(F.col("source").alias("mie"), F.col("target").alias("property_uri"), "similarity")
    return rel.top_per_group(named, "mie", k, F.desc("similarity"), "property_uri")


def best_event_per_property(domain: Domain, above: float = 0.5) -> DataFrame:
    """(mie, property_uri, similarity): the nearest event of each property."""
    pairs = sim.uri_similars(domain.vectors, domain.mies, domain.properties, above)
    named = pairs.select(F.col("source").alias("mie"), F.col("target").alias("property_uri"), "similarity")
    return rel.best_per_key(named, "property_uri", F.desc("similarity"), "mie")


def all_predictions(domain: Domain, chemicals: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(mie, property_uri, chemical_name, similarity, prediction, weight) for chemicals(inchi, name)."""
    links = links if links is not None else link_properties(domain)
    uris = domain.one_property.select(F.col("uri").alias("property_uri"), F.col("token").alias("property_token"))
    named = chemicals.select("inchi", F.col("name").alias("chemical_name"))
    made = domain.averaged.join(uris, "property_token").join(named, "inchi").join(links, "property_uri")
    return made.select("mie", "property_uri", "chemical_name", "similarity", "prediction", (F.col("similarity") * F.col("prediction")).alias("weight"))


def property_predictions(domain: Domain, predictions: DataFrame, prompt: list[float] | DataFrame, n: int = 20, k: int = 10_000, above: float | None = 0.2, phrases: Column | None = None) -> DataFrame:
    """(uri, title, chemical_name, prediction) of the n properties nearest to the prompt.

    ``phrases`` narrows properties to titles that hold a quoted phrase of it.
    """
    own = domain.one_property
    targets = own if phrases is None else own.where(text.holds_phrase(F.col("title"), phrases))
    near = sim.prompt_similars(domain.vectors, prompt, targets, k)
    best = rel.top(near if above is None else near.where(F.col("similarity") > above), n, F.desc("similarity"), "uri")
    rows = predictions.select(F.col("property_uri").alias("uri"), "chemical_name", "prediction").distinct().join(best.select("uri"), "uri", "left_semi")
    return rows.join(rel.numbered_repeats(own.select("uri", "title"), "title", ["uri"]), "uri").select("uri", "title", "chemical_name", "prediction")


def event_predictions(domain: Domain, predictions: DataFrame, prompt: list[float] | DataFrame, n: int = 20, k: int = 10_000, above: float = 0.2, title_chars: int = 40) -> DataFrame:
    """(uri, title, chemical_name, prediction): mean predictions of the n events that the prompt reaches by event, outcome and pathway.

    Events are ranked by their pathways' similarity; the prompt must be near the
    event and one of its outcomes as well.  Titles are cut, and cut titles that
    fall together within a chemical get a number.
    """

    # one search for all three: Spark runs the exchange of its few best uris once
    found = sim.hits(domain.vectors, prompt, k).where(F.col("similarity") > above)

    def near(column: str) -> DataFrame:
        return found.withColumnRenamed("uri", column)

    by_event = rel.kept_in(domain.pathways, near("mie"), "mie").select("mie")
    by_outcome = rel.kept_in(domain.pathways, near("ao"), "ao").select("mie")
    ranked = domain.pathways.join(near("aop"), "aop").groupBy("mie", "mie_title").agg(F.max("similarity").alias("similarity"))
    for kept in (by_event, by_outcome, predictions.select("mie")):
        ranked = ranked.join(kept, "mie", "left_semi")
    best = rel.top(ranked, n, F.desc("similarity"), "mie")
    rows = rel.mean(predictions.join(best.select("mie", "mie_title"), "mie"), ["mie", "mie_title", "chemical_name"], "prediction")
    cut = rows.select(F.col("mie").alias("uri"), F.substring("mie_title", 1, title_chars).alias("title"), "chemical_name", "prediction")
    return rel.numbered_repeats(cut, "title", ["uri"], ["chemical_name"], " ")


def event_predictions_max(domain: Domain, predictions: DataFrame, prompt: list[float] | DataFrame, n: int = 30, k: int = 10_000, above: float = 0.4, title_chars: int = 40) -> DataFrame:
    """(uri, title, chemical_name, prediction): largest predictions, for the n events with the largest sums of them, by event similarity alone."""
    near = sim.prompt_similars(domain.vectors, prompt, domain.mies, k).where(F.col("similarity") > above)
    titles = domain.pathways.select("mie", "mie_title").distinct().join(near.withColumnRenamed("uri", "mie"), "mie", "left_semi")
    rows = rel.largest(predictions.join(titles, "mie"), ["mie", "mie_title", "chemical_name"], "prediction")
    return rel.top_keys_by_total(rows.select(F.col("mie").alias("uri"), F.substring("mie_title", 1, title_chars).alias("title"), "chemical_name", "prediction"), "uri", "prediction", n)


def by_chemical(rows: DataFrame) -> DataFrame:
    """(chemical_name, prediction): sums of predictions."""
    return rel.total(rows, "chemical_name", "prediction")


def _of(predictions: DataFrame, inchi: object) -> DataFrame:
    """The predictions of one entity, by its key or a table that holds it."""
    return rel.kept_in(predictions, inchi, "inchi") if isinstance(inchi, DataFrame) else predictions.where(F.col("inchi") == inchi)


def properties_for_events(domain: Domain, inchi: object, events: DataFrame, above: float = 0.4, active: float = 0.8) -> DataFrame:
    """(mie, property_uri, title, mie_title, similarity, prediction, weight): active properties of one entity near the events(mie)."""
    pairs = sim.uri_similars(domain.vectors, events.select(F.col("mie").alias("uri")), domain.properties, above)
    own = _of(domain.averaged, inchi).where(F.col("prediction") > active).join(domain.one_property.withColumnRenamed("token", "property_token"), "property_token")
    titles = domain.pathways.select("mie", "mie_title").distinct()
    made = pairs.join(own, F.col("target") == F.col("uri")).withColumnRenamed("source", "mie").join(titles, "mie")
    return made.select("mie", F.col("uri").alias("property_uri"), "title", "mie_title", "similarity", "prediction", (F.col("similarity") * F.col("prediction")).alias("weight"))


def adverse_outcomes(domain: Domain, prompt: list[float] | DataFrame, inchi: object, titles: DataFrame, near: float = 0.4, above: float = 0.4, k: int = 2000, active: float = 0.8) -> DataFrame:
    """(ao, title, weight, relevant_predicted_properties): outcomes near the prompt by what one entity's properties weigh on their events.

    A property near several events counts for each, and an event adds to each of
    its outcomes; outcomes without a title are left out.
    """
    found = sim.prompt_similars(domain.vectors, prompt, domain.pathways.select(F.col("ao").alias("uri")).distinct(), k).where(F.col("similarity") > near)
    events = rel.kept_in(domain.pathways, found, "ao", "uri").select("ao", "mie").distinct()
    weights = properties_for_events(domain, inchi, events.select("mie").distinct(), above, active)
    per = weights.groupBy("mie").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    out = events.join(per, "mie").groupBy("ao").agg(F.sum("weight").alias("weight"), F.sum("n").alias("relevant_predicted_properties"))
    return out.join(titles.select(F.col("uri").alias("ao"), "title"), "ao").select("ao", "title", "weight", "relevant_predicted_properties")


def event_weights(domain: Domain, events: DataFrame, inchi: object, above: float = 0.4, active: float = 0.8) -> DataFrame:
    """(pos, mie, weight) for events(pos, mie): summed weights, 0 where an event has none, in the caller's order by pos."""
    found = properties_for_events(domain, inchi, events.select("mie").distinct(), above, active)
    return rel.with_default(events, rel.total(found, "mie", "weight"), "mie", "weight").select("pos", "mie", "weight")


def property_uris_of(domain: Domain, inchi: object, uris: DataFrame) -> DataFrame:
    """(uri, title, prediction) of one entity for uris(uri)."""
    own = rel.kept_in(domain.one_property, uris, "uri").withColumnRenamed("token", "property_token")
    return _of(domain.averaged, inchi).join(own, "property_token").select("uri", "title", "prediction")


def outcome_events(domain: Domain, ao: object) -> DataFrame:
    return domain.pathways.where(F.col("ao") == ao).select("mie").distinct()


def uri_title(domain: Domain, uri: object) -> DataFrame:
    """(uri, title) of one property uri: the title of its smallest token."""
    return domain.one_property.where(F.col("uri") == uri).select("uri", "title")


def compared_analogues(domain: Domain, names: DataFrame, compounds: DataFrame, uris: tuple, n: int = 10) -> DataFrame:
    """(chemical_name, x, y): predictions of two properties for each asked compound and the n compounds most like it.

    names(name) are asked for; compounds(name, inchi, bits) are what is known.  A
    compound appears once, however many it resembles; where a prediction is
    missing the cell is null, and a compound without either isn't there.
    """
    from ..functions.services import similar_compounds

    near = similar_compounds(names, compounds, n).select(F.col("similar").alias("name"))
    asked = rel.kept_in(compounds, names.select("name").unionAll(near).distinct(), "name").select("name", "inchi")
    tokens = domain.one_property.where(F.col("uri").isin(*uris)).select("uri", F.col("token").alias("property_token"))
    cells = domain.averaged.join(tokens, "property_token").join(asked, "inchi").select(F.col("name").alias("chemical_name"), F.when(F.col("uri") == uris[0], "x").otherwise("y").alias("axis"), "prediction")
    return rel.pivot(cells, "chemical_name", "axis", "prediction", ["x", "y"])
