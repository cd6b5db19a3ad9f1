"""The registered queries of the engine's own operators and the SQL that they must equal.

Floats are rounded to six places and every order ends in a key, here and there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text, vector
from ..operators import cluster, fingerprints, leaves
from ..operators import relational as rel
from ..operators import similarity as sim
from ..operators.cells import Cells
from ..operators.selection import numbered
from ..sources import sqlite
from ..sources import triples as nt
from ..sources.catalog import Catalog
from . import bgp, ranking, stages
from . import domain as dom
from . import store as graph_store

Made = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Made] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, base: str = "") -> Callable[[Callable[[Catalog], DataFrame]], Callable[[Catalog], DataFrame]]:
    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = base + sql
        return f

    return register


def six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


D = dom.SQL

# similarity


@query("SELECT mie, property_uri, round(similarity, 6) AS similarity FROM links", D)
def link_properties_to_mies(c: Catalog) -> DataFrame:
    d = dom.domain(c)
    return ranking.link_properties(d, cells=ranking.property_cells(d, scratch.path(c.spark, "cells"))).select("mie", "property_uri", *six("similarity"))


@query(", m AS (SELECT a.uri AS source, b.uri AS target, max(list_inner_product(a.embedding, b.embedding)) AS similarity FROM vectors a JOIN vectors b ON a.uri IN (SELECT ao FROM pathways) AND b.uri IN (SELECT aop FROM pathways) GROUP BY ALL) SELECT source, target, round(similarity, 6) AS similarity FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) <= 3", D)
def uri_similars_topk(c: Catalog) -> DataFrame:
    paths = dom.pathways(c)
    pairs = sim.uri_similars(dom.vectors(c), paths.select(F.col("ao").alias("uri")), paths.select(F.col("aop").alias("uri")))
    return rel.top_per_group(pairs, "source", 3, F.desc("similarity"), "target").select("source", "target", *six("similarity"))


@query("SELECT mie, property_uri, round(similarity, 6) AS similarity FROM pairs WHERE similarity > 0.2 QUALIFY row_number() OVER (PARTITION BY property_uri ORDER BY similarity DESC, mie) = 1", D)
def best_source_per_target(c: Catalog) -> DataFrame:
    return ranking.best_event_per_property(dom.domain(c), 0.2).select("mie", "property_uri", *six("similarity"))


@query("SELECT uri, round(max(similarity), 6) AS similarity FROM (SELECT * FROM scored ORDER BY similarity DESC, uri LIMIT 100) WHERE uri IN (SELECT mie FROM pathways) GROUP BY uri", D)
def prompt_topk_then_filter(c: Catalog) -> DataFrame:
    return sim.prompt_similars(dom.vectors(c), dom.prompt(c), dom.domain(c).mies, 100).select("uri", *six("similarity"))


@query("SELECT uri, round(max(similarity), 6) AS similarity FROM (SELECT * FROM scored WHERE uri IN (SELECT mie FROM pathways) ORDER BY similarity DESC, uri LIMIT 100) GROUP BY uri", D)
def prompt_filter_then_topk(c: Catalog) -> DataFrame:
    own = rel.kept_in(dom.vectors(c), dom.domain(c).mies, "uri")
    return sim.prompt_similars(own, dom.prompt(c), dom.domain(c).mies, 100).select("uri", *six("similarity"))


@query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(list_extract(v, pos + 1) / norm, 6) AS x, round(norm, 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings), unnest(range(0, len(v))) t(pos)")
def l2_normalize(c: Catalog) -> DataFrame:
    df = c.table("embeddings")
    return df.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.posexplode(vector.normalised(F.col("embedding"))).alias("pos", "value")).select("vec_id", "pos", F.round("value", 6).alias("x"), "norm")


def _labels(c: Catalog) -> DataFrame:
    return c.table("part").select(F.concat_ws(" ", "p_name", "p_type").alias("label")).distinct()


_BITS = "bits AS (SELECT label, list_sort(list_distinct(list_transform(string_split(label, ' '), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 2048))) AS bits FROM (SELECT DISTINCT p_name || ' ' || p_type AS label FROM part)), size AS (SELECT *, len(bits) AS n FROM bits)"
_TANIMOTO = "len(list_intersect(a.bits, b.bits)) / (a.n + b.n - len(list_intersect(a.bits, b.bits)))::DOUBLE"


@query(f"WITH {_BITS} SELECT a.label AS a, b.label AS b, round({_TANIMOTO}, 6) AS similarity FROM size a JOIN size b ON a.label < b.label WHERE {_TANIMOTO} >= 0.5")
def tanimoto_pairs(c: Catalog) -> DataFrame:
    return sim.tanimoto_join(fingerprints.of_words(_labels(c), "label"), "label", "bits", 0.5).select("a", "b", *six("similarity"))


@query(f"WITH {_BITS} SELECT a.label AS i, b.label AS j, round({_TANIMOTO}, 6) AS similarity, round(1 - {_TANIMOTO}, 6) AS distance FROM size a, size b")
def tanimoto_matrix(c: Catalog) -> DataFrame:
    made = sim.pairwise_matrix(fingerprints.of_words(_labels(c), "label"), "label", "bits")
    return made.select("i", "j", *six("similarity"), F.round(vector.distance(F.col("similarity")), 6).alias("distance"))


_EXAMPLES = ["small ring ECONOMY", "red widget SMALL", "blue bolt"]
_EXAMPLE_SQL = ", ".join(f"('{e}')" for e in _EXAMPLES)
_EX = f"{_BITS}, ex AS (SELECT e, list_distinct(list_transform(string_split(e, ' '), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 2048)) AS bits FROM (VALUES {_EXAMPLE_SQL}) t(e)), b AS (SELECT *, len(bits) AS n FROM ex)"


@query(f"WITH {_EX} SELECT label, round(max({_TANIMOTO}), 6) AS max_similarity FROM size a, b GROUP BY label")
def max_similarity_to_examples(c: Catalog) -> DataFrame:
    own = fingerprints.of_words(_labels(c), "label")
    return sim.max_similarity(own, [(e, fingerprints.word_bits(e)) for e in _EXAMPLES], "bits").select("label", *six("max_similarity"))


@query(f"WITH {_EX} SELECT b.e AS example, a.label, round({_TANIMOTO}, 6) AS similarity FROM size a, b WHERE {_TANIMOTO} < 0.95 QUALIFY row_number() OVER (PARTITION BY b.e ORDER BY {_TANIMOTO} DESC, a.label) <= 4")
def nearest_analogues_lt95(c: Catalog) -> DataFrame:
    own = fingerprints.of_words(_labels(c), "label")
    return sim.nearest_analogues(own, [(e, fingerprints.word_bits(e)) for e in _EXAMPLES], "label", "bits").select("example", "label", *six("similarity"))


# ranking


def _all(c: Catalog) -> DataFrame:
    return ranking.all_predictions(dom.domain(c), dom.chemicals(c))


@query("SELECT mie, property_uri, chemical_name, round(similarity, 6) AS similarity, round(prediction, 6) AS prediction, round(weight, 6) AS weight FROM all_predictions", D)
def all_predictions(c: Catalog) -> DataFrame:
    return _all(c).select("mie", "property_uri", "chemical_name", *six("similarity", "prediction", "weight"))


_PROPERTY = "SELECT uri, title, chemical_name, round(prediction, 6) AS prediction FROM (SELECT DISTINCT property_uri AS uri, chemical_name, prediction FROM all_predictions) JOIN titles USING (uri) WHERE uri IN (SELECT uri FROM near WHERE uri IN (SELECT uri FROM one_property{where}){above} ORDER BY similarity DESC, uri LIMIT 4)"


@query(_PROPERTY.format(where="", above=" AND similarity > 0.2"), D)
def property_predictions(c: Catalog) -> DataFrame:
    return ranking.property_predictions(dom.domain(c), _all(c), dom.prompt(c), n=4, k=300).select("uri", "title", "chemical_name", *six("prediction"))


@query(_PROPERTY.format(where=" WHERE contains(lower(title), 'a') OR contains(lower(title), 'o')", above=""), D)
def property_predictions_quoted(c: Catalog) -> DataFrame:
    return ranking.property_predictions(dom.domain(c), _all(c), dom.prompt(c), n=4, k=300, above=None, phrases=F.lit('near "A" or "o')).select("uri", "title", "chemical_name", *six("prediction"))


@query("SELECT uri, title, chemical_name, round(prediction, 6) AS prediction FROM event_predictions", D)
def mie_predictions_mean(c: Catalog) -> DataFrame:
    return ranking.event_predictions(dom.domain(c), _all(c), dom.prompt(c), n=3, k=300).select("uri", "title", "chemical_name", *six("prediction"))


@query(", m AS (SELECT mie AS uri, substr(mie_title, 1, 40) AS title, chemical_name, max(prediction) AS prediction FROM all_predictions JOIN (SELECT DISTINCT mie, mie_title FROM pathways) USING (mie) WHERE mie IN (SELECT uri FROM near WHERE similarity > 0.2) GROUP BY mie, mie_title, chemical_name) SELECT uri, title, chemical_name, round(prediction, 6) AS prediction FROM m WHERE uri IN (SELECT uri FROM m GROUP BY uri ORDER BY sum(prediction) DESC, uri LIMIT 4)", D)
def mie_predictions_max_top4(c: Catalog) -> DataFrame:
    return ranking.event_predictions_max(dom.domain(c), _all(c), dom.prompt(c), n=4, k=300, above=0.2).select("uri", "title", "chemical_name", *six("prediction"))


@query("SELECT chemical_name, round(sum(prediction), 6) AS prediction FROM event_predictions GROUP BY chemical_name", D)
def aggregate_by_chemical(c: Catalog) -> DataFrame:
    return ranking.by_chemical(ranking.event_predictions(dom.domain(c), _all(c), dom.prompt(c), n=3, k=300)).select("chemical_name", *six("prediction"))


def _entity(c: Catalog) -> DataFrame:
    """(inchi): one entity."""
    return c.table("supplier").agg(F.min("s_suppkey").alias("inchi"))


@query("SELECT mie, property_uri, title, mie_title, round(similarity, 6) AS similarity, round(prediction, 6) AS prediction, round(weight, 6) AS weight FROM weighted", D)
def properties_for_mies(c: Catalog) -> DataFrame:
    """With thresholds of 0.2 and 0.5, at which these tables have rows; the operator's own are 0.4 and 0.8."""
    d = dom.domain(c)
    return ranking.properties_for_events(d, _entity(c), d.pathways.select("mie").distinct(), 0.2, 0.5).select("mie", "property_uri", "title", "mie_title", *six("similarity", "prediction", "weight"))


@query(", e AS (SELECT DISTINCT p.ao, p.mie FROM pathways p JOIN near n ON n.uri = p.ao AND n.similarity > 0.2), w AS (SELECT mie, sum(weight) AS weight, count(*) AS n FROM weighted GROUP BY mie) SELECT ao, 'outcome ' || ao AS title, round(sum(weight), 6) AS weight, CAST(sum(n) AS BIGINT) AS relevant_predicted_properties FROM e JOIN w USING (mie) GROUP BY ao", D)
def retrieve_adverse_outcomes(c: Catalog) -> DataFrame:
    """With thresholds at which these tables have rows."""
    d = dom.domain(c)
    titles = d.pathways.select(F.col("ao").alias("uri")).distinct().withColumn("title", F.concat(F.lit("outcome "), F.col("uri").cast("string")))
    made = ranking.adverse_outcomes(d, dom.prompt(c), _entity(c), titles, near=0.2, above=0.2, k=300, active=0.5)
    return made.select("ao", "title", *six("weight"), "relevant_predicted_properties")


@query(", e AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, CAST(n_nationkey % 20 AS BIGINT) AS mie FROM nation) SELECT pos, e.mie, round(coalesce(w.weight, 0), 6) AS weight FROM e LEFT JOIN (SELECT mie, sum(weight) AS weight FROM weighted GROUP BY mie) w ON w.mie = e.mie", D)
def mie_weights_zero_filled(c: Catalog) -> DataFrame:
    events = c.table("nation").select(F.col("n_nationkey").cast("long").alias("pos"), (F.col("n_nationkey") % 20).cast("long").alias("mie"))
    return ranking.event_weights(dom.domain(c), events, _entity(c), 0.2, 0.5).select("pos", "mie", *six("weight"))


@query("SELECT o.uri, o.title, round(a.prediction, 6) AS prediction FROM averaged a JOIN one_property o ON o.token = a.property_token JOIN entity USING (inchi)", D)
def predicted_property_uris(c: Catalog) -> DataFrame:
    wanted = dom.properties(c).select("uri").distinct()
    return ranking.property_uris_of(dom.domain(c), _entity(c), wanted).select("uri", "title", *six("prediction"))


@query("SELECT DISTINCT mie FROM pathways WHERE ao = 25", D)
def ao_mies(c: Catalog) -> DataFrame:
    return ranking.outcome_events(dom.domain(c), 25)


# joins


@query("SELECT o_orderkey, c_name, round(o_totalprice, 6) AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
def inner_diff_keys(c: Catalog) -> DataFrame:
    return rel.inner_on(c.table("orders"), c.table("customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", *six("o_totalprice"))


@query("SELECT l_orderkey AS orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def inner_one_key(c: Catalog) -> DataFrame:
    return rel.inner(c.table("lineitem").withColumnRenamed("l_orderkey", "orderkey"), c.table("orders").withColumnRenamed("o_orderkey", "orderkey"), "orderkey").select("orderkey", "l_linenumber", "o_orderpriority")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_isin(c: Catalog) -> DataFrame:
    return rel.kept_in(c.table("customer"), c.table("orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


_PAIRS = "WITH known AS (SELECT DISTINCT l_suppkey AS inchi, l_partkey % 400 AS token FROM lineitem), tokens AS (SELECT DISTINCT token FROM known), ids AS (SELECT s_suppkey AS inchi FROM supplier)"


def _known(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = c.table("lineitem").select(F.col("l_suppkey").alias("inchi"), (F.col("l_partkey") % 400).alias("token")).distinct()
    return c.table("supplier").select(F.col("s_suppkey").alias("inchi")), known.select("token").distinct(), known


@query(f"{_PAIRS} SELECT inchi, token FROM ids, tokens EXCEPT SELECT inchi, token FROM known")
def anti_missing_pairs(c: Catalog) -> DataFrame:
    ids, tokens, known = _known(c)
    return rel.missing_pairs(rel.product(ids, tokens), known, ["inchi", "token"])


@query(f"{_PAIRS} SELECT DISTINCT inchi FROM (SELECT inchi, token FROM ids, tokens EXCEPT SELECT inchi, token FROM known)")
def any_missing_entities(c: Catalog) -> DataFrame:
    ids, tokens, known = _known(c)
    return rel.any_missing(ids, tokens, known, "inchi", "token")


@query(f"{_PAIRS} SELECT inchi, token FROM ids, tokens")
def cross_product_pairs(c: Catalog) -> DataFrame:
    ids, tokens, _ = _known(c)
    return rel.product(ids, tokens)


@query("SELECT c_custkey, round(coalesce(v, 0), 6) AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def left_default_zero(c: Catalog) -> DataFrame:
    totals = rel.total(c.table("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice", "total")
    return rel.with_default(c.table("customer", "c_custkey"), totals, "c_custkey", "total").select("c_custkey", *six("total"))


@query("SELECT s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")
def sql_three_way(c: Catalog) -> DataFrame:
    c.register("supplier", "nation", "region")
    return c.spark.sql("SELECT s.s_name, n.n_name, r.r_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")


# aggregations


@query("SELECT l_returnflag, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY l_returnflag")
def sum_by_key(c: Catalog) -> DataFrame:
    return rel.total(c.table("lineitem"), "l_returnflag", "l_quantity", "total").select("l_returnflag", *six("total"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY ALL")
def mean_by_keys(c: Catalog) -> DataFrame:
    return rel.mean(c.table("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice", "mean").select("l_returnflag", "l_linestatus", "l_linenumber", *six("mean"))


@query("SELECT l_suppkey, max(l_quantity) AS most FROM lineitem GROUP BY l_suppkey")
def max_by_key(c: Catalog) -> DataFrame:
    return rel.largest(c.table("lineitem"), "l_suppkey", "l_quantity", "most")


@query("SELECT o_orderstatus, round(sum(w), 2) AS weight, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS w, count(o_totalprice) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def two_level_sum_count(c: Catalog) -> DataFrame:
    return rel.two_level(c.table("orders"), ["o_custkey", "o_orderstatus"], "o_orderstatus", "o_totalprice").select("o_orderstatus", F.round("weight", 2).alias("weight"), "n")


@query("SELECT property_token, round(avg(CASE WHEN positive_prediction > 0.6 THEN 1.0 ELSE 0.0 END), 6) AS active FROM preds GROUP BY ALL", D)
def fraction_active(c: Catalog) -> DataFrame:
    return rel.active_share(dom.predictions(c), "property_token", "positive_prediction").select("property_token", *six("active"))


@query("SELECT uri, token, title FROM one_property", D)
def first_per_group(c: Catalog) -> DataFrame:
    return dom.domain(c).one_property


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def distinct_subset_keep_best(c: Catalog) -> DataFrame:
    return rel.best_per_key(c.table("part"), "p_brand", F.desc("p_retailprice"), "p_partkey").select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_rows(c: Catalog) -> DataFrame:
    return c.table("documents").select("lang", "source").distinct()


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def value_counts_gt1(c: Catalog) -> DataFrame:
    return rel.counts(c.table("part"), "p_name", 2)


def _bins(n: int) -> str:
    return f"WITH e AS (SELECT quantile_cont(o_totalprice, {[i / n for i in range(1, n)]}) AS edges FROM orders) SELECT CAST(len(list_filter(e.edges, lambda x: x < o_totalprice)) + 1 AS INTEGER) AS bin, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders, e GROUP BY 1"


def _binned(c: Catalog, n: int) -> DataFrame:
    return rel.quantile_bins(c.table("orders"), "o_totalprice", n).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query(_bins(10))
def quantile_bins_10(c: Catalog) -> DataFrame:
    return _binned(c, 10)


@query(_bins(5))
def quantile_bins_5(c: Catalog) -> DataFrame:
    return _binned(c, 5)


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson_corr(c: Catalog) -> DataFrame:
    return rel.correlation(c.table("lineitem"), "l_quantity", "l_extendedprice").select(*six("r"))


@query("SELECT inchi, round(sum(prediction) / (SELECT count(DISTINCT property_token) FROM averaged), 6) AS mean FROM averaged GROUP BY inchi", D)
def row_mean_filled(c: Catalog) -> DataFrame:
    return rel.filled_mean(dom.domain(c).averaged, "inchi", "property_token", "prediction").select("inchi", *six("mean"))


@query("SELECT label, CAST(pos AS INTEGER) AS pos, round(median(list_extract(embedding, pos + 1)::DOUBLE), 6) AS median FROM embeddings, unnest(range(0, len(embedding))) t(pos) GROUP BY ALL")
def median_by_cluster(c: Catalog) -> DataFrame:
    each = c.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return rel.median(each, ["label", "pos"], "x").select("label", "pos", *six("median"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(c: Catalog) -> DataFrame:
    return rel.counts(c.table("embeddings"), "label")


@query("SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS most, count(*) AS n FROM lineitem")
def global_min_max(c: Catalog) -> DataFrame:
    return c.table("lineitem").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), F.count(F.lit(1)).alias("n"))


# windows and order


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '_' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) ELSE p_name END AS p_name FROM part")
def title_suffix_dups(c: Catalog) -> DataFrame:
    return rel.numbered_repeats(c.table("part", "p_partkey", "p_name"), "p_name", ["p_partkey"])


@query("SELECT p_partkey, p_brand, CASE WHEN count(*) OVER (PARTITION BY p_brand, substr(p_name, 1, 8)) > 1 THEN substr(p_name, 1, 8) || ' ' || row_number() OVER (PARTITION BY p_brand, substr(p_name, 1, 8) ORDER BY p_partkey) ELSE substr(p_name, 1, 8) END AS short FROM part")
def short_title_cumcount(c: Catalog) -> DataFrame:
    cut = c.table("part").select("p_partkey", "p_brand", F.substring("p_name", 1, 8).alias("short"))
    return rel.numbered_repeats(cut, "short", ["p_partkey"], ["p_brand"], " ")


@query("SELECT p_partkey, p_name FROM part QUALIFY count(*) OVER (PARTITION BY p_name) > 1")
def duplicate_mask(c: Catalog) -> DataFrame:
    return rel.repeated(c.table("part", "p_partkey", "p_name"), "p_name")


@query("WITH m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand) SELECT p_brand, p_partkey FROM part JOIN m USING (p_brand) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - m), p_partkey) <= 6")
def nearest_to_median(c: Catalog) -> DataFrame:
    return rel.nearest_to_median(c.table("part"), "p_brand", "p_retailprice", 6, "p_partkey").select("p_brand", "p_partkey")


@query(", m AS (SELECT inchi, sum(prediction) / (SELECT count(DISTINCT property_token) FROM averaged) AS mean FROM averaged GROUP BY inchi) SELECT inchi, inchi % 3 AS cluster, row_number() OVER (ORDER BY inchi % 3, round(mean, 6), inchi) AS place FROM m", D)
def cluster_row_order(c: Catalog) -> DataFrame:
    means = rel.filled_mean(dom.domain(c).averaged, "inchi", "property_token", "prediction").select("inchi", (F.col("inchi") % 3).alias("cluster"), *six("mean"))
    return numbered(means, "cluster", "mean", "inchi", name="place").select("inchi", "cluster", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_head(c: Catalog) -> DataFrame:
    return rel.top(c.table("orders", "o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 30)")
def top_keys_by_total(c: Catalog) -> DataFrame:
    return rel.top_keys_by_total(c.table("orders"), "o_custkey", "o_totalprice", 30).select("o_orderkey", "o_custkey")


# shape and sets


@query("PIVOT (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL) ON status IN ('F', 'O') USING coalesce(first(n), 0) GROUP BY flag")
def pivot_fill_zero(c: Catalog) -> DataFrame:
    cells = c.table("lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return rel.pivot(cells, "flag", "status", "n", ["F", "O"], 0)


@query("SELECT p_partkey AS uri, variable, value FROM (UNPIVOT (SELECT p_partkey, p_name AS title, p_type AS data FROM part) ON title, data INTO NAME variable VALUE value)")
def melt_title_data(c: Catalog) -> DataFrame:
    return rel.melt(c.table("part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("title"), F.col("p_type").alias("data")), ["uri"], ["title", "data"])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(c: Catalog) -> DataFrame:
    return rel.union_distinct(c.table("customer").select(F.col("c_nationkey").alias("k")), c.table("supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT 'c' AS side, c_nationkey AS k, c_acctbal AS bal, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 's', s_nationkey, NULL, s_name FROM supplier")
def union_all(c: Catalog) -> DataFrame:
    a = c.table("customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(c.table("supplier").select(F.lit("s").alias("side"), F.col("s_nationkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def set_difference(c: Catalog) -> DataFrame:
    return rel.difference(c.table("customer", "c_custkey"), c.table("orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")))


@query("WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT c_custkey, least(greatest(c_acctbal, lo), hi) AS c_acctbal FROM customer, b")
def clip_minmax(c: Catalog) -> DataFrame:
    return rel.clip_to_range(c.table("customer", "c_custkey", "c_acctbal"), "c_acctbal", c.table("supplier").select(F.col("s_acctbal").alias("c_acctbal")))


@query("SELECT inchi, round(max(prediction) FILTER (WHERE property_token = 1), 6) AS x, round(max(prediction) FILTER (WHERE property_token = 2), 6) AS y FROM averaged WHERE property_token IN (1, 2) GROUP BY inchi", D)
def pairwise_two_property_pivot(c: Catalog) -> DataFrame:
    two = dom.domain(c).averaged.where(F.col("property_token").isin(1, 2))
    return rel.pivot(two, "inchi", "property_token", "prediction", [1, 2]).select("inchi", F.round("1", 6).alias("x"), F.round("2", 6).alias("y"))


@query("SELECT p_brand, round(sum(v) FILTER (WHERE n_name = 'n0'), 6) AS a, round(sum(v) FILTER (WHERE n_name = 'n1'), 6) AS b FROM (SELECT p_brand, 'n' || (l_suppkey % 2) AS n_name, avg(l_discount) AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size IN (1, 5, 9) GROUP BY ALL) GROUP BY p_brand")
def category_in_list_pivot(c: Catalog) -> DataFrame:
    cells = c.table("lineitem").join(c.table("part").where(F.col("p_size").isin(1, 5, 9)), F.col("p_partkey") == F.col("l_partkey")).withColumn("n_name", F.concat(F.lit("n"), (F.col("l_suppkey") % 2).cast("string")))
    wide = rel.pivot(rel.mean(cells, ["p_brand", "n_name"], "l_discount"), "p_brand", "n_name", "l_discount", ["n0", "n1"])
    return wide.select("p_brand", F.round("n0", 6).alias("a"), F.round("n1", 6).alias("b"))


# graph

_P = {"x": "http://example.org/"}


def _triples(c: Catalog) -> DataFrame:
    iri = lambda kind, key: F.concat(F.lit(f"http://example.org/{kind}/"), F.col(key).cast("string"))
    of = lambda kind, key, name, extra: nt.construct(c.table(kind), iri(kind, key), {bgp.TYPE: (F.lit(f"http://example.org/{kind.title()}"), "iri", None), "http://example.org/name": (F.col(name), "literal", None), **extra})
    customers = of("customer", "c_custkey", "c_name", {"http://example.org/in_nation": (iri("nation", "c_nationkey"), "iri", None), "http://example.org/segment": (F.col("c_mktsegment"), "literal", None)})
    nations = of("nation", "n_nationkey", "n_name", {"http://example.org/in_region": (iri("region", "n_regionkey"), "iri", None), "http://example.org/code": (F.col("n_nationkey"), "literal", "http://www.w3.org/2001/XMLSchema#integer")})
    return nt.add_triples(nt.add_triples(customers, nations), of("region", "r_regionkey", "r_name", {}))


_CUSTOMER, _NATION, _REGION = (f"'http://example.org/{k}/' || " for k in ("customer", "nation", "region"))


@query(f"SELECT {_CUSTOMER}c_custkey AS c, c_name AS name, c_mktsegment AS segment FROM customer")
def bgp_star(c: Catalog) -> DataFrame:
    return bgp.Query(_triples(c), _P).select("?c", "?name", "?segment").where("?c a x:Customer").where("?c x:name ?name").where("?c x:segment ?segment").execute()


@query(f"SELECT a.c_custkey AS a, {_REGION}n_regionkey AS region FROM (SELECT {_CUSTOMER}c_custkey AS c_custkey, c_nationkey FROM customer) a JOIN nation ON n_nationkey = c_nationkey")
def bgp_two_hop(c: Catalog) -> DataFrame:
    return bgp.Query(_triples(c), _P).select("?a", "?region").where("?a x:in_nation ?n . ?n x:in_region ?region").execute()


@query("SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def bgp_five_pattern(c: Catalog) -> DataFrame:
    q = bgp.Query(_triples(c), _P).select("?customer", "?nation", "?region")
    return q.where("?c x:name ?customer").where("?c x:in_nation ?n").where("?n x:name ?nation").where("?n x:in_region ?r").where("?r x:name ?region").execute()


@query("SELECT c_name AS customer, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'")
def bgp_by_predicate(c: Catalog) -> DataFrame:
    """Patterns over a graph stored by predicate, written worst first."""
    q = graph_store.build(_triples(c), scratch.path(c.spark, "graph")).query(_P).select("?customer", "?region")
    return q.where("?c x:name ?customer").where("?r x:name ?region").where("?n x:in_region ?r").where("?c x:in_nation ?n").where('FILTER(?region != "ASIA")').execute()


@query("SELECT c_name AS name FROM customer WHERE c_nationkey = 3")
def bgp_const_object(c: Catalog) -> DataFrame:
    return bgp.Query(_triples(c), _P).select("?name").where("?c x:in_nation <http://example.org/nation/3>").where("?c x:name ?name").execute()


@query(f"SELECT {_CUSTOMER}c_custkey AS s, 'http://example.org/name' AS p, c_name AS v FROM customer UNION ALL SELECT {_CUSTOMER}c_custkey, 'http://example.org/segment', c_mktsegment FROM customer")
def bgp_filter_or(c: Catalog) -> DataFrame:
    return bgp.Query(_triples(c), _P).select("?s", "?p", "?v").where("?s a ?t").where("?s ?p ?v").where("FILTER(?t = x:Customer && (?p = x:name || ?p = x:segment))").execute()


@query("SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS name FROM nation")
def bgp_typed(c: Catalog) -> DataFrame:
    return bgp.Query(_triples(c), _P).select_typed({"code": int, "name": str}).where("?n x:code ?code").where("?n x:name ?name").execute()


@query(f"SELECT s, p, o, o_kind, CASE WHEN p LIKE '%code' THEN 'http://www.w3.org/2001/XMLSchema#integer' END AS o_datatype FROM (SELECT {_NATION}n_nationkey AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://example.org/Nation' AS o, 'iri' AS o_kind FROM nation UNION ALL SELECT {_NATION}n_nationkey, 'http://example.org/name', n_name, 'literal' FROM nation UNION ALL SELECT {_NATION}n_nationkey, 'http://example.org/in_region', {_REGION}n_regionkey, 'iri' FROM nation UNION ALL SELECT {_NATION}n_nationkey, 'http://example.org/code', CAST(n_nationkey AS VARCHAR), 'literal' FROM nation)")
def construct_triples(c: Catalog) -> DataFrame:
    return _triples(c).where(F.col("s").startswith("http://example.org/nation/"))


@query("SELECT * FROM (VALUES ('http://example.org/Customer', 'http://example.org/in_nation', 'http://example.org/Nation'), ('http://example.org/Customer', 'http://example.org/name', NULL), ('http://example.org/Customer', 'http://example.org/segment', NULL), ('http://example.org/Nation', 'http://example.org/code', NULL), ('http://example.org/Nation', 'http://example.org/in_region', 'http://example.org/Region'), ('http://example.org/Nation', 'http://example.org/name', NULL), ('http://example.org/Region', 'http://example.org/name', NULL)) t(class, predicate, target)")
def schema_summary(c: Catalog) -> DataFrame:
    return bgp.schema_summary(_triples(c))


@query("SELECT 'http://example.org/name' AS p, n_name AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://example.org/code', '3' UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/Nation' UNION ALL SELECT 'http://example.org/in_region', 'http://example.org/region/' || n_regionkey FROM nation WHERE n_nationkey = 3")
def describe_subject(c: Catalog) -> DataFrame:
    return bgp.describe(_triples(c), "http://example.org/nation/3")


# text and JSON


@query("SELECT p_brand AS brand, a[1] AS alias, arg_max(a[2], p_partkey) AS name FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_name, p_name] ELSE [p_type, p_name] END AS a FROM part) GROUP BY ALL")
def parse_alias_list(c: Catalog) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_name")).otherwise(F.concat("p_type", F.lit(" :  "), "p_name", F.lit("\t")))
    lists = c.table("part").select("p_brand", "p_partkey", line.alias("line")).groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n \n").alias("text"))
    return text.alias_list(lists, "brand", "text")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://example.org/assay/ice/' || replace(p_name, ' ', '_') WHEN 1 THEN 'u' || p_size WHEN 2 THEN 'https://example.org/assay/pubchem/' || p_size WHEN 3 THEN 'https://example.org/assay/chembl/C' || p_size END AS uri FROM part WHERE p_partkey % 5 < 4")
def uri_case_by_source(c: Catalog) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("ice", "bindingdb", "pubchem", "chembl", "other"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    data = F.to_json(F.struct(F.concat(F.lit("u"), "p_size").alias("Link to Target in BindingDB"), F.col("p_size").cast("double").alias("aid"), F.concat(F.lit("C"), "p_size").alias("chembl_id")))
    return c.table("part").select("p_partkey", text.assay_uri(source, F.col("p_name"), data).alias("uri")).where("uri is not null")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS value FROM part")
def json_fallback_keys(c: Catalog) -> DataFrame:
    q = lambda x: F.concat(F.lit('"'), F.col(x), F.lit('"'))
    data = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('{"CAS": "no", "casrn": '), q("p_brand"), F.lit("}"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('{"CasRN": ['), q("p_type"), F.lit(', "x"]}'))).when(F.col("p_partkey") % 4 == 2, F.lit('{"casrn": null, "CAS": "5"}')).otherwise(F.lit("not json"))
    return c.table("part").select("p_partkey", text.first_key_present(data, "casrn", "CasRN", "CAS").alias("value"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red w') OR contains(lower(p_name), 'bolt')")
def quoted_phrase_filter(c: Catalog) -> DataFrame:
    return c.table("part", "p_partkey", "p_name").where(text.holds_phrase(F.col("p_name"), F.lit('parts "RED W" or "bolt" please')))


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, 'S.A')")
def regex_contains(c: Catalog) -> DataFrame:
    return c.table("part", "p_partkey", "p_type").where(F.col("p_type").rlike("S.A"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(c: Catalog) -> DataFrame:
    return c.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# without SQL: tests compare them with plain programs


@query()
def kmeans_rows(c: Catalog) -> DataFrame:
    df = c.table("embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)))
    return cluster.kmeans(df, [f"x{i}" for i in range(64)]).select("vec_id", "cluster")


@query()
def average_linkage_clusters(c: Catalog) -> DataFrame:
    return cluster.clusters_of_sets(fingerprints.of_words(_labels(c), "label"), "label", "bits").select("key", F.col("cluster").cast("int").alias("cluster"))


@query()
def ward_leaf_order(c: Catalog) -> DataFrame:
    cells = c.table("lineitem").join(c.table("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_size").agg(F.avg("l_discount").alias("v"))
    return leaves.order(cells, "p_brand", "p_size", "v")


#: Three predictors, solved by Cramer's rule on their covariances.
_PLANE = (
    "WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y FROM lineitem), "
    "m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(c, c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy FROM d), "
    "det AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m), "
    "w AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS wa, (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS wb, (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS wc FROM det)"
)


@query(f"{_PLANE} SELECT l_orderkey, l_linenumber, round(my + wa * (a - ma) + wb * (b - mb) + wc * (c - mc), 3) AS predicted FROM d, w")
def linreg_predict(c: Catalog) -> DataFrame:
    df = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    made, _ = cluster.regression(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return made.select("l_orderkey", "l_linenumber", F.round("predicted", 3).alias("predicted"))


def _molecules(c: Catalog) -> DataFrame:
    """Esters with chains as long as a part's size, every third a phthalate."""
    chain = F.repeat(F.lit("C"), F.col("p_size"))
    smiles = F.when(F.col("p_partkey") % 3 == 0, F.concat(chain, F.lit("OC(=O)C1=CC=CC=C1C(=O)O"), chain)).when(F.col("p_partkey") % 3 == 1, F.concat(chain, F.lit("C(=O)OC"))).otherwise(F.lit("C1CC("))
    return c.table("part").select("p_partkey", "p_size", smiles.alias("smiles"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS phthalate, p_partkey % 3 = 0 AS dimethyl, p_partkey % 3 = 0 AND p_size > 1 AS diester, p_partkey % 3 < 2 AND p_size > 2 AS chain, p_partkey % 3 < 2 AS readable FROM part")
def substructure_filter(c: Catalog) -> DataFrame:
    from ..chem import columns as chem

    df = _molecules(c)
    of = F.col("smiles")
    chain = chem.matches_smarts(of, "[CH3][CH2][CH2,CH]")
    made = chem.once(df, "smiles", phthalate=chem.matches(of, chem.ACID), dimethyl=chem.matches(of, chem.DIMETHYL_ESTER), diester=chem.is_diester(of), chain=chain, readable=chem.readable(of))
    return made.select("p_partkey", "phthalate", "dimethyl", "diester", "chain", "readable")


@query()
def morgan_tanimoto(c: Catalog) -> DataFrame:
    from ..chem import columns as chem

    own = scratch.stored(chem.texts(_molecules(c), "smiles").withColumn("bits", chem.fingerprint(F.col("smiles"))), "molecules")
    return sim.tanimoto_join(own, "smiles", "bits", 0.7).select("a", "b", *six("similarity"))


#: By the formulas of the two esters that ``_molecules`` makes, from published masses and contributions.
_ESTERS = (
    "WITH m AS (SELECT p_partkey, p_partkey % 3 AS kind, p_size AS s FROM part), "
    "d AS (SELECT p_partkey, CASE kind WHEN 0 THEN 12.0 * (2 * s + 8) + 1.00782503 * (4 * s + 6) + 15.9949146 * 4 WHEN 1 THEN 12.0 * (s + 2) + 1.00782503 * (2 * s + 4) + 15.9949146 * 2 END AS exact_weight, "
    "CASE kind WHEN 0 THEN 2 * (s + 1) WHEN 1 THEN s END::DOUBLE AS rotatable_bonds, CASE kind WHEN 0 THEN 2.0 * s / (2 * s + 8) WHEN 1 THEN (s + 1.0) / (s + 2) END AS fraction_sp3, "
    "CASE kind WHEN 0 THEN 4 * (0.1581 + 0.1230) + 2 * (0.1360 - 0.2783 + 0.1129 - 0.0684 - 0.2035) + 2 * 0.1441 * (s - 1) + 0.1230 * (4 * s + 2) "
    "WHEN 1 THEN 0.1441 * s - 0.2783 - 0.1526 - 0.0684 - 0.2035 + 0.1230 * (2 * s + 4) END AS logp, CASE kind WHEN 0 THEN 2 * s + 12 WHEN 1 THEN s + 4 END::DOUBLE AS heavy_atoms FROM m)"
)


@query(f"{_ESTERS} SELECT p_partkey, round(exact_weight, 4) AS exact_weight, rotatable_bonds, round(fraction_sp3, 6) AS fraction_sp3, round(logp, 4) AS logp, heavy_atoms FROM d")
def molecule_descriptors(c: Catalog) -> DataFrame:
    from ..chem import columns as chem

    df = chem.once(_molecules(c), "smiles", d=chem.descriptors(F.col("smiles")))
    return df.select("p_partkey", F.round("d.exact_weight", 4).alias("exact_weight"), "d.rotatable_bonds", F.round("d.fraction_sp3", 6).alias("fraction_sp3"), F.round("d.logp", 4).alias("logp"), "d.heavy_atoms")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 0 END AS places, CASE p_partkey % 3 WHEN 0 THEN 12 ELSE 0 END AS atoms, CASE p_partkey % 3 WHEN 0 THEN 12 ELSE 0 END AS bonds FROM part")
def substructure_places(c: Catalog) -> DataFrame:
    """Where the acid's twelve atoms are in a molecule: both ends of a phthalate have it, at the same atoms."""
    from ..chem import columns as chem

    df = chem.once(_molecules(c), "smiles", found=chem.match_lists(F.col("smiles"), chem.ACID))
    of = lambda part: F.when(F.size("found") > 0, F.size(F.get("found", F.lit(0))[part])).otherwise(0).alias(part)
    return df.select("p_partkey", F.size("found").alias("places"), of("atoms"), of("bonds"))


@query("SELECT p_partkey, p_partkey % 3 AS kind, 'I' || (p_partkey % 3) || '-' || p_size AS inchi FROM part WHERE p_partkey % 3 < 2")
def enriched_by_molecule(c: Catalog) -> DataFrame:
    """Properties joined to compounds that write the same molecules the other way round."""
    chain = F.repeat(F.lit("C"), F.col("p_size"))
    other = F.when(F.col("kind") == 0, F.concat(F.lit("c1ccc(C(=O)O"), chain, F.lit(")c(c1)C(O"), chain, F.lit(")=O"))).otherwise(F.concat(F.lit("COC(=O)"), chain))
    compounds = c.table("part").select("p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")).distinct().select(other.alias("smiles"), F.concat(F.lit("I"), F.col("kind").cast("string"), F.lit("-"), F.col("p_size").cast("string")).alias("inchi"))
    return stages.enriched(_molecules(c), compounds).select("p_partkey", (F.col("p_partkey") % 3).alias("kind"), "inchi")


@query("SELECT 'http://example.org/document/' || doc_id AS s, 'http://example.org/' || p AS p, o, o_kind, o_datatype FROM (SELECT doc_id, 'text' AS p, text AS o, 'literal' AS o_kind, NULL::VARCHAR AS o_datatype FROM documents UNION ALL SELECT doc_id, 'length', CAST(length(text) AS VARCHAR), 'literal', 'http://www.w3.org/2001/XMLSchema#integer' FROM documents UNION ALL SELECT doc_id, 'source', 'http://example.org/source/' || source, 'iri', NULL FROM documents) WHERE o IS NOT NULL")
def ntriples_roundtrip(c: Catalog) -> DataFrame:
    """Whole texts, with line ends, quotes and letters of other scripts, typed numbers and addresses, written as lines and read again."""
    at = "http://example.org/"
    made = nt.construct(c.table("documents"), F.concat(F.lit(f"{at}document/"), F.col("doc_id").cast("string")), {f"{at}text": (F.col("text"), "literal", None), f"{at}length": (F.length("text").cast("string"), "literal", "http://www.w3.org/2001/XMLSchema#integer"), f"{at}source": (F.concat(F.lit(f"{at}source/"), "source"), "iri", None)}, deal=False)
    return nt.parse_ntriples(nt.ntriples(made))


# filters, columns and order


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 10")
def strict_thresholds(c: Catalog) -> DataFrame:
    return c.table("lineitem").where((F.col("l_discount") > 0.05) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_brand <> 'Brand#11' AND NOT p_size > 25")
def unequal_and_negated(c: Catalog) -> DataFrame:
    return c.table("part").where((F.col("p_brand") != "Brand#11") & ~(F.col("p_size") > 25)).select("p_partkey")


@query("SELECT count(*) AS n, count(DISTINCT lang) AS langs FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def drop_nulls(c: Catalog) -> DataFrame:
    return c.table("documents").na.drop(subset=["text", "lang"]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'None' END AS status, 'x' AS constant FROM orders")
def dict_lookup_column(c: Catalog) -> DataFrame:
    names = F.create_map(*map(F.lit, ("F", "filled", "O", "open")))
    return c.table("orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("None")).alias("status"), F.lit("x").alias("constant"))


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS id FROM nation")
def row_number_id(c: Catalog) -> DataFrame:
    return numbered(c.table("nation", "n_name"), "n_name").select("n_name", F.col("id").cast("long").alias("id"))


@query("SELECT p_partkey, coalesce(CAST(nullif(p_size, 7) AS VARCHAR), 'nan') AS p_size FROM part")
def null_as_text(c: Catalog) -> DataFrame:
    return c.table("part").select("p_partkey", text.text_or_nan(F.nullif(F.col("p_size"), F.lit(7)), True).alias("p_size"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 40)) AS label, string_split(p_type, ' ')[-1] AS last FROM part")
def text_functions(c: Catalog) -> DataFrame:
    return c.table("part").select("p_partkey", F.upper(F.substring("p_name", 1, 40)).alias("label"), F.element_at(F.split("p_type", " "), -1).alias("last"))


@query("PIVOT (SELECT l_linestatus AS status, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL) ON flag IN ('A', 'N', 'R') USING coalesce(first(n), 0) GROUP BY status")
def transposed_pivot(c: Catalog) -> DataFrame:
    cells = c.table("lineitem").groupBy(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return rel.pivot(cells, "status", "flag", "n", ["A", "N", "R"], 0)


@query("SELECT c_custkey, 0.1 * round(c_acctbal) AS v FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')")
def chained_semi_joins(c: Catalog) -> DataFrame:
    asia = rel.kept_in(c.table("nation"), c.table("region").where("r_name = 'ASIA'"), "n_regionkey", "r_regionkey")
    return rel.kept_in(c.table("customer"), asia, "c_nationkey", "n_nationkey").select("c_custkey", (F.round("c_acctbal") * 0.1).alias("v"))


_DRAWN = "SELECT o_orderkey, ('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT AS drawn FROM orders"


@query(f"SELECT o_orderkey FROM ({_DRAWN}) ORDER BY drawn, o_orderkey LIMIT 100")
def seeded_sample(c: Catalog) -> DataFrame:
    return rel.sample(c.table("orders", "o_orderkey"), 100, "o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN drawn < {int(0.8 * 2**32)} THEN 'train' ELSE 'test' END AS part FROM ({_DRAWN})")
def seeded_split(c: Catalog) -> DataFrame:
    a, b = rel.split(c.table("orders", "o_orderkey"), 0.8, "o_orderkey")
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query(f"WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), t AS (SELECT *, ('0x' || substr(md5('42|' || k), 1, 8))::BIGINT < {int(0.8 * 2**32)} AS train FROM d), w AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE train) SELECT count(*) AS n, round(1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM t, w WHERE NOT train")
def regression_on_held_out_rows(c: Catalog) -> DataFrame:
    df = c.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    train, test = rel.split(df, 0.8, "k")
    made, _ = cluster.regression(df, ["x"], "y", train)
    return cluster.held_out_r2(made, "y", test, "k").select("n", *six("r2"))


@query()
def graph_scan_limit(c: Catalog) -> DataFrame:
    return bgp.Query(_triples(c), _P).select("?s", "?p", "?o").where("?s ?p ?o").limit(10).execute()


# stages


@query("SELECT s_suppkey AS inchi, p.token, p.title, round(avg(l_discount * 10), 6) AS prediction FROM lineitem JOIN (SELECT p_partkey AS token, p_name AS title FROM part WHERE regexp_matches(p_name, '^small.*g')) p ON p.token = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def assay_activity(c: Catalog) -> DataFrame:
    predictions = c.table("lineitem").select(F.col("l_suppkey").alias("inchi"), F.col("l_partkey").alias("property_token"), (F.col("l_discount") * 10).alias("positive_prediction"))
    assays = c.table("part").select(F.col("p_partkey").alias("token"), F.col("p_name").alias("title"))
    return stages.activity(predictions, c.table("supplier").select(F.col("s_suppkey").alias("inchi")), assays, "^small.*g").select("inchi", "token", "title", *six("prediction"))


_MEANS = "WITH m AS (SELECT l_suppkey AS k, avg(l_discount) AS v FROM lineitem GROUP BY 1), a AS (SELECT s_suppkey AS k, s_acctbal, s_nationkey FROM supplier), j AS (SELECT * FROM m JOIN a USING (k))"


def _means(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return rel.mean(c.table("lineitem").withColumnRenamed("l_suppkey", "k"), "k", "l_discount", "v"), c.table("supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", "s_nationkey")


@query(f"{_MEANS} SELECT 's_acctbal' AS metric, round(corr(v, s_acctbal), 6) AS r FROM j UNION ALL SELECT 's_nationkey', round(corr(v, s_nationkey), 6) FROM j")
def activity_correlations(c: Catalog) -> DataFrame:
    return stages.relationships(*_means(c), "k", "v", ["s_acctbal", "s_nationkey"]).select("metric", *six("r"))


@query(f"{_MEANS}, e AS (SELECT quantile_cont(s_acctbal, [0.2, 0.4, 0.6, 0.8]) AS edges FROM j) SELECT CAST(len(list_filter(e.edges, lambda x: x < s_acctbal)) + 1 AS INTEGER) AS bin, count(*) AS n, round(avg(v), 6) AS mean FROM j, e GROUP BY 1")
def activity_by_quantile(c: Catalog) -> DataFrame:
    return stages.binned_means(*_means(c), "k", "v", "s_acctbal").select("bin", "n", *six("mean"))


@query("WITH d AS (SELECT p_partkey, p_brand, p_retailprice, p_size = 1 AS example FROM part), m AS (SELECT p_brand, median(p_retailprice) AS m FROM d WHERE NOT example GROUP BY p_brand) SELECT p_partkey, p_brand, p_retailprice, example FROM (SELECT d.* FROM d JOIN m USING (p_brand) WHERE NOT example QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - m), p_partkey) <= 6) UNION ALL SELECT * FROM d WHERE example")
def median_sample_and_examples(c: Catalog) -> DataFrame:
    df = c.table("part").select("p_partkey", "p_brand", "p_retailprice", (F.col("p_size") == 1).alias("example"))
    return stages.middle_sample(df, "p_brand", "p_retailprice", "p_partkey", "example")


@query("SELECT p_partkey AS sid, min(k.c_name) AS \"ChemicalID\" FROM part JOIN (SELECT c_name, 'C' || c_nationkey AS cas FROM customer) k ON k.cas = 'C' || p_size WHERE p_partkey % 3 < 2 GROUP BY p_partkey")
def registry_number_matching(c: Catalog) -> DataFrame:
    number = F.concat(F.lit('"C'), F.col("p_size").cast("string"), F.lit('"'))
    data = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"CasRN": '), number, F.lit("}"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"CAS": ['), number, F.lit("]}"))).otherwise(F.lit("{}"))
    chemicals = c.table("customer").select(F.col("c_name").alias("ChemicalID"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("CasRN"))
    return stages.matched(c.table("part").select(F.col("p_partkey").alias("sid"), data.alias("data")), chemicals)


@query("SELECT s, p, o, o_kind, CASE WHEN p LIKE '%token' THEN 'http://www.w3.org/2001/XMLSchema#integer' END AS o_datatype FROM (SELECT 'http://example.org/part/' || p_partkey AS s, p_partkey, p_name, p_type FROM part), LATERAL (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/Property', 'iri'), ('http://example.org/title', p_name, 'literal'), ('http://example.org/token', CAST(p_partkey AS VARCHAR), 'literal'), ('http://example.org/data', p_type, 'literal'), ('http://example.org/has_identifier', 'http://example.org/uri/' || (60 + p_partkey % 40), 'iri'), ('http://example.org/has_category', 'http://example.org/category/' || replace(p_type, ' ', '_'), 'iri')) t(p, o, o_kind)")
def property_graph_build(c: Catalog) -> DataFrame:
    uri = F.concat(F.lit("http://example.org/part/"), F.col("token").cast("string"))
    identifier = F.concat(F.lit("http://example.org/uri/"), (60 + F.col("p_partkey") % 40).cast("string"))
    rows = c.table("part").select(F.col("p_partkey").alias("token"), F.col("p_name").alias("title"), F.col("p_type").alias("data"), identifier.alias("identifier"), F.col("p_type").alias("category"))
    return stages.property_graph(rows, "http://example.org/", uri)


@query("SELECT uri, 'title' AS variable, p_name AS value FROM (SELECT p_partkey AS uri, p_name, p_type FROM part) UNION SELECT p_partkey, 'data', p_type FROM part UNION SELECT s_suppkey, 'label', s_name FROM supplier UNION SELECT doc_id, 'document', substr(text, 1, 10000) FROM documents WHERE text IS NOT NULL")
def texts_for_embedding(c: Catalog) -> DataFrame:
    own = c.table("part").select(F.col("p_partkey").alias("uri"), F.col("p_name").alias("title"), F.col("p_type").alias("data"))
    labels = c.table("supplier").select(F.col("s_suppkey").alias("uri"), F.lit("label").alias("variable"), F.col("s_name").alias("value"))
    documents = c.table("documents").select(F.col("doc_id").alias("uri"), F.lit("document").alias("variable"), F.col("text").alias("value"))
    return stages.texts_to_embed(own, labels.unionAll(documents))


@query(f"{_PAIRS}, have AS (SELECT l_suppkey AS inchi, l_partkey % 400 AS token, avg(l_discount) AS v FROM lineitem GROUP BY ALL) SELECT inchi, token AS property_token, round(coalesce(v, token / 100.0), 6) AS prediction FROM (SELECT inchi, token FROM ids, tokens) LEFT JOIN have USING (inchi, token)")
def predict_missing_and_append(c: Catalog) -> DataFrame:
    ids, tokens, _ = _known(c)
    have = c.table("lineitem").select(F.col("l_suppkey").alias("inchi"), (F.col("l_partkey") % 400).alias("property_token"), F.col("l_discount").alias("positive_prediction"))
    wanted = rel.product(ids, tokens.withColumnRenamed("token", "property_token"))
    return stages.completed(have, wanted, lambda batch: batch["property_token"] / 100.0).select("inchi", "property_token", *six("prediction"))


@query()
def molecule_clusters(c: Catalog) -> DataFrame:
    """Average-linkage clusters of the different molecules and the nearest analogues of two examples."""
    examples = [("dimethyl", "COC(=O)C1=CC=CC=C1C(=O)OC"), ("methyl acetate", "CC(=O)OC")]
    return stages.clusters_and_analogues(_molecules(c), examples).select("example", "smiles", *six("similarity"), "cluster")


@query()
def activity_clusters(c: Catalog) -> DataFrame:
    """The activity matrix with clusters, both orders, means, shares and names."""
    cells = dom.predictions(c).select("inchi", F.concat(F.lit("assay "), F.col("property_token").cast("string")).alias("title"), "positive_prediction")
    names = dom.chemicals(c).where("inchi <= 3")
    return stages.clustered_activity(cells, names).select("inchi", "title", *six("positive_prediction", "mean", "active"), "cluster", "row_position", "column_position", "example")


@query()
def cluster_map_by_category(c: Catalog) -> DataFrame:
    """The mean discount of each brand and size, a clustered matrix for each container of a part's type."""
    cells = c.table("lineitem").join(c.table("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type", "p_brand", "p_size").agg(F.avg("l_discount").alias("v"))
    return cluster.cluster_maps(cells, "p_brand", "p_size", "v", "p_type").select("category", "p_brand", "p_size", *six("v"), "row_position", "column_position")


@query(", o AS (SELECT uri AS name, row_number() OVER (ORDER BY uri DESC) - 1 AS position FROM one_property), i AS (SELECT s_suppkey AS name, s_suppkey - 1 AS position FROM supplier) SELECT inchi, uri, CAST(i.position AS BIGINT) AS row_position, CAST(o.position AS BIGINT) AS column_position, round(prediction, 6) AS prediction FROM averaged a JOIN one_property p ON p.token = a.property_token JOIN o ON o.name = p.uri JOIN i ON i.name = a.inchi", D)
def permuted_matrix(c: Catalog) -> DataFrame:
    d = dom.domain(c)
    cells = d.averaged.join(d.one_property.select("uri", F.col("token").alias("property_token")), "property_token").select("inchi", "uri", *six("prediction"))
    columns = numbered(d.one_property.select(F.col("uri").alias("name"), (-F.col("uri")).alias("down")), "down", name="position").select("name", F.col("position").cast("long").alias("position"))
    rows = c.table("supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") - 1).cast("long").alias("position"))
    return rel.permuted(cells, "inchi", "uri", rows, columns)


@query("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 4) AS total, min(s_name) AS first FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def sqlite_copy(c: Catalog) -> DataFrame:
    """A table appended to a SQLite file by one commit, and read back from it by ranges of row ids with the filter in the statements."""
    path = scratch.path(c.spark, "copy") + ".sqlite"
    sqlite.append(c.table("supplier"), path, "supplier")
    rows = sqlite.table(c.spark, path, "supplier", [("s_acctbal", ">", 0)])
    return rows.groupBy(F.col("s_nationkey").cast("int").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 4).alias("total"), F.min("s_name").alias("first"))


_ANALOGUES = ", ".join(f"('{n}')" for n in ("small ring ECONOMY", "red widget SMALL"))


@query(f"WITH {_BITS}, averaged AS (SELECT l_suppkey AS inchi, l_partkey % 40 AS token, avg(l_discount * 10) AS prediction FROM lineitem GROUP BY ALL), known AS (SELECT label AS name, row_number() OVER (ORDER BY label) % (SELECT count(*) FROM supplier) + 1 AS inchi, bits, n FROM size), asked AS (SELECT * FROM known WHERE (inchi - 1) % 50 = 0), near AS (SELECT a.name AS of, b.name, {_TANIMOTO} AS similarity FROM asked a JOIN known b ON a.name <> b.name WHERE {_TANIMOTO} >= 0.1 QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY {_TANIMOTO} DESC, b.name) <= 10), names AS (SELECT name FROM asked UNION SELECT name FROM near) SELECT name AS chemical_name, round(max(prediction) FILTER (WHERE token = 3), 6) AS x, round(max(prediction) FILTER (WHERE token = 7), 6) AS y FROM names JOIN known USING (name) JOIN averaged USING (inchi) WHERE token IN (3, 7) GROUP BY name")
def analogue_comparison(c: Catalog) -> DataFrame:
    """Two properties of some compounds and of the ten most like each: labels of parts stand for compounds, a supplier's predictions for theirs."""
    labelled = numbered(fingerprints.of_words(_labels(c), "label"), "label").withColumnRenamed("label", "name")
    many = c.table("supplier").agg(F.count(F.lit(1)).alias("many"))
    compounds = labelled.join(F.broadcast(many)).select("name", ((F.col("id") + 1) % F.col("many") + 1).alias("inchi"), "bits")
    predictions = c.table("lineitem").select(F.col("l_suppkey").alias("inchi"), (F.col("l_partkey") % 40).alias("property_token"), (F.col("l_discount") * 10).alias("positive_prediction"))
    tokens = c.spark.range(40).select(F.col("id").alias("uri"), F.col("id").alias("token"), F.lit("").alias("title"))
    d = ranking.Domain(dom.vectors(c), dom.pathways(c), predictions, tokens)
    return ranking.compared_analogues(d, compounds.where("(inchi - 1) % 50 = 0"), compounds, (3, 7)).select("chemical_name", *six("x", "y"))


@query("SELECT uri, title FROM one_property WHERE uri = 77", D)
def uri_title_lookup(c: Catalog) -> DataFrame:
    return ranking.uri_title(dom.domain(c), 77)


@query("SELECT index, uri, round(list_sum(embedding), 6) AS total FROM vectors WHERE index IN (SELECT n_nationkey * 13 FROM nation)", D)
def vectors_by_index(c: Catalog) -> DataFrame:
    wanted = c.table("nation").select((F.col("n_nationkey") * 13).cast("long").alias("index"))
    return sim.by_index(dom.vectors(c), wanted).select("index", "uri", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@query("SELECT q.index AS query, v.index, round(list_inner_product(q.embedding, v.embedding), 6) AS similarity FROM vectors v JOIN vectors q ON q.index % 100 = 7 QUALIFY row_number() OVER (PARTITION BY q.index ORDER BY list_inner_product(q.embedding, v.embedding) DESC, v.index) <= 5", D)
def index_search(c: Catalog) -> DataFrame:
    """The five nearest stored vectors of some query vectors."""
    vectors = dom.vectors(c)
    asked = vectors.where("index % 100 = 7").select(F.col("index").alias("source"), "embedding")
    found = Cells.build(vectors, scratch.path(c.spark, "cells")).nearest(asked, 5)
    return found.select(F.col("source").alias("query"), F.col("target").alias("index"), *six("similarity"))


@query("SELECT uri FROM (SELECT uri, list_inner_product(embedding, (SELECT embedding FROM prompt)) AS s, index FROM vectors ORDER BY s DESC, index LIMIT 100) GROUP BY uri", D)
def distinct_of_top_100(c: Catalog) -> DataFrame:
    asked = dom.prompt(c).select(F.lit(0).alias("query"), "embedding")
    return sim.search(dom.vectors(c), asked, 100).join(dom.vectors(c).select("index", "uri"), "index").select("uri").distinct()


@query("SELECT DISTINCT property_token FROM averaged ORDER BY property_token", D)
def sorted_distinct_tokens(c: Catalog) -> DataFrame:
    return dom.domain(c).averaged.select("property_token").distinct().orderBy("property_token")


_VECTOR = "http://example.org/"


@query(f"SELECT '{_VECTOR}vector/' || index AS s, p, o, o_kind, CASE WHEN p LIKE '%value' THEN 'http://www.w3.org/2001/XMLSchema#integer' END AS o_datatype FROM vectors, LATERAL (VALUES ('{_VECTOR}has_identifier', '{_VECTOR}uri/' || uri, 'iri'), ('{_VECTOR}value', CAST(index AS VARCHAR), 'literal'), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{_VECTOR}Vector', 'iri')) t(p, o, o_kind) UNION ALL SELECT DISTINCT '{_VECTOR}property/' || p_partkey, '{_VECTOR}has_category', '{_VECTOR}category/' || replace(p_type, ' ', '_'), 'iri', NULL FROM part", D)
def vector_and_category_triples(c: Catalog) -> DataFrame:
    index = dom.vectors(c).select("index", F.concat(F.lit(f"{_VECTOR}uri/"), F.col("uri").cast("string")).alias("uri"))
    links = stages.category_links(c.table("part").select(F.col("p_partkey").alias("token"), F.col("p_type").alias("category")), _VECTOR)
    return nt.add_triples(stages.vector_triples(index, _VECTOR), links)


@query("SELECT 't' || vec_id AS value, CAST(11 - ntile(10) OVER (ORDER BY list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, 't' || vec_id) AS INTEGER) AS strength FROM embeddings")
def reranked_values(c: Catalog) -> DataFrame:
    from ..functions import services

    stored = c.table("embeddings").select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("value"), "embedding")
    return services.reranked(stored.select("value"), "t7", stored).select("value", F.col("strength").cast("int").alias("strength"))


@query("SELECT 't' || vec_id AS assay, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS relevance_score FROM embeddings WHERE list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) > 0.1")
def linked_assays(c: Catalog) -> DataFrame:
    from ..functions import services

    stored = c.table("embeddings").select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("value"), "embedding")
    return services.linked_terms(stored.select(F.col("value").alias("assay")), "t7", stored, above=0.1).select("assay", *six("relevance_score"))


@query("SELECT status, CAST(sum(n) FILTER (WHERE flag = 'A') AS BIGINT) AS \"A\", CAST(sum(n) FILTER (WHERE flag = 'N') AS BIGINT) AS \"N\", CAST(sum(n) FILTER (WHERE flag = 'R') AS BIGINT) AS \"R\" FROM (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY status")
def transposed_table(c: Catalog) -> DataFrame:
    """A wide table turned: its columns become rows."""
    cells = c.table("lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return rel.transposed(rel.pivot(cells, "flag", "status", "n", ["F", "O"]), "flag", ["F", "O"], "status")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status FROM orders")
def lookup_or_null(c: Catalog) -> DataFrame:
    names = F.create_map(*map(F.lit, ("F", "filled", "O", "open")))
    return c.table("orders").select("o_orderkey", F.try_element_at(names, F.col("o_orderstatus")).alias("status"))


@query(f"SELECT * FROM ({_bins(10)}) ORDER BY bin")
def bins_in_order(c: Catalog) -> DataFrame:
    return _binned(c, 10).orderBy("bin")


@query("SELECT uri, round(max(similarity), 4) AS similarity FROM (SELECT vec_id % 100 AS uri, 3 * list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS similarity FROM embeddings ORDER BY similarity DESC, uri LIMIT 1000) GROUP BY uri")
def raw_prompt_top_1000(c: Catalog) -> DataFrame:
    """Vectors as they are, not of length 1, and a thousand neighbours."""
    raw = dom.vectors(c).select("uri", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding"))
    return sim.prompt_similars(raw, dom.prompt(c), raw.select("uri").distinct(), 1000).select("uri", F.round("similarity", 4).alias("similarity"))


@query("SELECT p_partkey, CASE WHEN p_size <> 7 THEN 100.0 / (p_size - 7) END AS result, CASE WHEN p_size = 7 THEN 'no score for 7' END AS error FROM part")
def scores_or_errors(c: Catalog) -> DataFrame:
    """A scorer that fails on some rows: theirs is the error, the others keep their scores."""
    from ..functions import services

    def scorer(batch):
        if (batch["p_size"] == 7).any():
            raise ValueError("no score for 7")
        return 100.0 / (batch["p_size"] - 7)

    tasks = int(c.spark.conf.get("spark.sql.shuffle.partitions"))
    df = c.table("part", "p_partkey", "p_size").repartition(tasks, "p_partkey")  # the rows of a small file are a lot of calls
    return df.mapInPandas(services.safe(scorer, ["p_size"]), "p_partkey long, p_size long, result double, error string").select("p_partkey", "result", "error")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def flattened_lists(c: Catalog) -> DataFrame:
    """Lists of records, one for each customer, as rows again."""
    lists = c.table("orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("records"))
    return lists.select("o_custkey", F.explode("records").alias("record")).select("o_custkey", "record.*")
