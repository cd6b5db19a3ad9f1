"""The ranking domain over the test tables, as DataFrames and as the same SQL.

The tables are of another trade, so the views only have the shapes that the
operators need: vectors shared by uris, pathways with titles that begin alike,
repeated predictions, several tokens to a property.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from .ranking import Domain

PROMPT = 7
MIE_TITLE = "molecular initiating event with a long name, number "


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, sf_dir)


def vectors(c: Catalog) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("index"), (F.col("vec_id") % 100).alias("uri"), "embedding")


def pathways(c: Catalog) -> DataFrame:
    nation, segment = F.col("c_nationkey").cast("long"), F.col("c_mktsegment")
    mie = (nation * 3 + F.length(segment)) % 20
    return c.table("customer").select((40 + nation % 20).alias("aop"), mie.alias("mie"), (20 + (nation * 7 + F.ascii(segment)) % 20).alias("ao"), F.concat(F.lit(MIE_TITLE), mie.cast("string")).alias("mie_title")).distinct()


def predictions(c: Catalog) -> DataFrame:
    return c.table("lineitem").select(F.col("l_suppkey").alias("inchi"), ((F.col("l_partkey") + 39) % 40 + 1).alias("property_token"), (F.col("l_discount") * 10).alias("positive_prediction"))


def properties(c: Catalog) -> DataFrame:
    return c.table("part").select((60 + F.col("p_partkey") % 40).alias("uri"), F.col("p_partkey").alias("token"), F.col("p_name").alias("title"))


def chemicals(c: Catalog) -> DataFrame:
    return c.table("supplier").select(F.col("s_suppkey").alias("inchi"), F.col("s_name").alias("name"))


def domain(c: Catalog) -> Domain:
    return Domain(vectors(c), pathways(c), predictions(c), properties(c))


def prompt(c: Catalog) -> DataFrame:
    """(embedding): the prompt's vector, one row."""
    return c.table("embeddings").where(F.col("vec_id") == PROMPT).select("embedding")


SQL = f"""
WITH vectors AS (SELECT vec_id AS index, vec_id % 100 AS uri, embedding::DOUBLE[] AS embedding FROM embeddings),
pathways AS (
  SELECT DISTINCT CAST(40 + c_nationkey % 20 AS BIGINT) AS aop, CAST((c_nationkey * 3 + length(c_mktsegment)) % 20 AS BIGINT) AS mie,
         CAST(20 + (c_nationkey * 7 + ascii(c_mktsegment)) % 20 AS BIGINT) AS ao, '{MIE_TITLE}' || ((c_nationkey * 3 + length(c_mktsegment)) % 20) AS mie_title
  FROM customer),
preds AS (SELECT l_suppkey AS inchi, (l_partkey + 39) % 40 + 1 AS property_token, l_discount * 10 AS positive_prediction FROM lineitem),
averaged AS (SELECT inchi, property_token, avg(positive_prediction) AS prediction FROM preds GROUP BY ALL),
properties AS (SELECT 60 + p_partkey % 40 AS uri, p_partkey AS token, p_name AS title FROM part),
one_property AS (SELECT uri, min(token) AS token, arg_min(title, token) AS title FROM properties GROUP BY uri),
chemicals AS (SELECT s_suppkey AS inchi, s_name AS name FROM supplier),
prompt AS (SELECT embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id = {PROMPT}),
scored AS (SELECT uri, list_inner_product(v.embedding, p.embedding) AS similarity FROM vectors v, prompt p),
nearest AS (SELECT * FROM scored ORDER BY similarity DESC, uri LIMIT 300),
near AS (SELECT uri, max(similarity) AS similarity FROM nearest GROUP BY uri),
pairs AS (
  SELECT a.uri AS mie, b.uri AS property_uri, max(list_inner_product(a.embedding, b.embedding)) AS similarity
  FROM vectors a JOIN vectors b ON a.uri IN (SELECT mie FROM pathways) AND b.uri IN (SELECT uri FROM properties) GROUP BY ALL),
links AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY mie ORDER BY similarity DESC, property_uri) <= 3),
all_predictions AS (
  SELECT l.mie, l.property_uri, c.name AS chemical_name, l.similarity, a.prediction, l.similarity * a.prediction AS weight
  FROM averaged a JOIN one_property o ON o.token = a.property_token JOIN chemicals c USING (inchi) JOIN links l ON l.property_uri = o.uri),
titles AS (
  SELECT uri, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN title || '_' || row_number() OVER (PARTITION BY title ORDER BY uri) ELSE title END AS title FROM one_property),
ranked_events AS (
  SELECT p.mie, p.mie_title, max(n.similarity) AS similarity FROM pathways p JOIN near n ON n.uri = p.aop AND n.similarity > 0.2
  WHERE p.mie IN (SELECT p2.mie FROM pathways p2 JOIN near n2 ON n2.uri = p2.mie WHERE n2.similarity > 0.2)
    AND p.mie IN (SELECT p3.mie FROM pathways p3 JOIN near n3 ON n3.uri = p3.ao WHERE n3.similarity > 0.2)
    AND p.mie IN (SELECT mie FROM all_predictions) GROUP BY ALL),
event_rows AS (
  SELECT mie AS uri, substr(mie_title, 1, 40) AS cut, chemical_name, avg(prediction) AS prediction
  FROM all_predictions JOIN (SELECT mie, mie_title FROM ranked_events ORDER BY similarity DESC, mie LIMIT 3) USING (mie) GROUP BY mie, mie_title, chemical_name),
event_predictions AS (
  SELECT uri, CASE WHEN count(*) OVER (PARTITION BY chemical_name, cut) > 1 THEN cut || ' ' || row_number() OVER (PARTITION BY chemical_name, cut ORDER BY uri) ELSE cut END AS title, chemical_name, prediction
  FROM event_rows),
entity AS (SELECT min(s_suppkey) AS inchi FROM supplier),
weighted AS (
  SELECT x.mie, o.uri AS property_uri, o.title, t.mie_title, x.similarity, a.prediction, x.similarity * a.prediction AS weight
  FROM pairs x JOIN one_property o ON o.uri = x.property_uri JOIN averaged a ON a.property_token = o.token JOIN entity e ON e.inchi = a.inchi JOIN (SELECT DISTINCT mie, mie_title FROM pathways) t ON t.mie = x.mie
  WHERE x.similarity > 0.2 AND a.prediction > 0.5)
"""
