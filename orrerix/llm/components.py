"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is two aggregations and joins on the links that are left, written to
the shared folder; nothing but a count and a checksum of the links reaches the
driver.  Hubs are safe: a vertex's neighbours are reduced to their minimum
before any join, and the joins are sort-merge joins, which Spark splits where a
key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (u, v) with u > v."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        made = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return made.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link to another: the smallest node that it reaches.

    Nodes are longs; links to oneself and null ends are no links; repeated links
    count once; no links give no rows.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    before = None
    while (state := _sum(now)) != before and state[0]:
        before, old = state, now
        now = stored(_star(_star(now, True), False), "links")
        discard(old)
    made = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    made.orrerix_path = now.orrerix_path  # discarding the result discards the links that it reads
    return made
