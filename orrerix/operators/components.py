"""Connected components of a table of links, by alternating rounds of large and small stars over written tables.

A vertex's neighbours are reduced to their least before anything is joined, so
hubs are safe; a round is written to the shared folder, and a count and a
checksum of it tell the driver whether links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, stored


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _round(links: DataFrame) -> DataFrame:
    """Greater neighbours go to the least one that is known, then lesser ones do."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = _ordered(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    lesser = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lesser, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(moved.unionAll(lesser.select("u", F.col("m").alias("v"))))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component), stored: every node with a link to another, and the least node that it reaches; keys of any type with an order, nulls are no ends."""
    state = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = stored(_ordered(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    before, found = None, state(now)
    while found != before and found[0]:
        now, last = stored(_round(now), "links"), now
        discard(last)
        before, found = found, state(now)
    heads = now.select("v").distinct()
    made = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(heads.select(F.col("v").alias("node"), F.col("v").alias("component"))), "components")
    discard(now)
    return made
