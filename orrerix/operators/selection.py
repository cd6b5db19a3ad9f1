"""Exact quantiles by counting, and dense numbers by prefix sums: orders of a whole table without a task that holds it.

A quantile is found by narrowing intervals of values.  The first pass counts
values by sign and exponent; each later one cuts the interval that holds a rank
into 4096 equal parts and counts those.  Counts are combined in every task
before they are shuffled, and an interval keeps its real least and largest
value, so it is settled once these are equal: after two or three passes as a
rule, after seven at most.  What is carried from pass to pass is two intervals
for each share of each group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, stored

#: Rows of a group up to which its values are ordered by one task's aggregate.
FEW = 1 << 16
#: Parts of an interval in a pass, and passes after which every interval of doubles is settled.
PARTS, PASSES = 4096, 8


def _magnitude(x: Column) -> Column:
    """Sign and exponent as one whole number, in the order of the values; NaN comes last, as it sorts."""
    size = F.floor(F.log2(F.greatest(F.lit(2.0**-1074), F.least(F.abs(x), F.lit(2.0**1023 * 1.5))))).cast("int") + 1075
    return F.when(F.isnan(x), 2200).when(x == 0, 0).when(F.abs(x) == float("inf"), F.signum(x).cast("int") * 2150).otherwise(F.signum(x).cast("int") * size)


def _ranks(n: Column, shares: Sequence[float]) -> Column:
    """The ranks from 0 on either side of each share of n values."""
    at = [F.lit(float(s)) * (n - 1) for s in shares]
    return F.array_distinct(F.array(*(f(p).cast("long") for p in at for f in (F.floor, F.ceil))))


def _holding(counted: DataFrame, within: list[str], part: str) -> DataFrame:
    """Of counted parts of intervals those that hold a rank, with the number of values before them."""
    line = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.col("before") + F.coalesce(F.sum("count").over(line), F.lit(0)))
    there = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("count")))
    return placed.withColumn("ranks", there).where(F.size("ranks") > 0)


def _selected(rows: DataFrame, keys: list[str], shares: Sequence[float]) -> DataFrame:
    """(keys, n, rank, found) of rows(keys, x) without null x: the values on either side of each share."""
    spread = ["count", "low", "high"]
    counting = [F.count(F.lit(1)).alias("count"), F.min("x").alias("low"), F.max("x").alias("high")]
    first = rows.groupBy(*keys, _magnitude(F.col("x")).alias("kind")).agg(*counting)
    group = Window.partitionBy(*keys or [F.lit(0)])  # the counts of one group: some thousands of rows
    ranked = first.withColumn("n", F.sum("count").over(group)).withColumn("ranks", _ranks(F.col("n"), shares)).withColumn("before", F.lit(0).cast("long"))
    names = [*keys, "n", "kind", "before", "ranks", *spread]
    at = stored(_holding(ranked, [*keys, "n"], "kind").select(*names), "intervals")
    for _ in range(PASSES):
        open_ = at.where("low < high")
        if open_.first() is None:
            break
        # at most two intervals for each share and group
        sides = open_.select(*(F.col(k).alias(f"{k} of interval") for k in keys), "n", "kind", "before", "ranks", F.col("low").alias("from"), F.col("high").alias("to"))
        met = (_magnitude(F.col("x")) == F.col("kind")) & (F.col("x") >= F.col("from")) & (F.col("x") <= F.col("to"))
        for k in keys:
            met = met & F.col(k).eqNullSafe(F.col(f"{k} of interval"))
        inside = rows.join(sides, met)
        # a part is a range of values, since each step keeps their order; an interval has one sign and exponent, so nothing overflows
        part = F.floor((F.col("x") - F.col("from")) / (F.col("to") - F.col("from")) * PARTS).cast("int")
        own = [*keys, "n", "kind", "from", "to"]
        counted = inside.groupBy(*own, part.alias("part")).agg(*counting, F.first("before").alias("before"), F.first("ranks").alias("ranks"))
        closer = _holding(counted, own, "part").select(*names)
        last, at = at, stored(closer.unionByName(at.where("not low < high")), "intervals")
        discard(last)
    return at.select(*keys, "n", F.explode("ranks").alias("rank"), F.col("low").alias("found"))


def _between(n: Column, at: Column, shares: Sequence[float]) -> Column:
    """The quantiles of the shares, from a map of ranks to values, by linear interpolation."""

    def one(s: float) -> Column:
        place = F.lit(float(s)) * (n - 1)
        low, high = (F.element_at(at, f(place).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return F.array(*map(one, shares))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), few: int = FEW, name: str = "quantiles") -> DataFrame:
    """(keys, quantiles): the exact quantiles of each group by linear interpolation, as doubles.

    Without keys one row.  Nulls don't count; a group of nulls only, or an empty
    table without keys, has a null.  Null keys are a group.  NaN is larger than
    all other values.  Groups of up to ``few`` rows are ordered by an aggregate;
    of larger ones no task holds the values.
    """
    if not shares or not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares lie from 0 to 1")
    own = [f"key {i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(value).cast("double").alias("x"))
    known = rows.where(F.col("x").isNotNull())
    back = [F.col(o).alias(k) for k, o in zip(keys, own, strict=True)]
    ordered = F.percentile("x", F.array(*(F.lit(float(s)) for s in shares))).alias(name)
    if keys:
        sizes = known.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few)
        large = stored(sizes.select(*(F.col(o).alias(f"{o} of large") for o in own)), "large")  # a row for `few` rows of the table at most
        if large.first() is None:
            discard(large)
            return rows.groupBy(*own).agg(ordered).select(*back, name)
        same = reduce(and_, (F.col(o).eqNullSafe(F.col(f"{o} of large")) for o in own))
        small = rows.join(large, same, "left_anti").groupBy(*own).agg(ordered)
        known = known.join(large, same, "left_semi")
    made = _selected(known, own, shares).groupBy(*own).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("at"))
    made = made.select(*own, F.when(F.size("at") > 0, _between(F.col("n"), F.col("at"), shares)).alias(name))
    return (small.unionByName(made) if keys else made).select(*back, name)


def numbered(df: DataFrame, *order: str, name: str = "id", start: int = 0) -> DataFrame:
    """Rows with numbers from ``start`` on without gaps, in an order that a leading ``-`` turns round.

    Rows are dealt by ranges of the order and written with their place in the
    range; ranges are counted, and a prefix sum of the counts, a row for each
    range, says where each begins.  Rows alike in the order go by a hash of
    their columns, so that many of them are dealt to several ranges.
    """
    spark = df.sparkSession
    tie = F.xxhash64(*df.columns).alias("tie of row")
    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("*", tie, F.monotonically_increasing_id().alias("copy of row"))
    last = [F.asc("tie of row"), F.asc("copy of row")]
    ranged = dealt.repartitionByRange(tasks, *by, *last).sortWithinPartitions(*by, *last).drop("tie of row", "copy of row")
    # the id has the partition in its upper bits and the row's place there in the lower 33
    placed = stored(ranged.withColumn("place of row", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place of row", 33).cast("int")
    counts = placed.groupBy(part.alias("part of row")).agg(F.count(F.lit(1)).alias("n of part"))
    begins = counts.withColumn("begin of part", F.sum("n of part").over(Window.orderBy("part of row")) - F.col("n of part")).drop("n of part")
    joined = placed.withColumn("part of row", part).join(F.broadcast(begins), "part of row")  # a row for each range
    within = F.col("place of row").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("begin of part") + within + start).drop("part of row", "place of row", "begin of part")
