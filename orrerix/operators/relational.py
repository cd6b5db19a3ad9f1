"""Joins, aggregations, windows and reshaping: DataFrames in, DataFrames out.

Orders always end in a key, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import quantiles

Names = str | Sequence[str]


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


# joins


def inner(left: DataFrame, right: DataFrame, on: Names, null_matches: bool = False) -> DataFrame:
    """Inner equi-join; with ``null_matches`` null keys match each other too."""
    keys = _list(on)
    if not null_matches:
        return left.join(right, keys)
    other = right.select(*(F.col(c).alias(f"{c} right") if c in keys else F.col(c) for c in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"{k} right")) for k in keys]
    return left.join(other, same).drop(*(f"{k} right" for k in keys))


def inner_on(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Inner join on keys of different names; both stay."""
    return left.join(right, F.col(a) == F.col(b))


def kept_in(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key is among the other's."""
    return df.join(other.select(F.col(other_key or key).alias(key)), key, "left_semi")


def missing_pairs(pairs: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pairs that aren't known."""
    return pairs.join(known, list(on), "left_anti")


def any_missing(entities: DataFrame, tokens: DataFrame, known: DataFrame, entity: str, token: str) -> DataFrame:
    """Entities that lack at least one token of the universe: by counts, so that no product is made."""
    universe = tokens.select(token).where(F.col(token).isNotNull()).distinct()
    have = known.select(entity, token).distinct().join(universe, token, "left_semi").groupBy(entity).agg(F.count(F.lit(1)).alias("have"))
    size = universe.agg(F.count(F.lit(1)).alias("size"))  # one row
    return entities.select(entity).distinct().join(have, entity, "left").join(F.broadcast(size)).where(F.coalesce("have", F.lit(0)) < F.col("size")).select(entity)


#: Pairs that a product makes at most, unless the caller says otherwise.
MOST_PAIRS = 10**10


def product(left: DataFrame, right: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Every pair of two tables of distinct values: the result is the feature, and as large as it sounds; more than ``most`` pairs raise when it is run."""
    sizes = left.agg(F.count(F.lit(1)).alias("rows of left")).join(right.agg(F.count(F.lit(1)).alias("rows of right")))  # one row
    pairs = F.col("rows of left").cast("double") * F.col("rows of right")
    fits = F.when(pairs <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"a product makes at most {most} pairs, not "), pairs.cast("string"))).cast("boolean"))
    return left.join(F.broadcast(sizes)).where(fits).drop("rows of left", "rows of right").crossJoin(right)


def with_default(wanted: DataFrame, values: DataFrame, key: str, value: str, default: float = 0.0) -> DataFrame:
    """All wanted keys with their value, or the default."""
    return wanted.join(values.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def require_all(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df``, or an error if a key of the other table isn't in it."""
    lost = other.join(df, key, "left_anti").select(key).first()
    if lost is not None:
        raise ValueError(f"{key} {lost[0]!r} is missing")
    return df


def require_distinct(df: DataFrame, keys: Names) -> DataFrame:
    """``df``, or an error if rows share the keys."""
    again = df.groupBy(*_list(keys)).count().where("count > 1").first()
    if again is not None:
        raise ValueError(f"repeated keys: {again.asDict()}")
    return df


# aggregations


def total(df: DataFrame, keys: Names, value: str, name: str | None = None) -> DataFrame:
    """Sums for each key; 0 where all values are null. Null keys are no group."""
    return _keyed(df, keys).groupBy(*_list(keys)).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name or value))


def mean(df: DataFrame, keys: Names, value: str, name: str | None = None) -> DataFrame:
    return _keyed(df, keys).groupBy(*_list(keys)).agg(F.avg(value).alias(name or value))


def largest(df: DataFrame, keys: Names, value: str, name: str | None = None) -> DataFrame:
    return _keyed(df, keys).groupBy(*_list(keys)).agg(F.max(value).alias(name or value))


def _keyed(df: DataFrame, keys: Names) -> DataFrame:
    return df.na.drop(subset=_list(keys))


def two_level(df: DataFrame, keys: Names, outer: Names, value: str) -> DataFrame:
    """Sums and counts for the keys, summed up again for the outer ones."""
    first = _keyed(df, keys).groupBy(*_list(keys)).agg(F.sum(value).alias("weight"), F.count(value).alias("n"))
    return first.groupBy(*_list(outer)).agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def active_share(df: DataFrame, keys: Names, value: str, above: float = 0.6) -> DataFrame:
    return _keyed(df, keys).groupBy(*_list(keys)).agg(F.avg((F.col(value) > above).cast("double")).alias("active"))


def first_per_group(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of each column the first value that isn't null, by an order that must tell rows apart."""
    others = [c for c in df.columns if c != key]
    place = F.struct(*order)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in others))


def best_per_key(df: DataFrame, keys: Names, *order: Column | str) -> DataFrame:
    """One row for each key: the first by the order."""
    return top_per_group(df, keys, 1, *order)


def counts(df: DataFrame, keys: Names, least: int = 1) -> DataFrame:
    return df.groupBy(*_list(keys)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def filled_mean(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Means over all columns of the matrix that the cells make, cells that aren't there counting 0."""
    width = df.agg(F.count_distinct(column).alias("width"))  # one row
    return df.groupBy(row).agg(F.sum(value).alias("total")).join(F.broadcast(width)).select(row, (F.coalesce("total", F.lit(0.0)) / F.col("width")).alias("mean"))


def median(df: DataFrame, keys: Names, value: str) -> DataFrame:
    """(keys, median): exact, and with no task that holds the values of a large group."""
    return quantiles(df, value, [0.5], _list(keys)).select(*_list(keys), F.get("quantiles", F.lit(0)).alias("median"))


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(edges): the bounds of bins with equal shares, by linear interpolation; exact, by counting."""
    return quantiles(df, value, [i / bins for i in range(bins + 1)], name="edges")


def quantile_bins(df: DataFrame, value: str, bins: int, merge_equal: bool = False, name: str = "bin") -> DataFrame:
    """A bin from 1 on for each value: right-closed intervals, the first one closed on both sides.

    Equal bounds raise, or leave the bins between them out with ``merge_equal``.
    """
    edges = quantile_edges(df, value, bins)  # one row
    if not merge_equal:
        apart = F.size(F.array_distinct("edges")) == F.size("edges")
        edges = edges.select(F.when(apart | F.col("edges").isNull(), F.col("edges")).otherwise(F.raise_error(F.lit("bounds of bins are equal; merge_equal merges such bins")).cast("array<double>")).alias("edges"))
    inner_edges = F.slice(F.array_distinct("edges"), 2, F.greatest(F.lit(0), F.size(F.array_distinct("edges")) - 2))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(inner_edges, lambda e: e < F.col(value))) + 1)).drop("edges")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("r"))


# windows and order


def top_per_group(df: DataFrame, keys: Names, k: int, *order: Column | str, rank: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark cuts groups before the shuffle."""
    name = rank or "rank in group"
    made = df.withColumn(name, F.row_number().over(Window.partitionBy(*_list(keys)).orderBy(*order))).where(F.col(name) <= k)
    return made if rank else made.drop(name)


def numbered_repeats(df: DataFrame, text: str, order: Sequence[str], keys: Names = (), between: str = "_") -> DataFrame:
    """Texts that occur more than once, within the keys, get the number of their occurrence; others stay."""
    group = Window.partitionBy(*_list(keys), text)
    n = F.count(F.lit(1)).over(group)
    k = F.row_number().over(group.orderBy(*order))
    return df.withColumn(text, F.when(n > 1, F.concat(F.col(text), F.lit(between), k.cast("string"))).otherwise(F.col(text)))


def repeated(df: DataFrame, keys: Names) -> DataFrame:
    """All rows of keys that occur more than once."""
    return df.withColumn("n of key", F.count(F.lit(1)).over(Window.partitionBy(*_list(keys)))).where("`n of key` > 1").drop("n of key")


def nearest_to_median(df: DataFrame, group: str, value: str, k: int, *order: str) -> DataFrame:
    """The k rows of each group nearest to its median."""
    middle = median(df, group, value)
    return top_per_group(df.join(middle, group).withColumn("gap", F.abs(F.col(value) - F.col("median"))), group, k, "gap", *order)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows by an order: kept in each task, merged once."""
    return df.orderBy(*order).limit(n)


def top_keys_by_total(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Rows of the n keys with the largest sums."""
    best = df.groupBy(key).agg(F.sum(value).alias("total of key")).orderBy(F.desc("total of key"), key).limit(n)
    return df.join(best.select(key), key, "left_semi")


def sample(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones in every run: the first by a seeded hash of their keys."""
    return df.orderBy(_draw(seed, keys), *keys).limit(n)


def shuffled(df: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    """All rows in a random order that is the same in every run."""
    return df.orderBy(_draw(seed, keys), *keys)


def _draw(seed: int, keys: Sequence[str]) -> Column:
    """A number from 0 to 2^32 - 1 that looks random: of the seed and the keys as text, by MD5, as other programs compute it too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))), 1, 8), 16, 10).cast("long")


def split(df: DataFrame, share: float, *keys: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two parts by a seeded hash of the keys: about the share, and the rest."""
    place = _draw(seed, keys)
    return df.where(place < int(share * 2**32)), df.where(place >= int(share * 2**32))


# shape


def pivot(df: DataFrame, row: Names, column: str, value: str, values: Sequence | None = None, fill: float | None = None) -> DataFrame:
    """Long to wide; a repeated cell raises. Without ``values`` the distinct ones are found first."""
    rows = _list(row)
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"a repeated cell of {rows} and {column}")).cast(df.schema[value].dataType)).otherwise(F.first(value))
    wide = df.groupBy(*rows).pivot(column, list(values) if values is not None else None).agg(one)
    return wide if fill is None else wide.na.fill(fill)


def transposed(df: DataFrame, row: str, columns: Sequence[str], name: str = "column") -> DataFrame:
    """Columns to rows and rows to columns: one row for each of ``columns``, with a column for each value of ``row``."""
    long = melt(df, [row], columns).withColumnRenamed("variable", name)
    return pivot(long, name, row, "value")


def permuted(cells: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells with the places of their row and column, in that order: rows(name, position) and columns(name, position) say where each goes; others are left out."""
    placed = cells.join(rows.select(F.col("name").alias(row), F.col("position").alias("row_position")), row).join(columns.select(F.col("name").alias(column), F.col("position").alias("column_position")), column)
    return placed.orderBy("row_position", "column_position")


def in_batches(df: DataFrame, fn: Callable, schema: str, size: int, at_once: int | None = None) -> DataFrame:
    """``fn`` over pandas frames of exactly ``size`` rows, but for the last of a task; ``at_once`` bounds how many tasks call it at a time."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        held, have = [], 0
        for frame in frames:
            while len(frame):
                part, frame = frame.iloc[: size - have], frame.iloc[size - have :]
                held.append(part)
                have += len(part)
                if have == size:
                    yield fn(pd.concat(held, ignore_index=True))
                    held, have = [], 0
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return (df if at_once is None else df.repartition(at_once)).mapInPandas(run, schema)


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(columns), "variable", "value")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first that the second lacks."""
    return a.select(*b.columns).subtract(b)


def clip_to_range(df: DataFrame, value: str, low: DataFrame) -> DataFrame:
    """Values clipped to the range of another table's column of the same name (one row is broadcast)."""
    bounds = low.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return df.join(F.broadcast(bounds)).withColumn(value, F.least(F.greatest(value, "low"), "high")).drop("low", "high")


def repartitioned(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)
