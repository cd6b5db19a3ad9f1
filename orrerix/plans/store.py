"""A graph stored by predicate, with terms as numbers and statistics that order joins.

``build`` writes three tables: ``terms`` (id, value, kind, datatype), sorted, so
that a term is looked up by row groups; ``triples`` (s, o) as ids, a partition
for each predicate; and ``predicates`` (predicate, n, subjects, objects).  A query
reads the partitions of its predicates, joins numbers, and only looks up the
terms of what it returns.  Terms and rows are both large, so they are joined by
shuffles, but terms with very many rows (a class, a predicate) are broadcast:
their rows stay dealt to all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import product
from ..operators.selection import numbered
from ..scratch import discard, stored
from .bgp import _CASTS, Query

_TERM = ["value", "kind", "datatype"]
#: A term is broadcast where it has more rows than HOT and than one in MOST_HOT of all, so at most MOST_HOT terms are.
HOT, MOST_HOT = 10_000, 10_000


def _kind(c: str) -> Column:
    return F.when(F.col(c).startswith("_:"), "blank").otherwise("iri")


def _hot(counted: DataFrame, rows: int) -> DataFrame:
    return counted.where(F.col("rows of term") > max(HOT, rows // MOST_HOT)).drop("rows of term")


def _joined_terms(rows: DataFrame, on: dict[str, Column], spread: dict[str, Column], known: DataFrame, hot: DataFrame, take: str, name: str) -> DataFrame:
    """``rows`` with the column ``take`` of known(those of ``on``, take) as ``name``; rows without a term are left out.

    Rows of the hot terms, a broadcast table of some of the keys, go to the
    shuffle by keys of their own, ``spread``, which no term has.
    """
    few = known.join(F.broadcast(hot), [known[k].eqNullSafe(hot[k]) for k in on]).select(*(known[k].alias(f"hot {k}") for k in on), known[take].alias(f"hot {take}"))
    found = rows.where(next(iter(on.values())).isNotNull()).join(F.broadcast(few), [c.eqNullSafe(F.col(f"hot {k}")) for k, c in on.items()], "left").drop(*(f"hot {k}" for k in on))
    is_hot = F.col(f"hot {take}").isNotNull()
    found = found.select("*", *(F.when(is_hot, spread[k]).otherwise(c).alias(f"key {k}") for k, c in on.items()))
    own = known.select(*(F.col(k).alias(f"known {k}") for k in on), F.col(take).alias(f"known {take}")).hint("merge")
    made = found.join(own, [F.col(f"key {k}").eqNullSafe(F.col(f"known {k}")) for k in on], "left")
    made = made.withColumn(name, F.coalesce(f"hot {take}", f"known {take}")).where(F.col(name).isNotNull())
    return made.drop(f"hot {take}", *(f"key {k}" for k in on), *(f"known {k}" for k in on), f"known {take}")


def build(triples: DataFrame, path: str) -> Store:
    """Write triples(s, p, o, o_kind, o_datatype) to ``path``; repeated triples stay repeated."""
    none = F.lit(None).cast("string")
    rows = stored(triples.select("s", "p", "o", "o_kind", "o_datatype"), "triples")
    parts = [(F.col("s"), _kind("s"), none), (F.col("p"), F.lit("iri"), none), (F.col("o"), F.col("o_kind"), F.col("o_datatype"))]
    counted = None
    for place, part in zip("spo", parts, strict=True):
        one = rows.groupBy(*(c.alias(n) for c, n in zip(part, _TERM, strict=True))).agg(F.count(F.lit(1)).alias("rows of term")).withColumn("place", F.lit(place))
        counted = one if counted is None else counted.unionByName(one)
    counted = stored(counted, "counted")
    numbered(counted.select(*_TERM).distinct(), *_TERM).select("id", *_TERM).write.mode("overwrite").parquet(f"{path}/terms")
    spark = triples.sparkSession
    known = spark.read.parquet(f"{path}/terms")
    made, n = rows, rows.count()
    spread = {"value": F.xxhash64("s", "p", "o").cast("string"), "kind": F.lit("spread"), "datatype": none}
    for place, part in zip("spo", parts, strict=True):
        hot = _hot(counted.where(F.col("place") == place).drop("place"), n)
        made = _joined_terms(made, dict(zip(_TERM, part, strict=True)), spread, known, hot, "id", f"id of {place}")
    ids = made.select(F.col("id of s").alias("s"), F.col("id of p").alias("predicate"), F.col("id of o").alias("o"))
    # adaptive execution splits the files of a predicate with many triples
    ids.hint("rebalance", "predicate").write.partitionBy("predicate").mode("overwrite").parquet(f"{path}/triples")
    counts = spark.read.schema("s long, o long, predicate long").parquet(f"{path}/triples").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))
    counts.write.mode("overwrite").parquet(f"{path}/predicates")
    discard(rows, counted)
    return Store(spark, path)


class Store:
    """The graph at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.triples = spark.read.schema("s long, o long, predicate long").parquet(f"{path}/triples")
        self.terms = spark.read.schema("id long, value string, kind string, datatype string").parquet(f"{path}/terms")
        self.predicates = spark.read.schema("predicate long, n long, subjects long, objects long").parquet(f"{path}/predicates")

    def query(self, prefixes: dict[str, str] | None = None) -> StoreQuery:
        return StoreQuery(self, prefixes)

    def ids(self, terms: list[tuple]) -> dict[tuple, int]:
        """The numbers of the terms (value, kind, datatype) that the graph has."""
        if not terms:
            return {}
        values = self.terms.where(F.col("value").isin(sorted({t[0] for t in terms}))).collect()  # a query's constants, in their kinds
        return {key: r.id for r in values if (key := (r.value, r.kind, r.datatype)) in set(terms)}


@dataclass
class _Side:
    """A table of ids with estimates: rows, and different values of each variable."""

    df: DataFrame
    rows: float
    distinct: dict[str, float]
    texts: list[str] = field(default_factory=list)

    def joined(self, other: _Side) -> float:
        """The rows that a join on what both have should give."""
        made = self.rows * other.rows
        for v in self.distinct.keys() & other.distinct.keys():
            made /= max(1.0, self.distinct[v], other.distinct[v])
        return made


class StoreQuery(Query):
    """As ``Query``, over a ``Store``: patterns are joined in the order of their estimated sizes, however they are written."""

    def __init__(self, store: Store, prefixes: dict[str, str] | None = None):
        super().__init__(store.triples, prefixes)
        self.store = store

    @staticmethod
    def _key(term: tuple) -> tuple:
        return (term[1], term[0], term[2] if len(term) > 2 else None) if term[0] == "literal" else (term[1], "blank" if term[1].startswith("_:") else "iri", None)

    def _sides(self, patterns: list[list[tuple]], known: dict[tuple, int]) -> list[_Side]:
        statistics = {r.predicate: r for r in self.store.predicates.where(F.col("predicate").isin([known[self._key(p[1])] for p in patterns if p[1][0] != "var" and self._key(p[1]) in known])).collect()}
        whole = None
        out = []
        for s, p, o in patterns:
            df, found = self.store.triples, True
            if p[0] == "var":
                whole = whole or self.store.predicates.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("subjects"), F.lit(0)).alias("subjects"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.count(F.lit(1)).alias("predicates")).first()
                n, distinct = whole.n, {"s": whole.subjects, "p": whole.predicates, "o": whole.objects}
            else:
                number = known.get(self._key(p))
                one = statistics.get(number)
                found = one is not None
                n, distinct = (one.n, {"s": one.subjects, "o": one.objects}) if found else (0, {"s": 0, "o": 0})
                df = df.where(F.col("predicate") == number) if found else df
            columns, estimates, rows = {}, {}, float(n)
            for place, term in (("s", s), ("p", p), ("o", o)):
                at = F.col("predicate" if place == "p" else place)
                if term[0] != "var":
                    if place != "p":
                        number = known.get(self._key(term))
                        found = found and number is not None
                        df = df.where(at == number) if number is not None else df
                        rows /= max(1.0, distinct[place])
                elif term[1] in columns:
                    df = df.where(at == columns[term[1]])
                    rows /= max(1.0, distinct[place])
                else:
                    columns[term[1]], estimates[term[1]] = at, float(distinct[place])
            df = df if found else df.where(F.lit(False))
            rows = rows if found else 0.0
            picked = [c.alias(v) for v, c in columns.items()] or [F.lit(1).alias("matched pattern")]
            out.append(_Side(df.select(*picked), rows, {v: min(d, max(rows, 1.0)) for v, d in estimates.items()}, [str((s, p, o))]))
        return out

    def _ordered(self, sides: list[_Side]) -> _Side:
        """The smallest first, then always the one that keeps the result smallest; what shares no variable comes last."""
        left = sorted(sides, key=lambda x: (x.rows, x.texts))
        made = left.pop(0)
        while left:
            touching = [x for x in left if x.distinct.keys() & made.distinct.keys()]
            other = min(touching or left, key=lambda x: (made.joined(x), x.rows, x.texts))
            left.remove(other)
            shared = sorted(made.distinct.keys() & other.distinct.keys())
            rows = made.joined(other)
            if shared:
                df = made.df.join(other.df, shared)
            else:
                names = [c for c in other.df.columns if c != "matched pattern"]
                df = product(made.df, other.df.select(*names) if names else other.df.select(F.col("matched pattern").alias(f"matched {len(left)}")))
            distinct = {v: min(d for d in (made.distinct.get(v), other.distinct.get(v)) if d is not None) for v in made.distinct | other.distinct}
            made = _Side(df, rows, {v: min(d, max(rows, 1.0)) for v, d in distinct.items()}, made.texts + other.texts)
        return made

    def order(self) -> list[str]:
        """The patterns in the order in which they are joined."""
        patterns, _ = self._parsed()
        return self._ordered(self._sides(patterns, self.store.ids([self._key(t) for p in patterns for t in p if t[0] != "var"]))).texts

    def _joined(self) -> tuple[DataFrame, set[str]]:
        patterns, filters = self._parsed()
        constants = [self._key(t) for p in patterns for t in p if t[0] != "var"]
        constants += [self._key(self._term(t)) for tokens in filters for t in tokens if t[-1] is None and not t[0]]
        self._known = self.store.ids(constants)
        made = self._ordered(self._sides(patterns, self._known))
        df, have = made.df, set(made.distinct)
        for tokens in filters:
            df = df.where(self._condition(tokens, have))
        return df, have

    def _same(self, a: tuple, b: tuple) -> Column:
        """Terms are equal by their numbers; one that the graph lacks equals nothing that is bound."""
        if a[0] != "var" and b[0] != "var":
            return F.lit(self._key(a) == self._key(b))
        sides = [F.col(t[1]) if t[0] == "var" else F.lit(self._known.get(self._key(t), -1)) for t in (a, b)]
        return sides[0] == sides[1]

    def execute(self) -> DataFrame:
        """The result; only now are the terms of its variables looked up."""
        made, have = self._joined()
        bound = {v: t for v, t in (self.variables or dict.fromkeys(sorted(have))).items() if v in have}
        if not bound:
            raise ValueError(f"no pattern binds any of {sorted(self.variables)}")
        out = made.select(*bound)
        out = stored(out if self.most is None else out.limit(self.most), "found")
        rows, names = out.count(), self.store.terms.select("id", "value")
        hot = {v: _hot(out.groupBy(F.col(v).alias("id")).agg(F.count(F.lit(1)).alias("rows of term")), rows) for v in bound}
        spread = {"id": -1 - F.shiftrightunsigned(F.xxhash64(*bound), 1)}  # numbers of terms aren't negative
        ids = [F.col(v) for v in bound]
        for k, v in enumerate(bound):
            if rows <= HOT:
                out = names.select(F.col("id").alias("id of term"), F.col("value").alias(f"value {k}")).join(F.broadcast(out), F.col("id of term") == F.col(v)).drop("id of term")
            else:
                out = _joined_terms(out, {"id": ids[k]}, spread, names, hot[v], "value", f"value {k}")
        out = out.select(*((F.col(f"value {k}") if t is None else F.col(f"value {k}").cast(_CASTS[t])).alias(v) for k, (v, t) in enumerate(bound.items())))
        return out
