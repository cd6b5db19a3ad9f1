"""Graph patterns to joins: a fluent query over a table of triples.

Patterns are ``subject predicate object`` with ``?variables``, ``<iris>``,
``prefix:names``, ``a`` for the type predicate and literals; a clause
``FILTER(...)`` holds comparisons with ``=`` and ``!=``, joined by ``&&`` and
``||``.  Results are bags.  What isn't supported raises.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import product

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(r"""\s*(?:(\?\w+)|<([^<>\s]*)>|("(?:[^"\\]|\\.)*")(?:\^\^(?:<([^<>\s]*)>|([\w-]*:[\w.-]+))|(@[\w-]+))?|(-?\d+(?:\.\d+)?)|([\w-]*:[\w./-]*)|(a)(?=\s|$)|(&&|\|\||!=|=|[().]))""")
_UNSUPPORTED = re.compile(r"\b(OPTIONAL|UNION|GRAPH|MINUS|BIND|VALUES|SERVICE|SELECT|EXISTS)\b", re.I)
_XSD = "http://www.w3.org/2001/XMLSchema#"
_CASTS = {str: "string", int: "bigint", float: "double", bool: "boolean"}


class Query:
    """A query under construction; every method gives the query back."""

    def __init__(self, triples: DataFrame, prefixes: dict[str, str] | None = None):
        self.triples, self.prefixes = triples, dict(prefixes or {})
        self.variables: dict[str, type | None] = {}
        self.clauses: list[str] = []
        self.most: int | None = None

    def prefix(self, name: str, iri: str) -> Query:
        self.prefixes[name] = iri
        return self

    def select(self, *variables: str) -> Query:
        self.variables |= dict.fromkeys(v.lstrip("?") for v in variables)
        return self

    def select_typed(self, types: dict[str, type]) -> Query:
        """Replace what was selected by variables with types to cast to."""
        self.variables = {v.lstrip("?"): t for v, t in types.items()}
        return self

    def where(self, pattern: str) -> Query:
        self.clauses.append(pattern)
        return self

    def limit(self, n: int) -> Query:
        self.most = n
        return self

    def build_query(self) -> str:
        names = " ".join(f"?{v}" for v in self.variables) or "*"
        return f"SELECT {names} WHERE {{ " + " .\n".join(self.clauses) + " }" + (f" LIMIT {self.most}" if self.most is not None else "")

    def execute(self) -> DataFrame:
        """The result; variables that no pattern binds are left out, as long as one is bound."""
        made, terms = self._joined()
        wanted = self.variables or dict.fromkeys(terms)
        bound = {v: t for v, t in wanted.items() if v in terms}
        if not bound:
            raise ValueError(f"no pattern binds any of {sorted(wanted)}")
        out = made.select(*(F.col(v) if t is None else F.col(v).cast(_CASTS[t]).alias(v) for v, t in bound.items()))
        return out if self.most is None else out.limit(self.most)

    def cached(self, folder: str, refresh: bool = False) -> DataFrame:
        """The result kept as Parquet under the query and the plan of its triples; an empty result keeps its schema."""
        spark = self.triples.sparkSession
        key = hashlib.md5(f"{self.build_query()}\n{self.variables}\n{sorted(self.prefixes.items())}\n{self.triples.semanticHash()}".encode()).hexdigest()
        path = f"{folder.rstrip('/')}/{key}.parquet"
        made = self.execute()
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if refresh or not store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            made.write.mode("overwrite").parquet(path)
        return spark.read.schema(made.schema).parquet(path)

    # compiling

    def _term(self, token: tuple) -> tuple:
        variable, iri, quoted, kind, kind_name, language, number, name, is_a, _ = token
        if variable:
            return ("var", variable[1:])
        if iri is not None and iri != "" or name:
            return ("iri", iri or self._expanded(name))
        if is_a:
            return ("iri", TYPE)
        if quoted is not None and quoted != "":
            text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), quoted[1:-1])
            return ("literal", text, kind or (self._expanded(kind_name) if kind_name else None) or language or None)
        if number:
            return ("literal", number, _XSD + ("decimal" if "." in number else "integer"))
        raise ValueError(f"not a term: {token}")

    def _expanded(self, name: str) -> str:
        prefix, _, rest = name.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + rest

    def _tokens(self, text: str) -> list[tuple]:
        out, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read {text[at:].strip()!r}")
            out.append(m.groups())
            at = m.end()
        return out

    def _parsed(self) -> tuple[list[list[tuple]], list[list[tuple]]]:
        patterns, filters = [], []
        for clause in self.clauses:
            bare = re.sub(r'"(?:[^"\\]|\\.)*"|<[^<>]*>', "", clause)
            if m := _UNSUPPORTED.search(bare):
                raise ValueError(f"{m[1]} isn't supported")
            if re.match(r"\s*FILTER\b", clause, re.I):
                filters.append(self._tokens(re.sub(r"^\s*FILTER\b", "", clause, flags=re.I)))
                continue
            row: list[tuple] = []
            for token in [*self._tokens(clause), (*[None] * 9, ".")]:
                if token[-1] == ".":
                    if row and len(row) != 3:
                        raise ValueError(f"a pattern has three terms: {clause!r}")
                    patterns += [row] if row else []
                    row = []
                elif token[-1]:
                    raise ValueError(f"unexpected {token[-1]!r} in {clause!r}")
                else:
                    row.append(self._term(token))
        if not patterns:
            raise ValueError("no pattern")
        return patterns, filters

    def _one(self, pattern: list[tuple]) -> tuple[DataFrame, set[str]]:
        """A pattern as a filtered table; a variable's kind and datatype come along under its name."""
        df, columns, seen = self.triples, [], {}
        for place, term in zip("spo", pattern, strict=True):
            kind = F.when(F.col("s").startswith("_:"), "blank").otherwise("iri") if place == "s" else F.lit("iri") if place == "p" else F.col("o_kind")
            datatype = F.col("o_datatype") if place == "o" else F.lit(None).cast("string")
            if term[0] == "var":
                if term[1] in seen:
                    one = seen[term[1]]
                    df = df.where((F.col(place) == one[0]) & (kind == one[1]) & datatype.eqNullSafe(one[2]))
                else:
                    seen[term[1]] = (F.col(place), kind, datatype)
                    columns += [F.col(place).alias(term[1]), kind.alias(f"kind of {term[1]}"), datatype.alias(f"datatype of {term[1]}")]
            else:
                df = df.where(F.col(place) == F.lit(term[1]))
                if place == "o":
                    df = df.where(F.col("o_kind") == term[0])
                    if term[0] == "literal":
                        df = df.where(F.col("o_datatype").eqNullSafe(F.lit(term[2]).cast("string")))
        return df.select(*columns, *([] if columns else [F.lit(1).alias("matched pattern")])), set(seen)

    def _joined(self) -> tuple[DataFrame, set[str]]:
        patterns, filters = self._parsed()
        left = [self._one(p) for p in patterns]
        made, have = left.pop(0)
        while left:
            # patterns that share a variable first; a product only where none does
            i = next((k for k, (_, v) in enumerate(left) if v & have), 0)
            df, variables = left.pop(i)
            shared = sorted(variables & have)
            if not shared:
                made = product(made, df.drop("matched pattern") if variables else df.withColumnRenamed("matched pattern", f"matched {len(left)}"))
            else:
                # terms are equal by value, kind and datatype
                right = df.select(*(F.col(c).alias(f"{c} right") if any(c in (v, f"kind of {v}", f"datatype of {v}") for v in shared) else F.col(c) for c in df.columns))
                same = [(F.col(v) == F.col(f"{v} right")) & (F.col(f"kind of {v}") == F.col(f"kind of {v} right")) & F.col(f"datatype of {v}").eqNullSafe(F.col(f"datatype of {v} right")) for v in shared]
                made = made.join(right, reduce(lambda x, y: x & y, same)).drop(*(c for c in right.columns if c.endswith(" right")))
            have |= variables
        for tokens in filters:
            made = made.where(self._condition(tokens, have))
        return made, have

    def _same(self, a: tuple, b: tuple) -> Column:
        """Whether two terms are equal: by value, kind and datatype."""
        parts = [(F.col(t[1]), F.col(f"kind of {t[1]}"), F.col(f"datatype of {t[1]}")) if t[0] == "var" else (F.lit(t[1]), F.lit(t[0]), F.lit(t[2] if len(t) > 2 else None).cast("string")) for t in (a, b)]
        return (parts[0][0] == parts[1][0]) & (parts[0][1] == parts[1][1]) & parts[0][2].eqNullSafe(parts[1][2])

    def _condition(self, tokens: list[tuple], have: set[str]) -> Column:
        rest = list(tokens)

        def sign() -> str | None:
            return rest[0][-1] if rest else None

        def either() -> Column:
            one = both()
            while sign() == "||":
                rest.pop(0)
                one = one | both()
            return one

        def both() -> Column:
            one = single()
            while sign() == "&&":
                rest.pop(0)
                one = one & single()
            return one

        def single() -> Column:
            if sign() == "(":
                rest.pop(0)
                one = either()
                if sign() != ")":
                    raise ValueError("a bracket isn't closed")
                rest.pop(0)
                return one
            if len(rest) < 3 or rest[1][-1] not in ("=", "!="):
                raise ValueError("a filter compares two terms with = or !=")
            a, op, b = self._term(rest.pop(0)), rest.pop(0)[-1], self._term(rest.pop(0))
            for t in (a, b):
                if t[0] == "var" and t[1] not in have:
                    raise ValueError(f"?{t[1]} isn't bound")
            same = self._same(a, b)
            return same if op == "=" else ~same

        made = either()
        if rest:
            raise ValueError(f"unexpected {rest[0]}")
        return made


def describe(triples: DataFrame, subject: str) -> DataFrame:
    return triples.where(F.col("s") == subject).select("p", "o")


def first_value(triples: DataFrame, subject: str, predicate: str) -> str | None:
    """The smallest value of a property, or null."""
    return triples.where((F.col("s") == subject) & (F.col("p") == predicate)).agg(F.min("o").alias("o")).first().o


def schema_summary(triples: DataFrame, types: str = TYPE) -> DataFrame:
    """(class, predicate, target): which predicates lead from class to class.

    Of several types of a subject the largest counts; literals lead nowhere (a
    null target) and what has no type is external; type predicates are left out.
    """
    of = triples.where(F.col("p") == types).groupBy("s").agg(F.max("o").alias("class"))
    edges = triples.where(F.col("p") != types)
    source = edges.join(of.withColumnRenamed("class", "from"), "s", "left")
    target = of.select(F.col("s").alias("to"), F.col("class").alias("target"))
    made = source.join(target, (F.col("o") == F.col("to")) & (F.col("o_kind") != "literal"), "left")
    return made.select(F.coalesce("from", F.lit("external")).alias("class"), F.col("p").alias("predicate"), F.when(F.col("o_kind") != "literal", F.coalesce("target", F.lit("external"))).alias("target")).distinct()


def class_predicates(triples: DataFrame) -> DataFrame:
    """(class, predicates): each class with its predicates in order."""
    return schema_summary(triples).groupBy("class").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))


def plantuml(triples: DataFrame) -> str:
    """The schema of a graph as a class diagram; as small as the schema."""
    from ..functions.text import local_name

    short = lambda c: local_name(F.col(c)).alias(c)
    rows = schema_summary(triples).select(short("class"), short("predicate"), short("target")).distinct().orderBy("class", "predicate", "target").collect()
    lines, classes = ["@startuml"], {}
    for r in rows:
        classes.setdefault(r["class"], []).append(r.predicate)
    for c, predicates in sorted(classes.items()):
        lines += [f"class {c} {{", *(f"  {p}" for p in sorted(set(predicates))), "}"]
    return "\n".join([*lines, *(f"{r['class']} --> {r.target} : {r.predicate}" for r in rows if r.target), "@enduml"])
