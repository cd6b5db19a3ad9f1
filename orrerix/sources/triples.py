"""N-Triples in and out, and triples made from rows.

A triple is (s, p, o, o_kind, o_datatype): o_kind is iri, blank or literal, and
o_datatype the datatype IRI or @language of a literal, null for a plain one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, o_kind string, o_datatype string"
# possessive loops: whole texts must not make the matcher recurse
_HEAD = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+"
_QUOTED = r"^\"(?:[^\"\\]++|\\.)*+\""
_END = r"\s*\.\s*(?:#.*)?$"
_NODE = rf"^(<[^>]*>|_:\S+){_END}"
_SUFFIX = rf"^(?:\^\^<([^>]*)>|(@[A-Za-z0-9-]+))?{_END}"


def _plain(term: Column) -> Column:
    return F.regexp_replace(term, r"^<(.*)>$", "$1")


#: Stands for a backslash that was escaped, so that it can't start another escape.
_MARK = "\ue000"


def _short_unescaped(text: Column) -> Column:
    r"""Escapes of one character resolved; ``\\`` becomes a private mark."""
    out = F.replace(text, F.lit("\\\\"), F.lit(_MARK))
    for shown, real in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        out = F.replace(out, F.lit(shown), F.lit(real))
    return out


def _unescaped(out: Column) -> Column:
    r"""What ``_short_unescaped`` leaves: \uXXXX and \UXXXXXXXX, and the marks."""
    # split before each and put the character in
    parts = F.split(out, r"(?=\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})")
    # with a byte order mark in front, so that an escaped one is a character
    code = lambda x, n: F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.substring(x, 3, n), 8, "0"))), "UTF-32")
    shown = F.transform(
        parts,
        lambda x: F.when(x.rlike(r"^\\u[0-9A-Fa-f]{4}"), F.concat(code(x, 4), F.expr("''"), F.substr(x, F.lit(7)))).when(x.rlike(r"^\\U[0-9A-Fa-f]{8}"), F.concat(code(x, 8), F.substr(x, F.lit(11)))).otherwise(x),
    )
    escaped = F.contains(out, F.lit("\\u")) | F.contains(out, F.lit("\\U"))
    return F.replace(F.when(escaped, F.array_join(shown, "")).otherwise(out), F.lit(_MARK), F.lit("\\"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The distinct triples of N-Triples files; comments and blank lines are skipped, a malformed line raises."""
    return parse_ntriples(spark.read.text(path))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """The distinct triples of lines in the column ``value``.

    A line is taken apart from left to right, a select for each step, so that a
    long text is matched once and what other steps look at is short.
    """
    kept = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    rest = kept.select("value", F.regexp_extract("value", _HEAD, 0).alias("head")).select("value", "head", F.substr("value", F.length("head") + 1).alias("rest"))
    literal = F.col("rest").startswith('"')
    quoted = rest.select("value", "head", "rest", F.when(literal, F.regexp_extract("rest", _QUOTED, 0)).otherwise("").alias("quoted"))
    ended = quoted.select("*", F.substr("rest", F.length("quoted") + 1).alias("end"))
    text = _short_unescaped(F.substr("quoted", F.lit(2), F.length("quoted") - 2))
    node = F.regexp_extract("end", _NODE, 1)
    parts = ended.select("value", "head", "end", literal.alias("literal"), (F.col("quoted") != "").alias("closed"), F.when(literal, text).alias("text"), F.when(~literal, node).alias("node"))
    good = (F.col("head") != "") & F.when(F.col("literal"), F.col("closed") & F.col("end").rlike(_SUFFIX)).otherwise(F.col("node") != "")
    datatype = F.coalesce(*(F.nullif(F.regexp_extract("end", _SUFFIX, k), F.lit("")) for k in (1, 2)))
    # in a column, not a condition: Spark would work out all steps for that alone and again for the columns
    return parts.select(
        F.when(good, _plain(F.regexp_extract("head", _HEAD, 1))).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), "value"))).alias("s"),
        F.regexp_extract("head", _HEAD, 2).alias("p"),
        F.when(F.col("literal"), _unescaped(F.col("text"))).otherwise(_plain(F.col("node"))).alias("o"),
        F.when(F.col("literal"), "literal").when(F.col("node").startswith("_:"), "blank").otherwise("iri").alias("o_kind"),
        F.when(F.col("literal"), datatype).alias("o_datatype"),
    ).distinct()


def ntriples(triples: DataFrame) -> DataFrame:
    """(value): a line for each triple."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("o")
    for real, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(real), F.lit(shown))
    suffix = F.when(F.col("o_datatype").startswith("@"), F.col("o_datatype")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    shown = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), suffix)).otherwise(node("o"))
    return triples.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), shown, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


def add_triples(have: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of triples, each once."""
    return have.unionByName(more).distinct()


def construct(rows: DataFrame, subject: Column, parts: dict[str, tuple[Column, str, str | None]], deal: bool = True) -> DataFrame:
    """A triple of each row and part: predicate -> (object, kind, datatype); null objects make none.

    Rows are dealt by their subject before they become triples, which are many
    times as large: whoever makes triples distinct then holds a task's share of
    subjects, not what one file has.  Without ``deal`` they stay where they are.
    """
    own = rows.select(subject.alias("s"), *(o.cast("string").alias(f"object {k}") for k, (o, _, _) in enumerate(parts.values())))
    own = own.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s") if deal else own
    made = [F.struct(F.lit(p).alias("p"), F.col(f"object {k}").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype")) for k, (p, (_, kind, datatype)) in enumerate(parts.items())]
    each = own.select("s", F.explode(F.array(*made)).alias("t"))
    return each.where("t.o is not null").select("s", "t.*")
