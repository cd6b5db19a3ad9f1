"""Text, list and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"^\s+|\s+$"


def alias_list(lists: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alias, name) of lists with one ``alias: name`` a line.

    A line without a colon names itself; blank lines are skipped; only the first
    colon parts a line; of repeated aliases the last line counts.
    """
    lines = lists.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).withColumn("line", F.regexp_replace("raw", _SPACE, "")).where("line <> ''")
    parts = F.split("line", ":", 2)
    pairs = lines.select(key, "pos", F.regexp_replace(parts[0], _SPACE, "").alias("alias"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), parts[0]), _SPACE, "").alias("name"))
    return pairs.groupBy(key, "alias").agg(F.max_by("name", "pos").alias("name"))


def last_alias(pairs: DataFrame, name: str = "name", alias: str = "alias", pos: str = "pos") -> DataFrame:
    """(name, alias): of several aliases of a name the one that comes last."""
    return pairs.groupBy(name).agg(F.max_by(alias, pos).alias(alias))


def quoted_phrases(prompt: Column) -> Column:
    """The phrases between quotes: every second part of the prompt; an unbalanced quote opens one too."""
    return F.filter(F.split(prompt, '"'), lambda _, i: i % 2 == 1)


def holds_phrase(title: Column, prompt: Column) -> Column:
    """Whether a title holds any quoted phrase of the prompt, in any case; true for a prompt without quotes."""
    return ~F.contains(prompt, F.lit('"')) | F.exists(quoted_phrases(prompt), lambda w: F.contains(F.lower(title), F.lower(w)))


def assay_uri(source: Column, title: Column, data: Column, base: str = "https://example.org/assay/") -> Column:
    """The address of an assay by its source; null for a source without one."""
    field = lambda name: F.get_json_object(data, f"$['{name}']")
    whole = field("aid").cast("double").cast("long").cast("string")
    return (
        F.when(source == "ice", F.concat(F.lit(f"{base}ice/"), F.replace(title, F.lit(" "), F.lit("_"))))
        .when(source == "bindingdb", field("Link to Target in BindingDB"))
        .when(source == "pubchem", F.concat(F.lit(f"{base}pubchem/"), whole))
        .when(source == "chembl", F.concat(F.lit(f"{base}chembl/"), field("chembl_id")))
    )


def first_key_present(data: Column, *keys: str) -> Column:
    """The value of the first key that a JSON object has, null or not; of a list its first element, null if empty; null for invalid text."""
    have = F.json_object_keys(data)
    value = None
    for k in keys:
        one = F.when(F.get_json_object(data, f"$.{k}").startswith("["), F.get_json_object(data, f"$.{k}[0]")).otherwise(F.get_json_object(data, f"$.{k}"))
        value = F.when(F.array_contains(have, k), one) if value is None else value.when(F.array_contains(have, k), one)
    return value


def text_or_nan(c: Column, null_as_text: bool = False) -> Column:
    """A cast to text; with ``null_as_text`` a missing value reads nan, else it stays null."""
    shown = c.cast("string")
    return F.coalesce(shown, F.lit("nan")) if null_as_text else shown


def local_name(uri: Column) -> Column:
    """What follows the last slash, marks that names can't have replaced."""
    return F.regexp_replace(F.element_at(F.split(uri, "/"), -1), r"[#.:-]", "_")


def hex_colour(c: Column) -> Column:
    """The three channels of #rrggbb."""
    return F.array(*(F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)))


def anchor(uri: Column, label: Column) -> Column:
    return F.format_string('<a href="%s">%s</a>', uri, label)
