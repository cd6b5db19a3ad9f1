"""Molecule functions over columns, in Arrow batches; a worker parses a text once.

A molecule takes milliseconds, so Spark is told to run each function where it
stands (as if it weren't deterministic): a condition on its result isn't moved
below the ``distinct`` that it follows.  ``once`` makes columns for the
different texts of a table, not for its rows.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import smiles as s

ACID = "OC(=O)C1=CC=CC=C1C(=O)O"
DIMETHYL_ESTER = "COC(=O)C1=CC=CC=C1C(=O)OC"
DIESTER = "[cH][cH]c(C(=O)OC[CH2,CH,C])c(C(=O)OC[CH2,CH,C])[cH][cH]"


def _in_place(kind: str):
    return lambda f: F.pandas_udf(f, kind).asNondeterministic()


def texts(df: DataFrame, smiles: str) -> DataFrame:
    """The different texts of a column, dealt to all tasks: by their bytes they would go to one."""
    # by another hash than the one of distinct, since Spark leaves out a repartition that changes nothing
    return df.select(smiles).distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(smiles))


def once(df: DataFrame, smiles: str, **made: Column) -> DataFrame:
    """``df`` with columns made from its column of SMILES, each once for every different text, null too."""
    own = texts(df, smiles).select(F.col(smiles).alias("text of molecule"), *(c.alias(n) for n, c in made.items()))
    return df.join(own, F.col(smiles).eqNullSafe(F.col("text of molecule"))).drop("text of molecule")


@lru_cache(maxsize=20_000)
def _parse(text: str | None) -> s.Molecule | None:
    return s.parse(text)


def matches(smiles: Column, pattern: str) -> Column:
    """Whether a molecule holds a pattern; false for null and unreadable text."""
    wanted = s.parse(pattern)
    if wanted is None:
        raise ValueError(f"not SMILES: {pattern!r}")

    @_in_place("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: s.has_substructure(_parse(t), wanted)).astype(bool)

    return run(smiles)


def is_diester(smiles: Column) -> Column:
    """A phthalate with two esters of chains of two carbons or more, of carbon, hydrogen and oxygen only, with a single ring."""
    wanted = s.pattern(DIESTER)

    @_in_place("boolean")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool:
            mol = _parse(t)
            return mol is not None and s.has_substructure(mol, wanted) and all(a.symbol in ("C", "H", "O") for a in mol.atoms) and mol.n_rings() == 1

        return texts.map(one).astype(bool)

    return run(smiles)


def matches_smarts(smiles: Column, smarts: str) -> Column:
    """Whether a molecule holds a pattern with a choice of atoms, as ``smiles.pattern`` reads it; false for null and unreadable text."""
    wanted = s.pattern(smarts)
    if wanted is None:
        raise ValueError(f"not a pattern: {smarts!r}")

    @_in_place("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: s.has_substructure(_parse(t), wanted)).astype(bool)

    return run(smiles)


def fingerprint(smiles: Column, radius: int = 2, bits: int = 2048) -> Column:
    """Sorted set bits; empty for what isn't a molecule."""

    @_in_place("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: s.circular_fingerprint(_parse(t), radius, bits))

    return run(smiles)


def readable(smiles: Column) -> Column:
    @_in_place("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _parse(t) is not None).astype(bool)

    return run(smiles)


def descriptors(smiles: Column) -> Column:
    """A struct of exact_weight, logp, rotatable_bonds, fraction_sp3, n_rings, heavy_atoms; nulls for what isn't a molecule."""

    @_in_place(", ".join(f"{n} double" for n in s.DESCRIPTORS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([s.descriptors(_parse(t)) for t in texts], columns=list(s.DESCRIPTORS), dtype=float)

    return run(smiles)


def canonical(smiles: Column) -> Column:
    """SMILES that are the same however a molecule was written, so that tables of molecules can be joined; null for what isn't one."""

    @_in_place("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: s.canonical(_parse(t)))

    return run(smiles)


def match_lists(smiles: Column, pattern: str) -> Column:
    """Atoms and bonds of each place where a molecule holds a pattern, numbered as they are written; none for what isn't a molecule."""
    wanted = s.parse(pattern)
    if wanted is None:
        raise ValueError(f"not SMILES: {pattern!r}")

    @_in_place("array<struct<atoms:array<int>,bonds:array<array<int>>>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"atoms": a, "bonds": [list(x) for x in b]} for a, b in s.match_lists(_parse(t), wanted)])

    return run(smiles)
