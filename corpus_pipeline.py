"""From raw documents to packed training sequences, one stage after another.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerix.llm import phrase_index, rule_ensemble, simhash_trie, vector_packing, weak_pii
from orrerix.llm.common import discard, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more; it learns from the labels of the table ``documents``.

    A null or empty text has the statistics of a text without words and is judged
    by them; repeated rows and ties share their fate; texts of any length are
    judged whole; without labels all rows stay; an empty table gives no rows;
    columns may have any names.
    """
    model = rule_ensemble.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score, kept = (next(n for k in range(len(docs.columns) + 1) if (n := f"{name} {k}") not in docs.columns) for name in ("score", "kept"))
    return rule_ensemble.with_quality(docs, model, score, 0.5, kept).where(F.col(kept) == 1).drop(score, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Near duplicates share 0.8 of their five-word shingles or more.  Null doc_ids
    come last, ties go by a hash of the text and then by the other columns; null,
    empty and wordless texts are alike; texts of any length are compared whole;
    an empty table gives no rows; columns may have any names.
    """
    return simhash_trie.representatives(docs, words=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate.

    Null and empty texts are clean; rows alike in doc_id and text share their
    fate; texts of any length are searched whole; without items all rows stay; an
    empty table gives no rows; columns may have any names.
    """
    return phrase_index.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    Null and empty texts, null doc_ids and repeated rows stay as they are; texts
    of any length are searched whole; overlapping spans are replaced as one; an
    empty table gives no rows; columns may have any names.
    """
    return weak_pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in training sequences.

    A null or empty text is one end id; null doc_ids and repeated rows are
    documents of their own; texts of any length are cut into pieces; an empty
    table gives no rows; other columns are ignored.
    """
    return vector_packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Tokenisation and the trained stages aren't SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
