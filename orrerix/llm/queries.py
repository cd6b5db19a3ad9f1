"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_join, multiset_hash, phrase_index, pseudo_likelihood, rule_ensemble, simhash_trie, suffix_radix, token_files, toxicity, turn_repair, vector_packing, voronoi_negatives, weak_pii
from .common import table
from .labels import remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, by labels outside the fold.  Null and empty texts, repeated rows, null ids and empty tables as ``toxicity.toxicity`` says."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 4096 tokens, a row for each piece.  Nulls, repeats and empty tables as ``vector_packing.pack_documents`` says."""
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under limits on tokens, segments and the tokens of the assistant's turns."""
    return vector_packing.pack_conversations(table(spark, sf_dir, "conversations"))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.  Nulls, repeats and empty tables as ``simhash_trie.near_duplicates`` says."""
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from token files.  Nulls, repeats and empty tables as ``token_files.write_token_files`` says."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.  Nulls, repeats and empty tables as ``multiset_hash.against_next`` says."""
    return multiset_hash.against_next(table(spark, sf_dir, "documents"))


def op6_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without repeated windows.  Nulls, repeats and empty tables as ``suffix_radix.without_repeats`` says."""
    return suffix_radix.without_repeats(table(spark, sf_dir, "documents"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, by labels outside the fold.  Null and empty texts have zero statistics; repeated rows and null ids are scored each; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    scored = rule_ensemble.with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a model of all documents.  Nulls, repeats and empty tables as ``pseudo_likelihood.pseudo_likelihood`` says."""
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What benchmark items hit of every document.  Nulls, repeats and empty tables as ``phrase_index.contamination`` says."""
    docs = table(spark, sf_dir, "documents")
    return phrase_index.contamination(docs, table(spark, sf_dir, "benchmark"), index=phrase_index.Index(docs)).drop("text_key")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold all words of a benchmark item within its length and four words more, in any order."""
    return phrase_index.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text.  Nulls, repeats and empty tables as ``weak_pii.personal_data`` says."""
    return weak_pii.personal_data(table(spark, sf_dir, "documents"))


def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every whole text.  Nulls, repeats and empty tables as ``license_join.licenses`` says."""
    return license_join.licenses(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair.  Nulls, repeats and empty tables as ``turn_repair.repair`` says."""
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op13_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive.  Nulls, repeats and empty tables as ``voronoi_negatives.hard_negatives`` says."""
    return voronoi_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_vector_packing": op2_vector_packing,
    "op3_simhash_trie": op3_simhash_trie,
    "op4_token_files": op4_token_files,
    "op5_multiset_hash": op5_multiset_hash,
    "op6_suffix_radix": op6_suffix_radix,
    "op7_rule_ensemble": op7_rule_ensemble,
    "op8_pseudo_likelihood": op8_pseudo_likelihood,
    "op9_phrase_index": op9_phrase_index,
    "op10_weak_pii": op10_weak_pii,
    "op11_license_join": op11_license_join,
    "op12_turn_repair": op12_turn_repair,
    "op13_voronoi_negatives": op13_voronoi_negatives,
    "benchmark_proximity": benchmark_proximity,
    "conversation_packing": conversation_packing,
}
_OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(s) WHERE len(w) > 0),
dw AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS t(s) WHERE len(w) >= k),
hits AS (SELECT dw.r, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + k)) AS t(p) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""
_LICENSES = ", ".join(f"({i}, '{label}', {license_join.template_words(sentence)})" for i, (label, sentence) in enumerate(license_join.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', {phrase.split(' ')})" for phrase, label in license_join.PHRASES)
_OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
phrases(label, p) AS (VALUES {_PHRASES}),
templates(id, label, t) AS (VALUES {_LICENSES}),
places AS (SELECT r, label, s - 1 AS s FROM d, phrases, unnest(range(1, len(w) - len(p) + 2)) AS u(s) WHERE w[s] = p[1] AND w[s:s + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n, min(s) AS first_word, max(s) AS last_word, list_sort(list(DISTINCT label)) AS base FROM places GROUP BY r),
blocks AS (SELECT r, w[k + 1:k + {license_join.WIDTH}] AS b FROM d, unnest(range(0, len(w), {license_join.STEP})) AS u(k)),
found AS (
  SELECT r, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks, templates
  WHERE len(list_intersect(b, t)) >= ceil({license_join.CONTAINED} * len(t) - 1e-9)),
more AS (SELECT r, list(DISTINCT label) AS more, max(share) AS best FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base, CAST([] AS VARCHAR[])) || coalesce(more, CAST([] AS VARCHAR[])))), ',') AS labels,
       CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""
_OP13 = r"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS br, b.vec_id AS other_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a, e AS b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id NULLS LAST, br) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.other_id NULLS LAST, s.br) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""
ORACLE: dict[str, str] = {"op9_phrase_index": _OP9, "op11_license_join": _OP11, "op13_voronoi_negatives": _OP13}
