"""The pipeline and the registered queries on the smallest tables, and what the rest must not do."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from orrerix.llm import phrase_index, queries, simhash_trie, tokens, weak_pii
from orrerix.llm.common import stored, table

from .test_operators import plain_contamination, plain_ids, plain_repeats, plain_simhash, plain_spans, similar_classes

ROOT = Path(__file__).resolve().parent.parent.parent


def test_every_operator_is_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {m[0] for n in queries.QUERIES if (m := re.match(r"op\d+_", n))}
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    found = [p for p in (ROOT / "orrerix").rglob("*.py") if "llm" not in p.relative_to(ROOT / "orrerix").parts[0] and re.search(r"\bllm\b", p.read_text())]
    assert not found and "localCheckpoint" not in "".join(p.read_text() for p in (ROOT / "orrerix").rglob("*.py"))


def test_native_operator_runs_no_python(shared, sf):
    plan = queries.QUERIES["op9_phrase_index"](shared, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    source = (ROOT / "orrerix/llm/phrase_index.py").read_text()
    assert not re.search(r"mapIn|applyIn|udf|pandas|\.rdd", source)


def test_decontamination_equals_sql(shared, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE["op9_phrase_index"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, queries.QUERIES["op9_phrase_index"](shared, sf).select(*names).collect())) == sorted(want)


def test_stages_against_plain_programs(shared, sf):
    docs = table(shared, sf, "documents")
    columns, bench = docs.columns, [tuple(r) for r in table(shared, sf, "benchmark").collect()]
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(shared, out[-1], sf), name.replace(" ", "-")))
    assert [x.columns for x in out[:-1]] == [columns] * 5
    rows = [{r.doc_id: r.text for r in x.collect()} for x in out[1:-1]]
    quality = {r.doc_id: r.quality for r in table(shared, sf, "labels").collect()}
    held = [i for i in quality if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(i in rows[0]) == (quality[i] == 1) for i in held]) > 0.9
    ids = sorted(rows[0].items())
    label, near = similar_classes(ids)
    want = {ids[x][0] for x in set(label)}
    clear = [not ((0.75 < x) & (x < 0.85)).any() for x in near]  # the sketch may err at the threshold
    assert all((i in rows[1]) == (i in want) for (i, _), c in zip(ids, clear, strict=True) if c) and sum(clear) > 0.8 * len(ids)
    bad = {r[0] for r in plain_contamination(sorted(rows[1].items()), bench) if r[5]}
    assert set(rows[2]) == set(rows[1]) - bad
    assert set(rows[3]) == set(rows[2]) and all(not plain_spans(t) for t in rows[3].values())
    assert all(rows[3][i] == t for i, t in rows[2].items() if not weak_pii.spans_of(t))
    assert all(r.n_chars == len(r.text) for r in out[4].collect() if r.text != rows[2][r.doc_id])
    pieces = defaultdict(int)
    for r in out[5].collect():
        pieces[r.doc_id] += r.length
    assert dict(pieces) == {i: len(plain_ids(t)) + 1 for i, t in rows[3].items()}


def test_stages_on_awkward_and_empty_tables(shared, sf, awkward):
    names = {n: awkward.columns.index(n) for n in ("doc_id", "text")}
    odd = awkward.withColumnsRenamed({"score": "score 0", "predicted": "kept 0", "key": "text key 1", "fp": "again", "part": "statistic n_chars"}).withColumn("row of", awkward.row)
    bench = [tuple(r) for r in table(shared, sf, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            made = stage(shared, docs, sf)
            got = made.collect()
            if docs is not odd:
                assert got == []
                continue
            if name == "packing":
                assert sum(r.length for r in got) == sum(len(plain_ids(t or "")) + 1 for _, t in rows)
                continue
            assert made.columns == odd.columns
            if name == "benchmark decontamination":
                assert Counter((r[names["doc_id"]], r[names["text"]]) for r in got) == Counter((i, t) for (i, t), x in zip(rows, plain_contamination(rows, bench), strict=True) if not x[5])
            elif name == "personal data":
                assert Counter(r[names["doc_id"]] for r in got) == Counter(i for i, _ in rows)
            else:
                assert not Counter((r[names["doc_id"]], r[names["text"]]) for r in got) - Counter(rows)


def test_near_duplicates_are_exact_on_a_whole_table(shared):
    """No document is dropped that the exact overlap keeps, and none kept that it drops."""
    docs = table(shared, "/root/testdata/sf0.01", "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    label, _ = similar_classes(rows)
    assert sorted(r.doc_id for r in simhash_trie.representatives(docs).collect()) == sorted({rows[x][0] for x in set(label)})


def test_whole_tables_against_plain_programs(shared, sf):
    rows = sorted((r.doc_id, r.text) for r in table(shared, sf, "documents").collect())
    assert Counter(tuple(r)[:5] for r in queries.QUERIES["op6_suffix_radix"](shared, sf).collect()) == Counter(plain_repeats(rows))
    starts, at = {}, 0
    for i, t in rows:
        ids = [*plain_ids(t), 2]
        starts[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op4_token_files"](shared, sf).collect()} == starts
    packed = queries.QUERIES["op2_vector_packing"](shared, sf).toPandas()
    texts = dict(rows)
    for r in packed.itertuples():
        ids = [*plain_ids(texts[r.doc_id]), 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packed.length.sum() == at and (packed.groupby("sequence_id").length.sum() <= 4096).all()
    got = queries.QUERIES["op3_simhash_trie"](shared, sf).collect()
    codes = np.array([plain_simhash(t, 4) for _, t in rows], np.uint64)
    near, least = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4, np.array([i for i, _ in rows])
    while ((new := np.where(near, least[None, :], least.max()).min(axis=1)) != least).any():
        least = new
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{c:016x}", m) for (i, _), c, m in zip(rows, codes.tolist(), least.tolist(), strict=True)}


def test_further_queries_run(shared, sf):
    packed = queries.QUERIES["conversation_packing"](shared, sf).toPandas().groupby("sequence_id").agg(n=("n_tokens", "sum"), k=("n_tokens", "count"), m=("n_loss", "sum"))
    assert (packed.n <= 4096).all() and (packed.k <= 16).all() and (packed.m <= 2048).all() and (packed.m > 1000).any()
    assert queries.QUERIES["benchmark_proximity"](shared, sf).count() > 0


@pytest.mark.parametrize("name", ["op1_toxicity", "op5_multiset_hash", "op7_rule_ensemble", "op8_pseudo_likelihood", "op10_weak_pii"])
def test_other_queries_give_a_row_for_each_document(shared, sf, name):
    got = queries.QUERIES[name](shared, sf)
    assert got.select("doc_id").distinct().count() == got.count() == table(shared, sf, "documents").count()


def area(score, label):
    """The share of pairs of unlike labels that the scores put in order, ties half."""
    a, b = score[label == 1], score[label == 0]
    return float(((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])).mean())


@pytest.mark.parametrize("name,column,fold,least", [("op1_toxicity", "toxic", (4, 2), 0.7), ("op7_rule_ensemble", "quality", (3, 1), 0.95)])
def test_scores_of_rows_that_nothing_was_learned_from(shared, name, column, fold, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[column] for r in table(shared, sf, "labels").collect()}
    got = queries.QUERIES[name](shared, sf).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.3 if column == "toxic" else 0.5))
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert area(*map(np.array, zip(*held, strict=True))) > least


def test_personal_data_query_against_a_plain_program(shared, sf):
    texts = {r.doc_id: r.text or "" for r in table(shared, sf, "documents").collect()}
    for r in queries.QUERIES["op10_weak_pii"](shared, sf).collect():
        base = plain_spans(texts[r.doc_id])
        shown = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, x in base) for k in ("email", "ip", "card", "phone")]


def test_multiset_query_against_a_plain_program(shared, sf):
    rows = sorted(((r.doc_id, r.text or "") for r in table(shared, sf, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op5_multiset_hash"](shared, sf).collect()}
    of = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.fingerprint == r.edited_fingerprint) == (t == edited)
        of[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in of.values()) and len({min(x) for x in of.values()}) == len(of)


def test_fingerprints_ignore_how_rows_are_dealt(shared, sf):
    docs = table(shared, sf, "documents")
    a, b = (simhash_trie.near_duplicates(d).collect() for d in (docs, docs.repartition(7)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    bench = table(shared, sf, "benchmark")
    a, b = (phrase_index.contamination(d, bench).collect() for d in (docs, docs.repartition(7)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_no_vocabulary_file_is_in_the_repository():
    assert not [p for p in ROOT.rglob("*") if p.suffix in (".json", ".tiktoken", ".model") and p.stat().st_size > 100_000]
    assert Path(tokens.word_bpe_path()).exists()
