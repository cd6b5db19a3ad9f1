"""License joins, conversation repair and hard negatives against plain programs, on awkward rows, hot groups and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrerix.llm import license_join, queries, turn_repair, voronoi_negatives
from orrerix.llm.common import stored, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# licenses


def plain_licenses(text, templates=license_join.TEMPLATES, phrases=license_join.PHRASES, share=license_join.CONTAINED):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(k, label) for phrase, label in phrases for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    base, more, best = {label for _, label in places}, set(), 0.0
    for label, sentence in templates:
        want = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence.translate(LOWER)))
        for k in range(0, len(words), license_join.STEP):
            held = len(want & set(words[k : k + license_join.WIDTH]))
            if want and held >= math.ceil(share * len(want) - 1e-9):
                more.add(label)
                best = max(best, held / len(want))
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best


def shown(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def license_texts():
    rng = random.Random(3)
    sentence = {label: s for label, s in license_join.TEMPLATES}
    filler = lambda n: " ".join(rng.choice(["und", "the", "pequeño", "software", "x9", "of", "this"]) for _ in range(n))
    gone = sentence["bsd"].split()
    made = [
        "", None, "MIT License", "mit-license; MIT\tLicense! mit licenses", "the mit  license of Apache License and GNU General Public License v3", "general public mit license",
        sentence["mpl"], sentence["mpl"].upper(), filler(31) + " " + sentence["isc"], filler(500) + " " + sentence["unlicense"] + " " + filler(700), " ".join(gone[: len(gone) // 2]),
        " ".join(gone[:-2]), " ".join(w for i, w in enumerate(gone) if i % 5), "license" * 3000, "İMIT License ÀMIT License", "mit license " * 4000, filler(9000), "\x00mit\x7flicense\x00",
    ]
    return made + [sentence["apache"]] * 40 + ["license software"] * 40


def test_licenses_equal_a_plain_program(shared):
    rows = [(i if i % 7 else None, t, "r", 5) for i, t in enumerate(license_texts())]
    got = license_join.licenses(shared.createDataFrame(rows, "doc_id long, text string, row string, words int").repartition(3)).collect()
    assert Counter((r.doc_id, *shown(r)) for r in got) == Counter((i, *plain_licenses(t)) for i, t, *_ in rows)
    assert {"mit", "apache", "gpl", "isc", "bsd", "mpl", "unlicense"} <= {label for r in got for label in r.labels.split(",")}


def test_license_blocks_have_every_pair_over_the_share(shared):
    """Random words with a skewed distribution, own templates, every share: no pair is lost to a filter."""
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    templates = [(f"t{k}", " ".join(word() for _ in range(rng.randint(1, 14)))) for k in range(12)]
    docs = [(k, " ".join(word() for _ in range(rng.choice([3, 10, 70, 300])))) for k in range(80)]
    frame = shared.createDataFrame(docs, "doc_id long, text string")
    for share in (0.4, 0.8, 1.0):
        got = license_join.licenses(frame, license_join.Scan(frame, templates, [("w1 w2", "two")], share)).collect()
        assert {r.doc_id: shown(r) for r in got} == {i: plain_licenses(t, templates, [("w1 w2", "two")], share) for i, t in docs}


def test_licenses_of_awkward_and_empty_tables(awkward, nothing):
    got = license_join.licenses(awkward).collect()
    assert Counter((r.doc_id, *shown(r)) for r in got) == Counter((r.doc_id, *plain_licenses(r.text)) for r in awkward.collect())
    assert license_join.licenses(nothing).collect() == []


def test_licenses_never_shuffle_texts(shared, sf):
    scan = license_join.Scan(table(shared, sf, "documents"))
    assert "text" not in scan.table.columns and "words" not in scan.table.columns
    plan = scan.blocks()._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("CartesianProduct|Cross", plan)


# conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown_of = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown_of(conv)}:{shown_of(turn)}".encode()) % 20
        role, text = shown_of(role), shown_of(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        full = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, audit, lines) from turn i on."""
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        new, said = (3, "assistant") if state == 2 else (2, "user")
        add = lambda cost, letter, line, rest: found.append((cost + rest[0], letter + rest[1], (*line, *rest[2]))) if rest else None
        if inserted < 2:
            add(5, "I", [said + ":"], best(i, new, inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(2, "D", [], best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                paid = 5 if faults[i] == "truncated" else 0
                if (state, role[:1]) in fits:
                    add(paid, "K", [f"{role}:{text}"], best(i + 1, fits[state, role[:1]], 0))
                add(paid + 1, "R", [f"{said}:{text}"], best(i + 1, new, 0))
        return min(found, default=None)

    for i in range(len(rows), -1, -1):
        for state in range(4):
            best(i, state, 2)
    cost, audit, lines = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_repairs(rows):
    of = {conv: [] for conv, *_ in rows}
    for conv, *rest in plain_damage(rows):
        of[conv].append(tuple(rest))
    return {conv: plain_repair(x) for conv, x in of.items()}


def repairs(df):
    got = df.collect()
    made = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(made) == len(got)
    return made


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def random_turns(n, seed, conv=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "u", "", None, "Ärger", "uncle"]
    texts = ["", " \t", "Yes.", "no", "Well!  ", "what?\n", None, "a.b", " ", "x" * 300 + "."]
    return [(conv, rng.choice([k, k, k, k, rng.randint(0, n), None]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"turn {k}.") for k in range(n)]


def test_repair_of_the_whole_table(shared):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in table(shared, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
        assert repairs(queries.QUERIES["op12_turn_repair"](shared, sf)) == plain_repairs(rows)


@pytest.mark.parametrize("length", [1, 3, 1024])
def test_repair_of_awkward_conversations(shared, length):
    """Short segments cut every conversation, so costs are folded and states followed over them."""
    rows = [r for k in range(60) for r in random_turns(random.Random(k).randint(1, 9), k, k if k % 11 else None)] + random_turns(400, 99, 1000) + [(2000, 3, "user", "Same.")] * 30 + [(2001, None, None, None), (2002, 0, "assistant", "Hi.")]
    rows += [(k, 0, "user", "alone") for k in range(3000, 3060)]  # some lose their only turn
    frame = shared.createDataFrame([(*r, 1, "y") for r in rows], CONVERSATIONS + ", code int, part string").repartition(5)
    got, want = repairs(turn_repair.repair(frame, length)), plain_repairs(rows)
    assert got == want and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(range(16)), max_size=9))
def test_cheapest_edits_of_any_codes(codes):
    """The tensor program against a search, for faults and initials in any order."""
    (letters, emits, cost, _), = turn_repair.edits([bytes(codes)], np.array([turn_repair.TERMINAL]), np.zeros(1, np.int64), np.ones(1, bool))
    fits = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
    best = {(0, 0): (0, "")}
    reach = [{} for _ in range(len(codes) + 1)]
    reach[0] = {0: (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(2):
            for s, (c, a) in list(reach[i].items()):
                new = 3 if s == 2 else 2
                reach[i][new] = min(reach[i].get(new, (10**9, "")), (c + 5, a + "I"))
        if i < len(codes):
            initial, fault = codes[i] & 3, codes[i] >> 2
            for s, (c, a) in reach[i].items():
                steps = [(2, "D", s)]
                if fault not in (1, 2):
                    paid = 5 * (fault == 3)
                    steps += [(paid, "K", fits[x]) for x in [(s, initial)] if x in fits] + [(paid + 1, "R", 3 if s == 2 else 2)]
                for d, letter, to in steps:
                    reach[i + 1][to] = min(reach[i + 1].get(to, (10**9, "")), (c + d, a + letter))
    best = min(v for s, v in reach[-1].items() if s in (0, 3))
    assert cost == best[0] and letters.decode() == best[1]


def test_repair_of_a_hot_conversation_uses_many_tasks(shared):
    rows = random_turns(3000, 7, 1) + [(2, 0, "user", "Hello.")] * 2000 + [(k, t, r, "So.") for k in range(3, 40) for t, r in enumerate(["user", "assistant"])]
    frame = shared.createDataFrame(rows, CONVERSATIONS)
    cut = stored(turn_repair._segments(turn_repair._coded(turn_repair.damaged(frame)), 128), "segments")
    assert cut.where("conv_id = 1 and codes is not null").select("part").distinct().count() > 1
    assert cut.where("codes is not null").agg(F.max(F.length("codes"))).first()[0] <= 128
    assert repairs(turn_repair.repair(frame, 128)) == plain_repairs(rows)


def test_repair_of_an_empty_table(shared):
    assert turn_repair.repair(shared.createDataFrame([], CONVERSATIONS)).collect() == []


# hard negatives


def plain_negatives(rows, every=50, relabel=7, classes=10):
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % classes if i is not None and i % relabel == 0 else label))
    out = []
    last = 2**63
    for a, (i, v, label) in enumerate(held):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), last if j is None else j, b) for b, (j, w, _) in enumerate(held) if b != a)
        for s, p, b in [x for x in scored if held[x[2]][2] == label][:5]:
            fit = [(t, n) for t, n, c in scored if held[c][2] != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, None if p == last else p, k + 1, None if n == last else n, -s, -t) for k, (t, n) in enumerate(fit)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def negatives(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_negatives_equal_sql(shared):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
        want = con.execute(f"SELECT {names} FROM ({queries.ORACLE['op13_voronoi_negatives']})").fetchall()
        assert negatives(queries.QUERIES["op13_voronoi_negatives"](shared, sf)) == Counter(want) and want


@pytest.mark.parametrize("seed,block,group", [(1, 1024, 16384), (2, 7, 5), (3, 1, 1)])
def test_negatives_of_clustered_and_awkward_vectors(shared, monkeypatch, seed, block, group):
    """Clusters, ties, copies, nulls, unequal widths; small blocks and groups, so that everything is dealt and merged."""
    monkeypatch.setattr(voronoi_negatives, "BLOCK", block)
    monkeypatch.setattr(voronoi_negatives, "GROUP", group)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(scale=0.3 if i % 4 else 2, size=8))], i % 6 // 2) for i in range(330)]
    rows += [(50, rows[0][1], 0), (50, rows[0][1], 0), (None, rows[1][1], 0), (None, rows[2][1], 1), (400, None, 1), (401, [1.0, None], 1), (402, [float("nan")] * 8, 0), (403, rows[3][1], None), (450, [], 1), (500, [0.5], 2), (503, [0.25, 0.5], 0), (504, [float("inf")] * 8, 0)]
    rows += [(k, [1.0] * 8, 4) for k in range(600, 690)]
    frame = shared.createDataFrame([(*r, 1, "z") for r in rows], VECTORS + ", row int, cell string").repartition(4)
    got, want = negatives(voronoi_negatives.hard_negatives(frame)), plain_negatives(rows)
    assert got == want and sum(want.values()) > 20


def test_cells_prune_candidates(shared):
    """Far clusters: a cell gets fewer candidates than there are rows, and results stay whole."""
    rng = np.random.default_rng(4)
    centres = np.eye(12) * 6
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(scale=0.05, size=12))], i % 12 // 2) for i in range(1200)]
    frame = shared.createDataFrame(rows, VECTORS)
    base, form = voronoi_negatives._prepared(frame, 7, 10)
    placed = stored(voronoi_negatives._in_cells(base.where("vec_id % 50 = 0"), form), "anchors")
    radius, bound = voronoi_negatives._positive_bounds(base, placed, form)
    sent = 0
    for r in base.select("label", "vec").collect():
        d = form.distances(np.frombuffer(r.vec, form.stored)[None, :])
        sent += int((d - radius[:, [r.label % voronoi_negatives.BUCKETS]].T <= bound[:, [r.label % voronoi_negatives.BUCKETS]].T + form.slack).sum())
    assert sent < 0.35 * len(rows) * len(form.pivots)
    assert negatives(voronoi_negatives.hard_negatives(frame)) == plain_negatives(rows)


def test_negatives_of_an_empty_table(shared):
    assert voronoi_negatives.hard_negatives(shared.createDataFrame([], VECTORS)).collect() == []
    assert voronoi_negatives.hard_negatives(shared.createDataFrame([(1, None, 1), (50, [1.0], None)], VECTORS)).collect() == []
