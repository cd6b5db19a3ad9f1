"""Each operator against a plain program of the same contract, on awkward rows and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrerix.llm import components, labels, multiset_hash, phrase_index, pseudo_likelihood, rule_ensemble, simhash_trie, suffix_radix, token_files, tokens, toxicity, vector_packing, weak_pii

from .conftest import prose


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# tokens, files and packing


def plain_ids(text):
    from tokenizers import Tokenizer

    global _full
    try:
        full = _full
    except NameError:
        full = _full = Tokenizer.from_file(tokens.word_bpe_path())
    return full.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ éÀßØ×÷ \n\t'sldr.,!?-#5\x1c\x85  İ́<|>北"), st.characters(codec="utf-8")), max_size=60))
def test_memo_gives_the_librarys_ids(text):
    got = np.frombuffer(tokens.encoder(tokens.word_bpe_path()).encode(text), "<u4").tolist()
    assert got == plain_ids(text)


@pytest.mark.parametrize("text", ["Don't STOP  now\n12 x", "É ñ 北京", "", "  ", "<|endoftext|>"])
def test_any_other_tokenizer_is_asked_itself(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = tokens.encoder(path)
    assert not other.known and tokens.encoder(tokens.word_bpe_path()).known
    assert np.frombuffer(other.encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_store_of_an_address():
    assert token_files._store("file:///tmp/x")[1] == "/tmp/x"
    for scheme in ("s3a", "s3"):
        try:
            assert token_files._store(f"{scheme}://bucket/x")[1] == "bucket/x"
        except (OSError, NotImplementedError) as e:  # no network to ask for the bucket's region
            assert "scheme" not in str(e)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(awkward, nothing):
    order = sorted(texts_of(awkward), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in order:
        ids = [*plain_ids(t), 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in token_files.round_trip(awkward).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.round_trip(nothing).count() == 0


def test_file_gives_sequences_without_a_copy(tmp_path):
    writer = token_files.ShardWriter(f"file://{tmp_path}", 0, 0, 49_408, sequence=8)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 49_408, int(n)).astype("<u4") for n in rng.integers(0, 50, 60)]
    for i, d in enumerate(docs):
        writer.add(i, d.tobytes())
    reader = token_files.ShardReader(f"file://{tmp_path}", *writer.close())
    flat = np.concatenate(docs)
    for i in range(-(-len(flat) // 8)):
        ids, mask = reader.sequence(i)
        assert ids[mask.view(bool)].tolist() == flat[8 * i : 8 * i + 8].tolist() and len(ids) == 8
    assert not any(x.flags.owndata or x.flags.writeable for x in reader.sequence(0)) and pa.types.is_fixed_size_list(reader.tokens.schema.field("ids").type)
    assert [r[1:] for r in reader.documents()] == [(sum(map(len, docs[:k])), len(d)) for k, d in enumerate(docs)]


def test_token_folder_has_one_write_and_keeps_what_others_put_there(shared, tmp_path):
    folder = f"file://{tmp_path}/t"
    docs = shared.createDataFrame([(i, prose(20, i)) for i in range(40)], "doc_id long, text string").repartition(4)
    (tmp_path / "t").mkdir()
    foreign = [tmp_path / "t" / n for n in (".keepme", ".part-notes.txt", "part-0000000-other.tokens.arrow", "readme")]
    for f in foreign:
        f.write_text("mine")
    with pytest.raises(FileNotFoundError, match="manifest.json"):
        token_files.open_token_files(shared, folder)
    made = token_files.write_token_files(docs, folder)
    first = set(tmp_path.glob("t/part-*.arrow"))
    assert made.count() > 1 and sorted(made.collect()) == sorted(token_files.open_token_files(shared, folder).collect())
    with pytest.raises(FileExistsError, match="manifest.json"):
        token_files.write_token_files(docs.limit(1), folder)
    assert token_files.read_token_files(token_files.open_token_files(shared, folder), folder).count() == 40
    token_files.write_token_files(docs.limit(1), folder, replace=True)
    now = set(tmp_path.glob("t/*")) - set(foreign)
    assert len(now) == 4 and not now & first and all(f.read_text() == "mine" for f in foreign)
    assert token_files.read_token_files(token_files.open_token_files(shared, folder), folder).count() == 1


def check_pieces(rows, want):
    """rows of (doc, start, length, crc, doc_tokens, sequence, offset); want: Counter of id tuples."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r[6]):
            assert r[6] == at and r[2] > 0
            at += r[2]
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)  # no padding
    assert sum(r[2] for r in rows) == sum(len(k) * n for k, n in want.items())


def test_packing_documents(awkward, nothing):
    want = Counter(tuple([*plain_ids(t), 2]) for _, t in texts_of(awkward))
    rows = vector_packing.pack_documents(awkward, with_ids=True).collect()
    check_pieces([tuple(r) for r in rows], want)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    one = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 7)
    assert np.frombuffer(b"".join(b for _, b in one), "<u4").tolist() == [*plain_ids(dict(texts_of(awkward))[7]), 2]
    assert vector_packing.pack_documents(nothing).count() == 0


def test_packer_keeps_all_limits():
    rng, limits = random.Random(5), vector_packing.Limits(100, 4, 60)
    items = [(n := rng.randint(1, 60), rng.choice([0, min(n, 30)])) for _ in range(500)]
    packer = vector_packing.Packer(limits, cut=False)
    out = [p for i, (n, m) in enumerate(items) for p in packer.add(vector_packing.Piece(i, 0, n, m))] + list(packer.flush())
    assert sorted(p.key for p in out) == list(range(500))
    by = defaultdict(list)
    for p in out:
        by[p.sequence].append(p)
    assert all(sum(p.length for p in s) <= 100 and len(s) <= 4 and sum(p.loss for p in s) <= 60 for s in by.values())
    assert len(by) <= 1.25 * max(sum(n for n, _ in items) / 100, 125, sum(m for _, m in items) / 60)
    with pytest.raises(ValueError, match="fits no sequence"):
        list(packer.add(vector_packing.Piece(0, 0, 101, 0)))


@pytest.mark.parametrize(("name", "kind", "keys"), [("id", "int", range(40)), ("sequence_id", "string", [None, "a"] * 20), ("offset", "double", [0.5] * 40), ("n_tokens key", "array<int>", [[1], None] * 20), ("key", "struct<a: int>", [(i,) for i in range(40)])])
def test_keys_of_any_type_and_name(shared, name, kind, keys):
    df = shared.createDataFrame([(k, 3 + i % 9, i % 3) for i, k in enumerate(keys)], f"`{name}` {kind}, `the tokens` int, `with loss` int").repartition(2)
    got = vector_packing.pack_examples(df, name, "the tokens", "with loss", vector_packing.Limits(32, 5, 6))
    assert got.columns == ["key" if name in ("sequence_id", "offset") else name, "sequence_id", "offset", "n_tokens", "n_loss"] and got.schema[0].dataType == df.schema[0].dataType
    rows = [tuple(r) for r in got.collect()]
    assert Counter(repr((r[0], r[3], r[4])) for r in rows) == Counter(repr(tuple(r)) for r in df.collect())
    assert vector_packing.pack_examples(df.limit(0), name, "the tokens", "with loss").count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    for own in by.values():
        own.sort(key=lambda r: r[2])
        assert [r[2] for r in own] == [sum(x[3] for x in own[:k]) for k in range(len(own))]
        assert sum(r[3] for r in own) <= 32 and len(own) <= 5 and sum(r[4] for r in own) <= 6


def test_conversations_with_a_loss_mask(shared, nothing):
    rng = random.Random(6)
    turns = [(c, t, role, prose(rng.randint(0, 30), 10 * c + t)) for c in range(30) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"][: rng.randint(1, 5)])]
    turns += [(50, 0, "user", prose(400, 1)), (50, 1, "assistant", prose(300, 2)), (50, 1, "assistant", prose(300, 2)), (51, 0, None, None), (None, 0, "assistant", "hi"), (None, 1, "user", "ho"), (52, None, "assistant", "")]
    df = shared.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, piece string").repartition(3)
    limits = vector_packing.Limits(300, 4, 150)
    want, by = Counter(), defaultdict(list)
    for c, t, role, text in turns:
        n = len(plain_ids(text or "")) + 1
        by[c].append((t, n, n if role == "assistant" else 0))
    for c, own in by.items():
        n, m = sum(x[1] for x in own), sum(x[2] for x in own)
        c = None if c is None else str(c)
        if n <= 300 and m <= 150:
            want[c, None, 0, n, m] += 1
        else:
            for t, n, m in own:
                cap = 150 if m else 300
                for k in range(-(-n // cap)):
                    part = min(cap, n - k * cap)
                    want[c, t, k, part, part if m else 0] += 1
    got = [tuple(r) for r in vector_packing.pack_conversations(df, limits).collect()]
    assert Counter((*r[:3], *r[5:]) for r in got) == want
    per = defaultdict(list)
    for r in got:
        per[r[3]].append(r)
    assert all(sum(r[5] for r in s) <= 300 and len(s) <= 4 and sum(r[6] for r in s) <= 150 for s in per.values())
    assert vector_packing.pack_conversations(df.limit(0)).count() == 0


def test_packing_conversations(shared):
    df = shared.createDataFrame([(f"c{i}", 10 + i % 7, i % 5) for i in range(60)], "conv string, n_tokens long, n_loss long").repartition(2)
    got = vector_packing.pack_examples(df, "conv", limits=vector_packing.Limits(64, 3, 8)).toPandas()
    per = got.groupby("sequence_id").agg(n=("n_tokens", "sum"), k=("conv", "count"), m=("n_loss", "sum"))
    assert len(got) == 60 and (per.n <= 64).all() and (per.k <= 3).all() and (per.m <= 8).all()


# near duplicates


def plain_simhash(text, k):
    ws = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abZ É \n\t\x0b", max_size=40), st.integers(1, 5))
def test_fingerprint(text, k):
    assert simhash_trie.fingerprint(text, k) == plain_simhash(text, k)


def test_fingerprint_of_a_long_text():
    assert simhash_trie.fingerprint(prose(2000, 9)) == plain_simhash(prose(2000, 9), 4)


def reach(codes, budget):
    label = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= budget
    while True:
        new = np.where(near, label[None, :], len(codes)).min(axis=1)
        if (new == label).all():
            return label
        label = new


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6), st.integers(2, 20))
def test_trie_join_equals_all_pairs(seed, budget, spread):
    rng = np.random.default_rng(seed)
    bits = rng.permutation(64)[:spread]
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    codes = np.unique([rng.choice(base) ^ np.uint64(sum(1 << int(b) for b in bits[rng.random(spread) < 0.3])) for _ in range(200)])
    label = np.arange(len(codes))
    for a, b in simhash_trie.trie_links(codes, budget):
        assert np.bitwise_count(codes[a] ^ codes[b]) <= budget
        label[label == label[max(a, b)]] = label[min(a, b)]
    assert len({(x, y) for x, y in zip(label, reach(codes, budget), strict=True)}) == len(set(label)) == len(set(reach(codes, budget)))


def test_near_duplicates(awkward, nothing):
    rows = texts_of(awkward)
    codes = np.array([plain_simhash(t, 4) for _, t in rows], np.uint64)
    label = reach(codes, 4)
    least = {c: min((i for (i, _), x in zip(rows, label, strict=True) if x == c and i is not None), default=None) for c in set(label)}
    want = sorted(((i, f"{c:016x}", least[x]) for (i, _), c, x in zip(rows, codes, label, strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash_trie.near_duplicates(awkward).collect()), key=repr) == want
    assert simhash_trie.near_duplicates(nothing).count() == 0


def shingles(text, k):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def similar_classes(rows, k=5, least=0.8):
    """Label of each row by overlap of shingles, and the overlaps."""
    sets = [shingles(t, k) for _, t in rows]
    near = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    label = np.arange(len(rows))
    while True:
        new = np.where(near >= least, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            return label, near
        label = new


def test_representatives(awkward, nothing):
    rows = sorted(texts_of(awkward), key=lambda r: (r[0] is None, r[0] or 0))
    label, _ = similar_classes(rows)
    want = sorted((rows[x][0] for x in set(label)), key=repr)
    kept = simhash_trie.representatives(awkward)
    assert kept.columns == awkward.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert simhash_trie.representatives(nothing).count() == 0


def test_similar_texts_in_a_large_group(shared):
    base = prose(300, 1).replace(",", "").replace(".", "").split()
    rng, texts = random.Random(4), []
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(300), 4):
            own[at] = f"changed{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(base), *(prose(300, 50 + i) for i in range(30))]
    df = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash_trie.representatives(df).collect()) == [0, *range(151, 181)]


def test_similar_texts_with_edited_blocks(shared):
    """Copies with a stretch replaced, appended or cut, whose overlap stays 0.8."""
    rng, texts = random.Random(8), []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        new = [f"x{rng.randrange(10**6)}" for _ in range(40)]
        at = rng.randrange(150)
        texts += [" ".join(base), " ".join((base[:at] + new[:16] + base[at + 16 :], base + new, base[:165], base[35:])[i % 4])]
    rows = list(enumerate(texts))
    label, _ = similar_classes(rows)
    df = shared.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash_trie.representatives(df).collect()) == sorted(set(label.tolist())) and len(set(label)) == 60


def test_links_of_members_whose_head_is_too_far(shared):
    """Texts around one that most are too far from: similar to each other, though not to what their fingerprints lie nearest to."""
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = [f"word{rng.randrange(40)}" for _ in range(120)]
        for _ in range(4):
            own = list(base)
            for at in rng.sample(range(120), 3):
                own[at] = f"other{rng.randrange(10**6)}"
            texts.append(" ".join(own))
            for _ in range(3):
                near = list(own)
                near[rng.randrange(120)] = f"other{rng.randrange(10**6)}"
                near[rng.randrange(120)] = f"other{rng.randrange(10**6)}"
                texts.append(" ".join(near))
    rows = list(enumerate(texts))
    label, _ = similar_classes(rows)
    df = shared.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash_trie.representatives(df).collect()) == sorted(set(label.tolist()))


def test_rows_alike_in_id_and_text_and_names_that_clash(shared):
    text = prose(50, 9)
    rows = [(1, text, "x", 5, "b"), (1, text, "x", 5, "a"), (1, text, "x", 5, "a"), (2, text, "y", 6, "c")]
    df = shared.createDataFrame(rows, "doc_id long, text string, `kept id` string, `text key 1` long, place string")
    for parts in (1, 4):
        (kept,) = simhash_trie.representatives(df.repartition(parts)).collect()
        assert tuple(kept) == rows[1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40 - 1), st.integers(0, 50), st.integers(0, 50), st.integers(1, 10**6), st.integers(0, 10**5)), min_size=1, max_size=60))
def test_entries_survive_packing(rows):
    e = np.array(rows, simhash_trie._ENTRY)
    assert np.array_equal(simhash_trie._unpack(simhash_trie._pack(e)), e)


def test_components_of_a_chain_a_star_and_loops(shared):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = dict(components.components(shared.createDataFrame(links, "x long, y long"), "x", "y").collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(shared.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# fingerprints


def test_multiset_hash_is_a_homomorphism():
    h = multiset_hash.MultisetHash.of
    a, b = "one two three\nfour five six seven", "eight\nnine ten"
    assert h(a) + h(b) == h(a + "\n" + b) == h(b + "\n" + a) and str(h(a) + h(b)) == str(h(b + "\n" + a))
    assert h(a + "\n" + b) - h(b) == h(a) and h(a) != h(b) and h("x\nx") != h("x") and h("") != h("\n")
    assert multiset_hash.MultisetHash.parse(str(h(a))) == h(a)
    long, half = prose(400, 1), prose(200, 2)
    assert h(long).likeness(h(long)) == 1 and h(long).likeness(h(prose(400, 8))) < 0.35
    assert 0.3 < h(long + "\n" + half).likeness(h(long)) < 1


def runs_of(text):
    """Runs of three words within a line, a shorter line as one, with their numbers."""
    out = Counter()
    for line in text.split("\n"):
        ws = line.split()
        for i in range(max(0, len(ws) - 2)):
            out[tuple(ws[i : i + 3])] += 1
        if 0 < len(ws) < 3:
            out[tuple(sorted(ws)), len(ws)] += 1
    return out


def exact_likeness(a, b):
    """What the sketches estimate, from exact counts: 1 less the squared distance over the squared lengths."""
    x, y = runs_of(a), runs_of(b)
    both = sum(n * n for n in x.values()) + sum(n * n for n in y.values())
    return max(0.0, 1 - sum((x[k] - y[k]) ** 2 for k in x.keys() | y.keys()) / both) if both else float(sorted(a.split("\n")) == sorted(b.split("\n")))


@pytest.mark.parametrize("n", [10, 6_553, 40_000, 65_536, 131_072])
def test_likeness_of_very_long_repetitive_texts(n):
    text = "\n".join(["one two three"] * n)
    h = multiset_hash.MultisetHash.of
    for other in (text + "\nfour five six", text + "\n" + text, prose(300, 3)):
        assert abs(h(text).likeness(h(other)) - exact_likeness(text, other)) < 0.02


def signed_hash(text):
    return int(np.array(xxhash.xxh64_intdigest(text.encode(), 42), np.uint64).view(np.int64))


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_rows_of_one_id_are_dealt_to_several_tasks(shared, partitions):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, f"text {i} " + prose(5, i)) for i in range(120)]
    df = shared.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = shared.conf.get("spark.sql.shuffle.partitions")
    shared.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        dealt = multiset_hash.with_next(df)
        sizes = [r.n for r in dealt.where("ahead = 0").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        got = sorted(map(tuple, multiset_hash.against_next(df).select("doc_id", "edited_sha256").collect()), key=repr)
    finally:
        shared.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 120 and max(sizes) <= max(12, 2 * 120 // partitions)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1]), r[1]))
    edited = [(i, t[: len(t) - len(t) // 2] + order[(k + 1) % 120][1][: len(t) // 2]) for k, (i, t) in enumerate(order)]
    assert got == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in edited), key=repr)


def test_edited_texts(awkward, nothing):
    rows = sorted(texts_of(awkward), key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1]), r[1]))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(multiset_hash.MultisetHash.of(t)), str(multiset_hash.MultisetHash.of(edited)))] += 1
    got = multiset_hash.against_next(awkward).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    likeness = sorted((i is None, -(i or 0), near_edited, near_next) for i, near_edited, near_next in ((r.doc_id, r.near_edited, r.near_next) for r in got))
    exact = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        exact.append((i is None, -(i or 0), exact_likeness(t, t[: len(t) - len(t) // 2] + after[: len(t) // 2]), exact_likeness(t, after)))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.2 and abs(a[3] - b[3]) < 0.2 for a, b in zip(likeness, sorted(exact), strict=True))
    assert multiset_hash.against_next(nothing).count() == 0
    assert multiset_hash.against_next(awkward.where("doc_id = 3")).first().near_next == 1.0
    assert multiset_hash.fingerprint(awkward).count() == len(rows)


# repeated windows


def plain_repeats(rows, window=100):
    seen, out = set(), []
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - window + 1):
            piece = raw[s : s + window]
            if piece in seen:
                gone[s : s + window] = True
            seen.add(piece)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), int((np.diff([0, *gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_windows(awkward, nothing):
    order = sorted(texts_of(awkward), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = suffix_radix.without_repeats(awkward, with_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(plain_repeats(order))
    assert all(len(r.kept) == r.n_bytes - r.n_removed and len(r.runs) == r.n_spans for r in got)
    assert suffix_radix.without_repeats(nothing).count() == 0


def crowded():
    rng = random.Random(3)
    shared_line = prose(40, 7)
    texts = [prose(rng.randint(0, 25), 100 + i) + " " + shared_line[rng.randint(0, 50) :] + prose(rng.randint(0, 25), 500 + i) for i in range(120)]
    return [*texts, texts[3][:200] + "X" + texts[3][200:], texts[4] * 3, "ab" * 400, "ab" * 300]


def test_repeated_windows_with_hot_grams(shared):
    rows = list(enumerate(crowded()))
    got = suffix_radix.without_repeats(shared.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_repeats(rows))


@pytest.mark.parametrize(("flush", "hot", "chunk"), [(1 << 20, 256, 1 << 19), (40, 2, 1 << 19), (300, 3, 150), (1 << 20, 1, 101)])
def test_repeated_windows_with_small_flushes_and_chunks(monkeypatch, flush, hot, chunk):
    """The steps of the sort one after another in this process, where the limits can be made small."""
    for name, value in (("FLUSH", flush), ("HOT", hot), ("CHUNK", chunk)):
        monkeypatch.setattr(suffix_radix, name, value)
    rows, buckets, tasks = list(enumerate(crowded())), 3, 4
    place = lambda r: r["part"] if r["part"] is not None else (r["key"] + r["start"]) % buckets

    def exchanged(made):
        by = defaultdict(list)
        for batch in made:
            for r in batch.to_pylist():
                by[place(r)].append(r)
        schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("packed", pa.binary())])
        return [iter([pa.RecordBatch.from_pylist(own, schema)]) for own in by.values()]

    def batch(own):
        return iter([pa.record_batch([pa.array([i for i, _ in own], pa.int64()), pa.array([t for _, t in own])], names=["key", "text"])])

    first = [b for k in range(tasks) for b in suffix_radix._deal(buckets)(batch(rows[k::tasks]))]
    settled = [r for part in exchanged(first) for b in suffix_radix._sort_buckets(part) for r in b.to_pylist()]
    open_ = defaultdict(list)
    for r in settled:
        if r["kind"] == 1:
            open_[r["key"]].append({"start": r["start"], "stop": r["stop"]})
    z = zstandard.ZstdCompressor()
    deep = pa.record_batch([pa.array(list(open_), pa.int64()), pa.array([z.compress(rows[k][1].encode()) for k in open_], pa.binary()), pa.array(list(open_.values()))], names=["key", "packed", "spans"])
    second = list(suffix_radix._deal_windows(buckets)(iter([deep] if open_ else [])))
    again = [r for part in exchanged(second) for b in suffix_radix._sort_windows(part) for r in b.to_pylist()]
    spans = defaultdict(list)
    for r in [r for r in settled if r["kind"] == 0] + again:
        spans[r["key"]].append({"start": r["start"], "stop": r["stop"]})
    for (i, n_bytes, n_removed, n_spans, _), (_, t) in zip(plain_repeats(rows), rows, strict=True):
        runs = suffix_radix._merge(spans[i])
        assert (len(t.encode()), sum(b - a for a, b in runs), len(runs)) == (n_bytes, n_removed, n_spans)


# decontamination


def plain_contamination(rows, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = []
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[s : s + 13])].add(item)
    sizes = {len(k) for k in windows}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(shared, awkward, nothing):
    rows = texts_of(awkward)
    base = dict(rows)[1]
    items = [(1, " ".join(base.split()[5:40])), (2, "ONE"), (2, "北京"), (3, ""), (4, None), (None, " ".join(base.split()[50:70])), (5, "nowhere to be found at all"), (6, "a" * 5000), (10, " ".join(base.split()[20:33]))]
    bench = shared.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    got = phrase_index.contamination(awkward, bench).drop("text_key").collect()
    assert Counter(map(tuple, got)) == Counter(plain_contamination(rows, items))
    assert phrase_index.contamination(nothing, bench).count() == 0
    assert phrase_index.contamination(awkward, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = phrase_index.clean(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == sum(not r[5] for r in plain_contamination(rows, items))


def test_a_rare_terms_list_is_read_without_the_others(shared, monkeypatch):
    """Segments sorted by term: the reader skips row groups and pages that statistics rule out."""
    monkeypatch.setattr(phrase_index, "ROW_GROUP", 1 << 16)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join([*rng.choices(words, k=900), "needle" if i == 77 else "hay", *rng.choices(words, k=100)])) for i in range(400)]
    index = phrase_index.Index(shared.createDataFrame(rows, "doc_id long, text string").repartition(2))
    found = index.lists(["needle"])
    assert [(r.pos, r.term) for r in found.collect()] == [(900, "needle")]
    read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 0 < read < 0.2 * 400 * 1001
    segments = [r[0] for r in index.table.select(F.input_file_name()).distinct().collect()]
    for s in segments:
        terms = [r.term for r in shared.read.parquet(s).select("term").coalesce(1).collect()]
        assert terms == sorted(terms, key=lambda t: (t is not None, t or ""))
    assert dict(map(tuple, index.dictionary.where("term in ('needle', 'hay')").collect())) == {"needle": 1, "hay": 399}
    with pytest.raises(ValueError, match="at most 10"):
        index.lists(words[:11])
    long = phrase_index.item_terms(shared.createDataFrame([(1, "x" * 3000), (2, "y z")], "item_id long, text string"))
    monkeypatch.setattr(phrase_index, "BROADCAST_BYTES", 1000)
    assert phrase_index._side(long)._jdf.queryExecution().logical().toString().count("broadcast") == 0
    assert phrase_index._side(long.where("item_id = 2"))._jdf.queryExecution().logical().toString().count("broadcast") == 1


def test_contamination_without_broadcast(shared, awkward, monkeypatch):
    monkeypatch.setattr(phrase_index, "BROADCAST_ROWS", 0)
    rows = texts_of(awkward)
    items = [(1, " ".join(dict(rows)[1].split()[5:40]))]
    got = phrase_index.contamination(awkward, shared.createDataFrame(items, "item_id long, text string")).drop("text_key").collect()
    assert Counter(map(tuple, got)) == Counter(plain_contamination(rows, items))


def test_phrases_and_proximity(shared):
    docs = shared.createDataFrame([(1, "x the quick brown fox y"), (2, "brown the fox is quick"), (3, "quick z z z z z z brown fox the"), (4, None)], "doc_id long, text string")
    terms = phrase_index.item_terms(shared.createDataFrame([(7, "the quick brown fox")], "item_id long, text string"))
    index = phrase_index.Index(docs, terms)
    assert [tuple(r) for r in index.phrases(terms).collect()] == [(1, "7", 1, 4)]
    assert {r.doc_id for r in index.near(terms, 0).collect()} == {1}
    assert {(r.doc_id, r.start, r.stop) for r in index.near(terms, 1).collect()} == {(1, 1, 5), (2, 0, 5)}
    assert {r.doc_id for r in index.near(terms, 6).collect()} == {1, 2, 3}


def plain_words(t):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def plain_near(rows, items, slack):
    docs = [(i, plain_words(t)) for i, t in rows]
    many, out = Counter(w for _, ws in docs for w in ws), Counter()
    for item, t in items:
        ws = plain_words(t)
        if not ws:
            continue
        terms, span = set(ws), len(ws) + slack
        rare = min(terms, key=lambda w: (many[w], w))
        for i, own in docs:
            for anchor in (p for p, w in enumerate(own) if w == rare):
                places = [p for p in range(max(0, anchor - span + 1), min(len(own), anchor + span)) if own[p] in terms]
                starts = [p for p in places if p <= anchor < p + span and {own[q] for q in places if p <= q < p + span} == terms]
                if starts:
                    out[i, str(item) if item is not None else None, max(starts), max(q for q in places if q < max(starts) + span) + 1] += 1
    return out


def test_one_index_of_all_terms_serves_every_test_set(shared, awkward, nothing):
    rows = texts_of(awkward)
    index = phrase_index.Index(awkward)
    for seed in (1, 2):
        rng = random.Random(seed)
        items = [(k, " ".join(rng.sample(plain_words(prose(30, 1)), 3))) for k in range(6)] + [(7, "one"), (None, "alpha beta"), (8, ""), (9, None), (9, "北京")]
        terms = phrase_index.item_terms(shared.createDataFrame(items, "item_id long, text string"))
        own = phrase_index.Index(awkward, terms)
        for slack in (0, 4):
            got = [Counter(map(tuple, x.near(terms, slack).collect())) for x in (index, own)]
            assert got[0] == got[1] == plain_near(rows, items, slack) and got[0]
        assert Counter(map(tuple, index.phrases(terms, 2).collect())) == Counter(map(tuple, own.phrases(terms, 2).collect()))
        index.release()
    assert phrase_index.proximity(nothing, awkward.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert phrase_index.Index(nothing).phrases(terms).count() == 0 and index.phrases(phrase_index.item_terms(nothing, "doc_id")).count() == 0


def test_no_text_goes_on_with_the_words(awkward, shared, monkeypatch):
    plans, kept, limit = [], phrase_index.stored, shared.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(phrase_index, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(phrase_index, "stored", lambda df, *how: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *how))
    terms = phrase_index.item_terms(shared.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    shared.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    phrase_index.Index(awkward, terms)
    shared.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    made = [x for p in plans[1:] for x in p.split("\n") if "Generate" in x]
    assert made and not any(re.search(r"\btext#", x) for x in made) and "Exchange" in plans[-1] and "Broadcast" not in plans[-1]


def test_decontamination_keeps_columns_of_any_name(shared):
    text = prose(40, 1)
    df = shared.createDataFrame([(1, text, "a", "b"), (1, text + " more", "c", "d"), (2, "clean", "e", "f")], "doc_id long, text string, bad_id string, `row` string")
    kept = phrase_index.clean(df, shared.createDataFrame([(5, " ".join(text.split()[3:20]))], "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "clean", "e", "f")] and kept.columns == df.columns


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aB.@+-_%013459 ()x\n", max_size=60))
def test_base_spans(text):
    assert sorted((a, weak_pii.KINDS.index(k), b, k) for k, a, b in weak_pii.base_spans(text)) == plain_spans(text)


def hexes(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("0123456789abcdef") for _ in range(39)) + "a" for _ in range(n)]


def numbers(n, good, seed):
    rng, out = random.Random(seed), []
    while len(out) < n:
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if weak_pii.luhn(digits) == good:
            out.append(digits)
    return out


#: what stays, what is found; for each a list of (text, is the candidate a span)
CANDIDATES = {
    "secret key": [(f"the secret key {h} of it", True) for h in hexes(12, 1)],
    "commit": [(f"see commit {h} there", False) for h in hexes(12, 2)],
    "named": [(f'token = "{h}" and', True) for h in hexes(12, 3)],
    "version": [(f"version {n} of it", False) for n in numbers(12, False, 4)],
    "country": [("at +1 (826) 555-4081 190.137.223.20 now", True)] * 4,
}
BASE = ["write to a.b@c.example.com or +1 (213) 555-2678, 4111 1111 1111 1111 from 10.1.2.3", "call +44 20 7946 0958 or mail x@y.org", "1.2.3.4 is a host", "card 5500000000000004"] * 15


def test_the_classifier_decides_on_candidates(shared):
    texts = [(t, None) for t in BASE] + [x for own in CANDIDATES.values() for x in own] + [("clean 12 text", None), (None, None)]
    df = shared.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in weak_pii.personal_data(df).collect()}
    model = weak_pii.fit(weak_pii.find_spans(df))
    for i, (t, is_span) in enumerate(texts):
        base = plain_spans(t or "")
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        # a plain program of the added spans: what the classifier gives half or more, wherever it is
        added = [(s["start"], s["kind"], s["end"], weak_pii.KINDS[s["kind"]]) for s in weak_pii.spans_of(t or "") if not s["base"] and model[s["pattern"]] >= 0.5]
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted([*base, *added])) and got[i].n_added == len(added)
        if is_span is not None:
            assert bool(added) == is_span, t
    # long hex strings with the same vote of the check end on both sides
    votes = lambda t: [s["pattern"].split(";")[1].split(",")[0] for s in weak_pii.spans_of(t) if s["end"] - s["start"] == 40]
    assert votes(CANDIDATES["secret key"][0][0]) == votes(CANDIDATES["commit"][0][0]) == ["0"]
    hidden = {r.doc_id: r.text for r in weak_pii.redacted(df).collect()}
    at = [i for i, (t, _) in enumerate(texts) if t == BASE[0]][0]
    assert hidden[at] == "write to [EMAIL] or [PHONE], [CARD] from [IP]" and hidden[len(texts) - 2] == "clean 12 text" and hidden[len(texts) - 1] is None
    assert all(("[SECRET]" in hidden[i]) == is_span for i, (t, is_span) in enumerate(texts) if is_span is not None and ("key" in t or "commit" in t))


def test_the_classifier_differs_from_the_votes_on_planted_noise():
    """Spans whose votes are wrong have the form and surroundings of the other side; the classifier follows these."""
    yes, no, right, wrong = "0,1,1,1,1", "0,0,-1,-1,-1", "5,2,0;2,1,1,9", "5,2,0;6,1,4,7"
    counted = {f"4;{yes};{right}": 300, f"4;{no};{wrong}": 300, f"4;{yes};{wrong}": 6, f"4;{no};{right}": 6}
    by = {p: (a >= 0.5, b >= 0.5) for p, (a, b) in weak_pii.judged(counted).items()}
    assert by == {f"4;{yes};{right}": (True, True), f"4;{no};{wrong}": (False, False), f"4;{yes};{wrong}": (True, False), f"4;{no};{right}": (False, True)}
    assert [p for p, v in weak_pii.classify(counted).items() if v >= 0.5] == [f"4;{yes};{right}"] and weak_pii.judged({}) == {}


def test_gazetteers():
    assert weak_pii._network("4111111111111111") and weak_pii._network("2720990000000007") and not weak_pii._network("2721000000000004") and not weak_pii._network("41111111111111")
    assert weak_pii._calling("4420") and weak_pii._calling("3531") and not weak_pii._calling("0123")
    assert [weak_pii._routed(x) for x in ("8.8.8.8", "10.0.0.1", "172.20.1.1", "192.168.0.9", "127.0.0.1", "239.1.1.1", "169.254.3.4", "0.0.0.0")] == [1, 0, 0, 0, -1, -1, -1, -1]


def test_redaction_scans_once_and_keeps_clashing_columns(shared, monkeypatch):
    df = shared.createDataFrame([(1, "write to a.b@c.example.com now", [7]), (2, None, None)], "doc_id long, text string, `spans of row` array<int>")
    assert sorted(map(tuple, weak_pii.redacted(df).collect())) == [(1, "write to [EMAIL] now", [7]), (2, None, None)]


def test_personal_data_of_awkward_rows(awkward, nothing):
    assert weak_pii.personal_data(nothing).count() == 0 and weak_pii.personal_data(awkward).count() == awkward.count()
    assert weak_pii.redacted(awkward).columns == awkward.columns and weak_pii.redacted(nothing).count() == 0


def test_reliabilities_recover_planted_ones():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.8, 0.7, 0.6])
    ballots = np.where(rng.random((len(truth), 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, counts = np.unique(ballots, axis=0, return_counts=True)
    found, tables, prior = weak_pii.reliabilities(patterns, counts.astype(float))
    assert np.all(np.diff(tables[:, 1, 2]) < 0) and abs(prior - 0.3) < 0.1
    of = {tuple(p): v for p, v in zip(patterns.tolist(), found, strict=True)}
    assert np.mean([(of[tuple(b)] > 0.5) == t for b, t in zip(ballots.tolist(), truth, strict=True)]) > 0.9


# classifiers and language model


def labelled(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        bad, low = rng.random() < 0.3, rng.random() < 0.3
        ws = prose(rng.randint(20, 80), seed * 1000 + i).split()
        if bad:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["grubscum", "vilefool", "nastyoaf"]))
        if low:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws), int(bad), int(not low)))
    return rows


@pytest.fixture(scope="module")
def corpus(shared):
    rows = labelled(600, 3)
    docs = shared.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = shared.createDataFrame([(i, q, t) for i, _, t, q in rows], "doc_id long, quality int, toxic int")
    return docs, marks, {r[0]: r for r in rows}


def accuracy(scored, truth, modulus, remainder, place):
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % modulus == remainder]
    return np.mean([r.predicted == truth[r.doc_id][place] for r in held])


def test_toxicity_on_held_out_rows(corpus, awkward, nothing):
    docs, marks, truth = corpus
    model = toxicity.fit(docs, marks)
    assert accuracy(toxicity.toxicity(docs, model).collect(), truth, 4, 2, 2) > 0.97
    got = toxicity.toxicity(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(nothing, model).count() == 0
    none = toxicity.fit(docs, marks.limit(0))
    assert toxicity.toxicity(docs.limit(1), none).first().predicted == 0


def test_toxicity_score_against_a_plain_program(corpus):
    docs, marks, _ = corpus
    model = toxicity.fit(docs, marks)
    assert len(model.ordinary) >= toxicity.ORDINARY_BYTES and model.toxic and list(model.steps) == sorted(set(model.steps))
    base, how = model.ordinary[-toxicity.ORDINARY_BYTES :], zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, chain_log=16, hash_log=15, search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    length = lambda raw, w: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w))
    texts = [r.text for r in docs.orderBy("doc_id").limit(15).collect()] + ["", "É grubscum", "ALPHA beta"]
    for t in texts:
        gains = []
        for w in t.encode().lower().split():
            window = base[toxicity.BEFORE] + b" " + w + b" " + base[toxicity.AFTER].strip() + b" "
            gains.append(length(model.ordinary, window) - length(model.toxic + model.ordinary, window))
        seen = sorted((g for g in gains if g >= model.steps[0]), reverse=True)
        x = [*seen[:3], 0, 0, 0][:3] + [math.log1p(sum(g >= k for g in gains)) for k in model.steps] + [math.log1p(len(gains))] if gains else [0] * toxicity.FEATURES
        z = sum(a * b for a, b in zip(model.weights, [*x, 1.0], strict=True))
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_steps_are_shares_of_ordinary_words():
    gains = Counter({0: 999_000, 1: 500, 2: 300, 3: 150, 4: 30, 5: 19, 9: 1})
    total, before = sum(gains.values()), 0
    for share, step in zip(toxicity.SHARES, toxicity.calibrated_steps(gains), strict=True):
        assert sum(n for g, n in gains.items() if g >= step) <= share * total and step > before
        assert step == before + 1 or sum(n for g, n in gains.items() if g >= step - 1) > share * total
        before = step
    assert toxicity.calibrated_steps(Counter()) == (1, 2, 3, 4)


@pytest.mark.parametrize(("folder", "auc", "recall"), [("sf0.01", 0.75, 0.6), ("sf0.1", 0.95, 0.75)])
def test_toxicity_of_whole_tables_on_held_out_rows(folder, auc, recall):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '/root/testdata/{folder}/documents.parquet' JOIN '/root/testdata/{folder}/labels.parquet' USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL ORDER BY doc_id").fetchall()
    fold = lambda r: zlib.crc32(str(r[0]).encode()) % 4 == 2
    model = toxicity.train([(t, y) for _, t, y in (r for r in rows if not fold(r))])
    held = [(model.score(t), y) for _, t, y in filter(fold, rows)]
    bad, good = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) >= auc
    assert np.mean([b >= 0.3 for b in bad]) >= recall and np.mean([g < 0.3 for g in good]) >= 0.95


def test_quality_on_held_out_rows(corpus, awkward, nothing):
    docs, marks, truth = corpus
    model = rule_ensemble.fit(docs, marks)
    scored = rule_ensemble.with_quality(docs, model).collect()
    assert accuracy(scored, truth, 3, 1, 3) > 0.97
    x = np.array([rule_ensemble.statistics(r.text) for r in scored])
    z = model.intercept + sum((w * rule.holds(x) for rule, w in zip(model.rules, model.weights, strict=True)), np.zeros(len(x)))
    assert np.allclose(1 / (1 + np.exp(-z)), [r.score for r in scored])
    got = rule_ensemble.with_quality(awkward, model)
    assert got.count() == awkward.count() and set(got.columns) == set(awkward.columns)
    assert rule_ensemble.with_quality(nothing, model).count() == 0
    assert rule_ensemble.with_quality(docs.limit(1), rule_ensemble.train([])).first().predicted == 1


def test_training_rows_are_the_first_by_hash(shared):
    n, most = 5000, 50
    docs = shared.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    order = [r.doc_id for r in docs.where(labels.remainder("doc_id", 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    assert labels.training_rows(docs, marks, "quality", 3, 1, most) == [(f"t{i}", i % 2) for i in sorted(order)]


def test_labels_stay_out_of_the_fold(corpus):
    docs, marks, _ = corpus
    kept = labels.training_rows(docs, marks, "toxic", 4, 2, 10_000)
    assert len(kept) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(600))
    assert len(labels.training_rows(docs, marks, "toxic", 4, 2, 50)) == 50


def test_pseudo_likelihood(shared, awkward, nothing):
    rng = random.Random(2)
    lines = ["a b c d e f g h".split(), "h g f e d c b a".split()]
    docs = shared.createDataFrame([(i, " ".join(" ".join(rng.choice(lines)) for _ in range(60))) for i in range(400)], "doc_id long, text string").repartition(4)
    model = pseudo_likelihood.fit(docs, rounds=2)
    (n, _), (good, bad) = pseudo_likelihood.score_texts(model, ["a b c d e f g h " * 5, "a a f h b b g c " * 5])
    assert n == 40 and good > bad + 20
    got = pseudo_likelihood.pseudo_likelihood(awkward, model).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(t.lower().split())) for i, t in texts_of(awkward))
    empty = [r for r in got if r.n_tokens == 0]
    assert empty and all(r.log_probability == 0 and r.score == 0 for r in empty) and all(math.isfinite(r.log_probability) for r in got)
    assert pseudo_likelihood.pseudo_likelihood(nothing, model).count() == 0
    assert pseudo_likelihood.fit(nothing).known == ()


def plain_spelling(model, rare, word):
    """Bucket and probability of a word in it, from plain counts of the words without an id, weighted by their occurrences."""
    symbol, k = pseudo_likelihood._SYMBOL, pseudo_likelihood.SYMBOLS
    spell = lambda w: [int(symbol[b]) for b in reversed(w.encode())] + [0, 0]
    smooth, endings, triples, pairs = pseudo_likelihood.SMOOTH, Counter(), Counter(), Counter()
    for w, n in rare.items():
        s = spell(w)
        endings[s[0], s[1]] += n
        for i in range(len(s) - 3):
            triples[tuple(s[i : i + 3])] += n
            pairs[tuple(s[i : i + 2])] += n
    of = lambda e: int(pseudo_likelihood.bucket_of(np.array([e[0] * k + e[1]]))[0])
    s = spell(word)
    bucket = of(s[:2])
    total = sum(endings[a, b] + smooth for a in range(k) for b in range(k) if of((a, b)) == bucket)
    log = math.log((endings[s[0], s[1]] + smooth) / total)
    for i in range(len(s) - 3):
        log += math.log((triples[tuple(s[i : i + 3])] + smooth) / (pairs[tuple(s[i : i + 2])] + k * smooth))
    return bucket, log - sum(math.log(list(symbol).count(symbol[b])) for b in word.encode())


def test_log_probability_against_a_plain_program(shared):
    common = " ".join(f"c{i}" for i in range(pseudo_likelihood.WORDS))
    texts = [common] * 12 + ["zzabc " * 8 + "yyabc c1 Éa", "x c5 c9 zzabc, 北京"]
    docs = shared.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pseudo_likelihood.fit(docs)
    rare = Counter(w for t in texts for w in t.lower().split() if w not in set(model.known))
    assert len(model.known) == pseudo_likelihood.WORDS and "zzabc" in rare
    net = pseudo_likelihood.Network.of(np.frombuffer(model.weights, "<f4"))
    asked = ["zzabc c1 yyabc", "c1", "qqabc xkcdq9", "x", "", "c5 c5 北京 c7"]

    def plain(text):
        ws, total = text.lower().split(), 0.0
        ids, logs = [], []
        for w in ws:
            bucket, log = plain_spelling(model, rare, w)
            ids.append(model.known.index(w) if w in model.known else pseudo_likelihood.WORDS + bucket)
            logs.append(0.0 if w in model.known else log)
        for i, own in enumerate(ids):
            at = [i + o for o in pseudo_likelihood.OFFSETS]
            near = [ids[j] if 0 <= j < len(ids) else pseudo_likelihood.VOCABULARY for j in at]
            h = np.tanh(sum(net.near[k][n].astype(float) for k, n in enumerate(near)) + net.bias)
            for z, j in ((h @ net.klass + net.klass_bias, own // pseudo_likelihood.MEMBERS), (h @ net.member[own // pseudo_likelihood.MEMBERS] + net.member_bias[own // pseudo_likelihood.MEMBERS], own % pseudo_likelihood.MEMBERS)):
                total += z[j] - math.log(np.exp(z).sum())
            total += logs[i]
        return total

    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(shared.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(asked):
        assert got[i].n_tokens == len(t.split()) and got[i].log_probability == pytest.approx(plain(t), abs=2e-3)
    own = {r.doc_id: r.log_probability for r in pseudo_likelihood.pseudo_likelihood(docs, model).collect()}
    assert own == pytest.approx({r.doc_id: r.log_probability for r in pseudo_likelihood.pseudo_likelihood(docs).collect()}, abs=1.0)


def test_words_of_a_bucket_are_told_apart(shared):
    common = " ".join(f"c{i}" for i in range(pseudo_likelihood.WORDS))
    docs = shared.createDataFrame([(i, common) for i in range(12)] + [(20, "zzabc " * 8 + "yyabc")], "doc_id long, text string")
    often, seldom, rubbish = pseudo_likelihood.score_texts(pseudo_likelihood.fit(docs), ["zzabc", "yyabc", "q#x8abc"])[1]
    assert often > seldom + 1 > rubbish + 2


@pytest.mark.parametrize("word", ["a", "ab", "é", "abc", "北京"])
def test_spellings_end(word):
    begin, triples, ending = pseudo_likelihood.spelled([word.encode(), b"zz", word.encode()])
    n = len(word.encode())
    assert np.diff(begin).tolist() == [max(0, n - 1), 1, max(0, n - 1)] and ending[0] == ending[2]
    assert all(t % pseudo_likelihood.SYMBOLS == 0 for t in triples[begin[1:] - 1][np.diff(begin) > 0])


@pytest.mark.parametrize("n", [0, 1, 2, 5, 11, 100])
def test_rounds_train_on_every_position(n):
    ids = np.arange(n, dtype=np.int32)
    at = np.concatenate([pseudo_likelihood.taught(ids, turn) for turn in range(pseudo_likelihood.ROUNDS)])
    assert sorted(at.tolist()) == list(range(n))


def test_network_never_sees_the_token_itself():
    ids = np.array([5, 6, 7, 8], np.int32)
    near = pseudo_likelihood.around(ids)
    v = pseudo_likelihood.VOCABULARY
    assert near.tolist() == [[v, v, 6, 7], [v, 5, 7, 8], [5, 6, 8, v], [6, 7, v, v]]


def test_network_probabilities_sum_to_one_and_learn():
    net = pseudo_likelihood.Network.fresh()
    near = np.array([[1, 2, 3, 4]], np.int32)
    every = np.arange(pseudo_likelihood.VOCABULARY)
    p = np.exp(net.log_probabilities(np.repeat(near, len(every), axis=0), every))
    assert abs(p.sum() - 1) < 1e-3
    before = net.log_probabilities(near, np.array([9]))[0]
    for _ in range(20):
        net.learn(near, np.array([9]), 0.2)
    assert net.log_probabilities(near, np.array([9]))[0] > before + 1
    assert np.allclose(pseudo_likelihood.Network.of(net.flat()).flat(), net.flat())


def test_count_words(awkward):
    want = Counter(w for _, t in texts_of(awkward) for w in t.lower().split())
    assert dict(pseudo_likelihood.count_words(awkward).collect()) == want
    assert pseudo_likelihood.vocabulary(awkward, 3) == [w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]]


def test_null_ids_are_held_out_by_nobody(shared):
    df = shared.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in df.select(F.coalesce(labels.remainder("doc_id", 4) == 2, F.lit(False))).collect()][0] is False
