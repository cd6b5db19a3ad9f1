"""Near duplicates by SimHash fingerprints and a self-join of binary tries.

Fingerprints are made in one pass over the texts and collapsed to the distinct
ones, so a group of copies is one entry from there on.  Two fingerprints within
``budget`` bits agree in at least two of budget + 2 blocks of bits, so every
fingerprint goes under each pair of blocks and only entries that share a pair
meet.  There a binary trie over the fingerprints is joined with itself: pairs of
nodes descend together bit by bit, carry the number of bits that differ so far,
and are given up beyond the budget.  Pairs of nodes that lie wholly inside one
group already linked are given up too, so a dense group costs about its size and
leaves a spanning forest rather than all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, discard, in_arrow, partitions, stored, text_or_empty
from .components import components

BITS = 64
#: Pairs of nodes that descend at once, and pairs of leaves under two nodes that are compared directly.
FRONT, DIRECT = 1 << 16, 64

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of the word shingles of a text: bit i is set where over half of the shingles' XXH64 (seed 42) have it set."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate([[0], ends[: len(parts) - words]]).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(s, 42) for s in shingles), np.dtype("<u8"), len(shingles))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(shingles) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _ONES for k in range(8)])
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long. Null text has fingerprint zero, as any text without words; other columns are ignored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], np.uint64).view(np.int64)
        return pa.record_batch([batch["doc_id"], pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).transform(in_arrow, by_batch(run), "doc_id long, fp long")


class _Forest:
    """Union-find over the leaves of one trie; ``label`` is refreshed after each round of unions."""

    def __init__(self, n: int):
        self.up, self.label, self.links = list(range(n)), np.arange(n), []

    def _root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        if not new.any():
            return
        a, b = a[new], b[new]
        _, first = np.unique(self.label[a].astype(np.int64) * len(self.label) + self.label[b], return_index=True)
        for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))
        self.label = np.array([self._root(x) for x in range(len(self.up))])


def trie_links(codes: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Indexes into sorted distinct unsigned codes: pairs within ``budget`` bits, a spanning forest of all such and the spokes of larger groups."""
    n = len(codes)
    forest = _Forest(n)
    near = np.flatnonzero(np.bitwise_count(codes[:-1] ^ codes[1:]) <= budget)
    forest.link(near, near + 1)
    one = np.uint64(1)
    stack = [(BITS, np.array([[0, n, 0, n, 0]]))]  # depth still below; ranges of two nodes, bits that differ
    while stack:
        below, front = stack.pop()
        if len(front) > FRONT:
            stack += [(below, front[FRONT:]), (below, front[:FRONT])]
            continue
        # what the groups linked so far make needless
        runs = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
        al, ah, bl, bh, err = front.T
        done = (runs[al] == runs[ah - 1]) & (runs[bl] == runs[bh - 1]) & (forest.label[al] == forest.label[bl])
        front = front[~done]
        al, ah, bl, bh, err = front.T
        few = ((ah - al) * (bh - bl) <= DIRECT) | (below == 0)
        if few.any():
            _direct(codes, front[few], budget, forest)
            front = front[~few]
        if not len(front):
            continue
        bit = np.uint64(below - 1)
        al, ah, bl, bh, err = front.T
        am, bm = (_middle(codes, lo, hi, bit, one) for lo, hi in ((al, ah), (bl, bh)))
        same = (al == bl) & (ah == bh)
        parts = [np.stack(x, 1) for x in ((al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1))]
        parts.append(np.stack((am, ah, bl, bm, err + 1), 1)[~same])  # of a node with itself both mixed pairs are one
        made = np.concatenate(parts)
        made = made[(made[:, 0] < made[:, 1]) & (made[:, 2] < made[:, 3]) & (made[:, 4] <= budget)]
        if len(made):
            stack.append((below - 1, made))
    return forest.links + _spokes(codes, budget, forest)


def _spokes(codes: np.ndarray, budget: int, forest: _Forest) -> list[tuple[int, int]]:
    """Of each group of three or more, the links within the budget to its middle: the code nearest to the majority of each bit.

    Copies that were changed at random lie around their original, which a
    spanning forest may pass by.
    """
    out: list[tuple[int, int]] = []
    names, inverse, sizes = np.unique(forest.label, return_inverse=True, return_counts=True)
    for k in np.flatnonzero(sizes > 2):
        own = np.flatnonzero(inverse == k)
        bits = np.unpackbits(codes[own].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(own), bitorder="little").view("<u8")[0]
        hub = own[np.argmin(np.bitwise_count(codes[own] ^ middle))]
        out += [(int(hub), int(x)) for x in own[(np.bitwise_count(codes[own] ^ codes[hub]) <= budget) & (own != hub)]]
    return out


def _middle(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64, one: np.uint64) -> np.ndarray:
    """Where the codes of a node begin to have the bit set."""
    prefix = (codes[lo] >> bit) | one
    return np.clip(np.searchsorted(codes, prefix << bit), lo, hi)


def _direct(codes: np.ndarray, front: np.ndarray, budget: int, forest: _Forest) -> None:
    al, ah, bl, bh, _ = front.T
    wide = bh - bl
    size = (ah - al) * wide
    which = np.repeat(np.arange(len(front)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    a, b = al[which] + k // wide[which], bl[which] + k % wide[which]
    near = (a != b) & (np.bitwise_count(codes[a] ^ codes[b]) <= budget)
    forest.link(a[near], b[near])


def near_links(distinct: DataFrame, budget: int = 4, blocks: int | None = None, agree: int = 2) -> DataFrame:
    """(turn, a, b): links between different fingerprints ``distinct(turn, fp)`` of a turn that join all that lie within ``budget`` bits.

    ``blocks`` blocks of which ``agree`` are free of differing bits; more of both
    make smaller meetings for larger corpora.
    """
    blocks = blocks or budget + agree
    if blocks < budget + agree:
        raise ValueError("too few blocks: a pair within the budget could differ in all of them")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), agree)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    keyed = distinct.select("turn", "fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "own"))
    keyed = keyed.select((F.col("turn") * len(masks) + F.col("mask")).alias("part"), "own", "fp")
    dealt = keyed.repartition(partitions(distinct.sparkSession), "part", "own").sortWithinPartitions("part", "own")

    def join(codes: np.ndarray) -> list[tuple[int, int]]:
        codes = np.sort(codes)
        return [(int(codes[a]), int(codes[b])) for a, b in trie_links(codes, budget)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("part", "own", "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            part, own, fp = now
            cut = np.flatnonzero((part[1:] != part[:-1]) | (own[1:] != own[:-1])) + 1
            last = cut[-1] if len(cut) else 0
            rest = [x[last:] for x in now]  # a meeting may go on in the next batch
            yield from found(part[:last], fp[:last], np.concatenate([[0], cut]) if last else cut)
        if rest is not None:
            yield from found(rest[0], rest[2], np.array([0, len(rest[0])]))

    def found(part: np.ndarray, fp: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        turns: list[int] = []
        sizes = np.diff(cuts)
        for k in np.flatnonzero(sizes > 1):
            at = slice(cuts[k], cuts[k + 1])
            own = join(fp[at].view(np.uint64))
            links += own
            turns += [int(part[cuts[k]]) // len(masks)] * len(own)
        if links:
            ends = np.array(links, np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(turns, pa.int32()), pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["turn", "a", "b"])

    return dealt.transform(in_arrow, run, "turn int, a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 4, words: int = 4, blocks: int | None = None, agree: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    Rows link where their fingerprints differ in at most ``budget`` bits;
    component_id is the smallest doc_id reachable over links, the row itself
    included.  Null and empty texts have fingerprint zero and link as any other;
    a row with a null doc_id takes part and doesn't give its id; rows that
    repeat a doc_id stay separate rows; other columns are ignored.
    """
    own = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(near_links(distinct.select(F.lit(0).alias("turn"), "fp"), budget, blocks, agree), "a", "b")
    named = distinct.join(linked, distinct.fp == linked.node, "left").select(F.col("fp").alias("of"), "least", F.coalesce("component", "fp").alias("class"))
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    by_fp = stored(named.join(least, "class").select("of", "component_id"), "classes")
    discard(distinct, linked)
    return own.join(by_fp, own.fp == by_fp.of).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Texts whose shingles overlap, for deduplication of a corpus.

#: Fingerprints of a text (half of them by its long words, half by its pairs of words), bytes of a long word.
TURNS, LONG = 6, 6
#: Counters of shingles, which give the order from rare to frequent, and how many of them are handed over at once.
PLACES, COUNTERS = 1 << 20, 1 << 14
#: Rare shingles of a part, of which a task holds one at a time, at most about so many; pairs of texts that are looked at at once.
PART, LOOKED_AT = 4 << 20, 1 << 20
#: Rows of a few numbers that a table may have to be broadcast: some 40 MB as a hash table; beyond it joins are shuffled.
BROADCAST_ROWS = 1 << 18
#: Bits by which shingles meet within a part, and entries of texts that are dealt together.
TOKEN, DEALT = 40, 1 << 18
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
MEMO_WORDS = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word, 42)
        return made


_word_hashes = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, from the hashes of its words."""
    k = min(words, len(h))
    return np.unique(_mixed(sum((h[i : len(h) - k + 1 + i] * _PLACE[i % len(_PLACE)] + np.uint64(i // len(_PLACE)) for i in range(k)), np.zeros(len(h) - k + 1, np.uint64))))


def _hashed(parts: list[bytes]) -> np.ndarray:
    if len(_word_hashes) > MEMO_WORDS:
        _word_hashes.clear()
    return np.fromiter(map(_word_hashes.__getitem__, parts), np.uint64, len(parts))


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8; a text without words has one of its own kind."""
    parts = raw.lower().split()
    return _runs(_hashed(parts), words) if parts else np.zeros(1, np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes of each column have each of its 64 bits set."""
    octets = hashes.view(np.uint8).reshape(len(hashes), -1)
    if len(hashes) < 256:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _ONES for k in range(octets.shape[1])])


def several(raw: bytes) -> np.ndarray:
    """TURNS SimHash fingerprints of a text in UTF-8.

    Half of them are over its different long words (all words where few are
    long) and half over its different pairs of words.  A changed word alters one
    long word or two pairs but as many shingles as these have words, so such
    fingerprints stay close where shingles still overlap; long words tell texts
    of a large vocabulary apart best, and pairs those of a small one.
    """
    parts = raw.lower().split()
    if not parts:
        return np.zeros(TURNS, np.int64)
    h = _hashed(parts)
    long = np.fromiter((len(p) >= LONG for p in parts), bool, len(parts))
    own = np.unique(h[long])
    own = own if len(own) >= 8 else np.unique(h)
    pairs = np.unique(_mixed(h[:-1] * _PLACE[0] + h[1:] * _PLACE[1])) if len(h) > 1 else own
    half = TURNS // 2
    ones = np.concatenate([2 * _ones(_mixed(f[:, None] * t[None, :])) > len(f) for f, t in ((own, _TURN[:half]), (pairs, _TURN[half:]))])
    return np.packbits(ones, bitorder="little").view("<u8").view(np.int64)


def _crowding(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """How many shingles of ``texts(packed)`` fall on each of PLACES counters, as a logarithm in a byte (a fixed size, whatever the corpus), and about how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unzip = np.zeros(PLACES, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for packed in batch["packed"]:
                np.add.at(held, (shingles(unzip.decompress(packed.as_py()), words) & np.uint64(PLACES - 1)).astype(np.int64), 1)
        if held.any():
            short = np.minimum(held, 65535).astype("<u2")
            z = zstandard.ZstdCompressor(level=1)
            blocks = [z.compress(short[at : at + COUNTERS].tobytes()) for at in range(0, PLACES, COUNTERS)]
            yield pa.record_batch([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(blocks, pa.binary())], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(unzip.decompress(counts), "<u2").astype(np.int64)
        if sums:
            level = [np.minimum(8 * np.log2(1 + c), 255).astype(np.uint8).tobytes() for c in sums.values()]
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary()), pa.array([int(c.sum()) for c in sums.values()], pa.int64())], names=["block", "counts", "n"])

    counted = texts.select("packed").transform(in_arrow, count, "block int, counts binary")
    found = counted.repartition(partitions(texts.sparkSession), "block").transform(in_arrow, total, "block int, counts binary, n long").collect()
    return np.frombuffer(b"".join(r.counts for r in sorted(found, key=lambda r: r.block)), np.uint8) if found else np.zeros(PLACES, np.uint8), sum(r.n for r in found)


def _least(n: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(n * share - 1e-9).astype(np.int64)


#: A rare shingle of a text: the bits by which it meets, the text and its class, how many shingles the text has, and how many of them are rarer.
_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("class", "<i8"), ("n", "<i4"), ("at", "<i4")])


def meetings(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(token, node, class, n, at): the rarest shingles of ``texts(node, class, packed)`` that a text of another class has among its rarest too.

    Of the n shingles of a text, in an order common to all texts, the first
    n - ceil(similarity * n) + 1 are taken: two texts whose overlap reaches the
    similarity share one of these, whatever the order.  From rare to frequent it
    keeps lines that many texts have out.  ``at`` is the place in that order.
    """
    spark = texts.sparkSession
    crowding, total = _crowding(texts, words)
    levels = spark.sparkContext.broadcast(crowding)
    # a part for each partition, and more where these would be large
    n_parts = max(partitions(spark), int(total * (1 - similarity)) // PART + 1)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, held, have = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            for node, kind, packed in zip(batch["node"].to_pylist(), batch["class"].to_pylist(), batch["packed"], strict=True):
                h = shingles(unzip.decompress(packed.as_py()), words)
                k = len(h) - int(_least(np.array(len(h)), similarity)) + 1
                order = (levels.value[(h & np.uint64(PLACES - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                order = np.sort(np.partition(order, k - 1)[:k])
                made = np.empty(k, _ENTRY)
                made["token"], made["node"], made["class"], made["n"], made["at"] = _mixed(order), node, kind, len(h), np.arange(k)
                held.append(made)
                have += k
                if have >= DEALT:
                    yield dealt(np.concatenate(held))
                    held, have = [], 0
        if have:
            yield dealt(np.concatenate(held))

    def dealt(made: np.ndarray) -> pa.RecordBatch:
        part = (made["token"] >> np.uint64(TOKEN)).astype(np.int64) % n_parts
        made["token"] &= np.uint64((1 << TOKEN) - 1)
        order = np.argsort(part, kind="stable")
        made, ends = made[order], np.cumsum(np.bincount(part, minlength=n_parts))
        used = np.flatnonzero(np.diff(ends, prepend=0))
        return pa.record_batch([pa.array(used.astype(np.int32)), pa.array([_pack(made[(ends[k - 1] if k else 0) : ends[k]]) for k in used], pa.binary())], names=["part", "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, entries in zip(batch["part"].to_pylist(), batch["entries"], strict=True):
                if part != now and held:
                    yield from shared(now, held)
                    held = []
                now = part
                held.append(entries.as_py())
        if held:
            yield from shared(now, held)

    def shared(part: int, blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        own = np.concatenate([_unpack(b) for b in blocks])
        own = own[np.argsort(own["token"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], own["token"][1:] != own["token"][:-1]]))
        # only what texts of two classes share
        apart = np.minimum.reduceat(own["class"], first) != np.maximum.reduceat(own["class"], first)
        own = own[np.repeat(apart, np.diff(np.concatenate([first, [len(own)]])))]
        own["token"] |= np.uint64(part) << np.uint64(TOKEN)
        for a in range(0, len(own), 1 << 16):
            x = own[a : a + (1 << 16)]
            yield pa.record_batch([pa.array(np.ascontiguousarray(x["token"]).view(np.int64)), *(pa.array(np.ascontiguousarray(x[c])) for c in ("node", "class", "n", "at"))], names=list(_ENTRY.names))

    entries = texts.select("node", "class", "packed").transform(in_arrow, begin, "part int, entries binary")
    return entries.repartition(partitions(spark), "part").sortWithinPartitions("part").transform(in_arrow, meet, "token long, node long, class long, n int, at int")


def _pack(e: np.ndarray) -> bytes:
    """Entries column by column and byte by byte, each node less the one before it and each class less its node: most bytes are zero."""
    node = e["node"].copy()
    columns = [e["token"], np.diff(node, prepend=np.int64(0)), e["class"] - node, e["n"], e["at"]]
    return zstandard.ZstdCompressor(level=1).compress(len(e).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(e), -1).T.tobytes() for c in columns))


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int.from_bytes(raw[:8], "little"), 8
    e = np.empty(n, _ENTRY)
    for name in _ENTRY.names:
        width = _ENTRY[name].itemsize
        e[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(_ENTRY[name]).ravel()
        at += n * width
    e["node"] = np.cumsum(e["node"])
    e["class"] += e["node"]
    return e


def pairs_that_meet(met: DataFrame, classes: DataFrame | None, similarity: float, every: bool) -> DataFrame:
    """(a, b): texts of different classes that share a rare shingle and may overlap by their sizes and places.

    The first shingle that two texts share has no shared one before it, so it
    leaves them an overlap of no more than what follows it in either; pairs that
    can't reach the similarity from there aren't made at this shingle, and a pair
    that reaches it is made at its first one.  With ``every`` all such pairs;
    otherwise for each shingle only those with one text of the class that most
    of its texts have: the one with the fewest rarer shingles, which is what
    copies changed at random lie around.  ``classes`` replaces the classes of
    ``met``.
    """

    def of(own: list[np.ndarray]) -> np.ndarray:
        node, kind, n, at = own
        if every:
            rows = max(1, LOOKED_AT // len(node))
            return np.concatenate([np.zeros((0, 2), np.int64), *(some(own, np.arange(a, min(a + rows, len(node)))[:, None], np.arange(len(node))[None, :]) for a in range(0, len(node), rows))])
        names, which, count = np.unique(kind, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return np.zeros((0, 2), np.int64)
        inside = np.flatnonzero(which == np.argmax(count))
        hub = inside[np.lexsort((node[inside], at[inside]))[0]]
        return some(own, np.array([[hub]]), np.arange(len(node))[None, :])

    def some(own: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        node, kind, n, at = own
        i, j = np.broadcast_arrays(i, j)
        take = (kind[i] != kind[j]) & ((i < j) if every else True)
        i, j = i[take], j[take]
        take = np.minimum(n[i] - at[i], n[j] - at[j]) >= _least(n[i] + n[j], similarity / (1 + similarity))
        x, y = node[i[take]], node[j[take]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch[c].to_numpy() for c in ("token", "node", "class", "n", "at")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
            last = cut[-1] if len(cut) else 0
            rest = [x[last:] for x in now]  # a shingle may go on in the next batch
            yield from found([x[:last] for x in now], np.concatenate([[0], cut]) if last else cut)
        if rest is not None:
            yield from found(rest, np.array([0, len(rest[0])]))

    def found(now: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for k in range(len(cuts) - 1):
            own = [x[cuts[k] : cuts[k + 1]] for x in now[1:]]
            if (own[1] != own[1][0]).any():
                held.append(of([own[0], own[1], own[2].astype(np.int64), own[3].astype(np.int64)]))
                have += len(held[-1])
                if have > LOOKED_AT:
                    yield batch_of(held)
                    held, have = [], 0
        if have:
            yield batch_of(held)

    def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held), axis=0)
        return pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    own = met
    if classes is not None:
        own = met.drop("class").join(classes.select("node", F.col("component").alias("class")), "node", "left")
        own = own.select("token", "node", F.coalesce("class", "node").alias("class"), "n", "at")
    dealt = own.repartition(partitions(met.sparkSession), "token").sortWithinPartitions("token")
    return dealt.transform(in_arrow, run, "a long, b long").distinct()


@lru_cache(maxsize=64)
def _of_packed(packed: bytes, words: int) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(packed), words)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``texts(node, packed)`` whose shingles overlap enough, by the sets of shingles themselves."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
            # a text of many pairs comes many times in a row; long ones aren't kept
            x, y = (_of_packed(p, words) if len(p) < 1 << 16 else _of_packed.__wrapped__(p, words) for p in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        near = pa.array(near, pa.bool_())
        return pa.record_batch([batch["a"].filter(near), batch["b"].filter(near)], names=["a", "b"])

    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    known = stored(texts.select("node", "packed").join(_side(ends), "node", "left_semi"), "compared")
    both = pairs.join(known.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b")
    made = stored(both.select("a", "b", "x", "y").transform(in_arrow, by_batch(run), "a long, b long"), "similar")
    discard(known, ends)
    return made


def _side(table: DataFrame) -> DataFrame:
    """A stored table of few numbers, broadcast if its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _keys(text: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes of it with different seeds."""
    return [F.xxhash64(text).alias("text key 1"), F.xxhash64(F.lit("second"), text).alias("text key 2")]


#: What a row of docs is known by: whether it has a doc_id, the doc_id, and the keys of its text.
_ROW = ["no id", "id", "text key 1", "text key 2"]


def _rows(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.isNull().alias("no id"), F.coalesce(doc_id, F.lit(0)).alias("id"), *_keys(text_or_empty()), text_or_empty())


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, budget: int = 4, blocks: int | None = None, agree: int = 2) -> DataFrame:
    """(no id, id, text key 1, text key 2, class): of each different text of ``docs(doc_id, text)`` its first row, and the text's class.

    Texts are linked where the overlap of their shingles of ``words`` words
    reaches ``similarity``, all such pairs and no others.  Pairs with a
    fingerprint within ``budget`` bits are compared first, and only what that
    verifies makes a class.  Then all texts that share one of their rarest
    shingles and aren't in one class yet are compared, which no similar pair
    escapes (see ``meetings``); so a large group is linked without pairing it out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        zipped, made, z = [], [], zstandard.ZstdCompressor(level=1)
        for t in batch["text"]:
            raw = t.as_py().encode()
            made.append(several(raw))
            zipped.append(z.compress(raw))
        fps = pa.ListArray.from_arrays(pa.array(np.arange(0, TURNS * len(made) + 1, TURNS, dtype=np.int32)), pa.array(np.concatenate(made)))
        return pa.record_batch([*(batch[c] for c in _ROW), fps, pa.array(zipped, pa.binary())], names=[*_ROW, "fps", "packed"])

    rows = _rows(docs).transform(in_arrow, by_batch(run), "`no id` boolean, id long, `text key 1` long, `text key 2` long, fps array<long>, packed binary")
    # copies become one text here, within the tasks and then over all
    each = rows.groupBy(*_ROW[2:]).agg(F.min(F.struct("no id", "id")).alias("first"), F.first("fps").alias("fps"), F.first("packed").alias("packed"))
    texts = stored(each.select(F.monotonically_increasing_id().alias("node"), F.col("first.`no id`").alias("no id"), F.col("first.id").alias("id"), *_ROW[2:], "fps", "packed"), "texts")
    nodes = stored(texts.select("node", F.posexplode("fps").alias("turn", "fp")), "nodes")
    sizes = nodes.groupBy("turn", "fp").agg(F.count(F.lit(1)).alias("size"))
    central = nodes.join(sizes, ["turn", "fp"]).groupBy("node").agg(F.sum("size").alias("weight"))
    heads = stored(nodes.join(central, "node").groupBy("turn", "fp").agg(F.max(F.struct("weight", "node")).alias("head")).select("turn", "fp", F.col("head.node").alias("head")), "heads")
    inside = nodes.join(heads, ["turn", "fp"]).select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = near_links(heads.select("turn", "fp"), budget, blocks, agree)
    for end in "ab":
        links = links.join(heads.select("turn", F.col("fp").alias(end), F.col("head").alias(f"head_{end}")), ["turn", end])
    pairs = inside.unionAll(links.select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))).where("a <> b")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    discard(nodes, heads)
    found = [_verified(pairs, texts, words, similarity)]
    discard(pairs)
    classes = components(found[0], "a", "b")
    own = texts.select("node", "packed").join(classes.select("node", F.col("component").alias("class")), "node", "left").select("node", F.coalesce("class", "node").alias("class"), "packed")
    met = stored(meetings(own, words, similarity), "meetings")
    for every in (False, True):
        pairs = stored(pairs_that_meet(met, classes if every else None, similarity, every), "candidates")
        found.append(_verified(pairs, texts, words, similarity))
        old, linked = classes, reduce(DataFrame.unionAll, found)
        classes = components(linked, "a", "b")
        discard(pairs, old)
    made = texts.select("node", *_ROW).join(classes, "node", "left").select(*_ROW, F.coalesce("component", "node").alias("class"))
    made = stored(made, "classes")
    discard(texts, met, classes, *found)
    return made


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, budget: int = 4) -> DataFrame:
    """One row of each class of similar texts, with all its columns: the one with the smallest doc_id.

    Null doc_ids come last; rows with the same doc_id go by a hash of the text,
    and of rows alike in doc_id and text the first by its other columns (as
    JSON) stays.  Null and empty texts, and texts without words, are alike.  An
    empty table gives no rows; columns may have any names.
    """
    texts = similar_texts(docs, words, similarity, budget)
    place = F.struct(*_ROW)
    first = stored(texts.groupBy("class").agg(F.min(place).alias("first")).select("first.*"), "first")
    discard(texts)
    # rows alike in doc_id and text are few as a rule, and only these are looked at together
    keys = _rows(docs).select(*_ROW)
    again = stored(keys.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").join(_side(first), _ROW, "left_semi"), "again")
    # names of docs stay inside a struct, so none can clash
    doc_id, text = F.col("row.doc_id").cast("long"), F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", doc_id.isNull().alias("no id"), F.coalesce(doc_id, F.lit(0)).alias("id"), *_keys(text))
    if again.isEmpty():
        return keyed.join(_side(first), _ROW, "left_semi").select("row.*")
    one = Window.partitionBy(*_ROW).orderBy(F.to_json("row"))
    several = keyed.join(_side(again), _ROW, "left_semi").withColumn("place", F.row_number().over(one)).where("place = 1")
    alone = keyed.join(_side(first.join(again, _ROW, "left_anti")), _ROW, "left_semi")
    return alone.select("row.*").unionAll(several.select("row.*"))
