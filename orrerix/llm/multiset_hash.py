"""Document fingerprints that are sums: homomorphic multiset hashes of paragraphs.

A paragraph (a line of the text) hashes to a vector, and a text's fingerprint is
the sum of its paragraphs' vectors, each lane modulo a power of two.  So
paragraphs can be added or taken away without the rest of the text, fingerprints
of parts add up, and the order of paragraphs doesn't matter.

A vector has two parts.  The first lanes are a uniform hash of the paragraph's
bytes: texts with the same multiset of paragraphs agree there and others don't.
The other lanes are a sketch: each run of three words of the paragraph adds or
takes one in one lane.  Lanes are 32 bits wide and signed when they are read, so
2^31 equal runs fit.  The squared length of a difference of sketches estimates
how many runs two texts don't share, which gives a likeness between 0 and 1.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, partitions

EQUAL_LANES, SKETCH_LANES, RUN = 16, 256, 3
MEMO_WORDS = 400_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = made = xxhash.xxh64_intdigest(word, 7)
        return made


_words = _Words()


class MultisetHash:
    """A sum of paragraph vectors; ``+`` and ``-`` join and part multisets."""

    __slots__ = ("equal", "sketch")

    def __init__(self, equal: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, np.uint32) if equal is None else equal
        self.sketch = np.zeros(SKETCH_LANES, np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, text: str) -> MultisetHash:
        """The fingerprint of a whole text; the empty text is one empty paragraph."""
        paragraphs = text.split("\n")
        digests = b"".join(hashlib.shake_128(p.encode()).digest(4 * EQUAL_LANES) for p in paragraphs)
        equal = np.frombuffer(digests, "<u4").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint32)
        return cls(equal, _sketch([p.split() for p in paragraphs]))

    def __add__(self, other: MultisetHash) -> MultisetHash:
        return MultisetHash(self.equal + other.equal, self.sketch + other.sketch)

    def __sub__(self, other: MultisetHash) -> MultisetHash:
        return MultisetHash(self.equal - other.equal, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MultisetHash) and bool((self.equal == other.equal).all())

    __hash__ = None

    def likeness(self, other: MultisetHash) -> float:
        """1 for equal multisets, about the Dice coefficient of their runs of words otherwise; two texts without runs that differ: 0."""
        if self == other:
            return 1.0
        own, its, apart = (float(np.square(s.view(np.int32).astype(float)).sum()) for s in (self.sketch, other.sketch, self.sketch - other.sketch))
        return min(1.0, max(0.0, 1 - apart / (own + its))) if own + its else 0.0

    def __str__(self) -> str:
        return base64.b64encode(self.equal.astype("<u4").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, shown: str) -> MultisetHash:
        raw = base64.b64decode(shown)
        return cls(np.frombuffer(raw[: 4 * EQUAL_LANES], "<u4").astype(np.uint32), np.frombuffer(raw[4 * EQUAL_LANES :], "<u4").astype(np.uint32))


def _sketch(paragraphs: list[list[str]]) -> np.ndarray:
    sizes = np.fromiter(map(len, paragraphs), np.int64, len(paragraphs))
    n = int(sizes.sum())
    if not n:
        return np.zeros(SKETCH_LANES, np.uint32)
    if len(_words) > MEMO_WORDS:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(paragraphs)), np.uint64, n)
    of = np.repeat(np.arange(len(sizes)), sizes)
    whole = of[RUN - 1 :] == of[: n - RUN + 1] if n >= RUN else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    runs = h[at] * _MIX[0] + h[at + 1] * _MIX[1] + h[at + 2] * _MIX[2]
    # a paragraph too short for a run counts as one
    ends = np.cumsum(sizes)
    short = np.flatnonzero((sizes > 0) & (sizes < RUN))
    if len(short):
        sums = np.array([h[ends[i] - sizes[i] : ends[i]].sum(dtype=np.uint64) for i in short], np.uint64)
        runs = np.concatenate([runs, sums * _MIX[1] + sizes[short].astype(np.uint64)])
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    lane, sign = (runs & np.uint64(SKETCH_LANES - 1)).astype(np.int64), (runs >> np.uint64(20) & np.uint64(1)).astype(np.int64)
    both = np.bincount(lane + SKETCH_LANES * sign, minlength=2 * SKETCH_LANES)
    return (both[SKETCH_LANES:] - both[:SKETCH_LANES]).astype(np.uint32)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every row of ``docs(doc_id, text)``; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield pa.record_batch([batch["doc_id"], pa.array(map(len, texts), pa.int64()), pa.array([str(MultisetHash.of(t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).transform(in_arrow, run, "doc_id long, n_chars long, fingerprint string")


def _place(points: list[int], key: Column) -> Column:
    """How many of the points, which descend, are above the key: two short scans of a sorted array."""
    if not points:
        return F.lit(0)
    step = max(1, int(len(points) ** 0.5))
    all_, some = F.lit(points), F.lit(points[::step])
    coarse = F.size(F.filter(some, lambda p: p > key))
    first = F.greatest(F.lit(0), coarse - 1) * step
    return first + F.size(F.filter(F.slice(all_, first + 1, F.lit(step)), lambda p: p > key))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt so that each task sees a range of documents in descending doc_id order, and what follows its last.

    (doc_id, text, ahead), each partition sorted with the row that follows the
    range first (ahead is 1).  Rows alike in doc_id go by a hash of the text and
    then the text, and by that hash they are dealt to several tasks where they
    are many.  A boundary and the place of a first row for each partition are
    all that reaches the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = partitions(spark)
    cuts = Counter(keyed.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("p")).first().p or [])
    points = sorted(cuts, reverse=True)
    # a key that is a boundary more than once has as many tasks of its own, by the hash
    shares = max([1, *cuts.values()])
    heavy = [(p, c) for p, c in cuts.items() if c > 1]
    own = F.lit(0)
    if heavy:
        many = F.try_element_at(F.create_map(*(F.lit(x) for pair in heavy for x in pair)), F.col("key"))
        own = F.coalesce(F.lit(1) + F.least(many - 1, F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * many)), F.lit(0))
    placed = keyed.withColumn("part", (_place(points, F.col("key")) * (shares + 1) + own).cast("long")).withColumn("down", F.bitwise_not("key"))
    heads = sorted((r.part, r.head.down, r.head.hash) for r in placed.groupBy("part").agg(F.min(F.struct("down", "hash")).alias("head")).collect())  # a row for each partition
    # each part's number, the part before it in the circle, and where it begins
    table = spark.createDataFrame([(part, i, (i - 1) % len(heads), down, h) for i, (part, down, h) in enumerate(heads)], "part long, number int, before int, `first down` long, `first hash` long")
    numbered = placed.join(F.broadcast(table), "part")
    first = numbered.where((F.col("down") == F.col("first down")) & (F.col("hash") == F.col("first hash"))).groupBy("before").agg(F.min("text").alias("text"))
    ahead = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("hash"), F.col("before").alias("number"), F.lit(1).alias("ahead"))
    dealt = numbered.select("doc_id", "text", "down", "hash", "number", F.lit(0).alias("ahead")).unionByName(ahead)
    return dealt.repartitionById(max(1, len(heads)), F.col("number")).sortWithinPartitions(F.desc("ahead"), "down", "hash", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, a row for each of ``docs(doc_id, text)``.

    The edited text ends with the beginning of the next document, in descending
    doc_id order and after the last the first.  Null text is empty; null doc_ids
    come last; rows that repeat a doc_id follow each other by a hash of the text,
    then by the text; a single row is its own next; texts of any length are
    fingerprinted whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, held, out = None, None, []

        def row(one: tuple, text: str, other: MultisetHash) -> None:
            doc_id, own, mine = one
            edited = own[: len(own) - len(own) // 2] + text[: len(own) // 2]
            made = MultisetHash.of(edited)
            out.append((doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), str(mine), str(made), mine.likeness(made), mine.likeness(other)))

        for batch in batches:
            for doc_id, text, first in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "ahead")), strict=True):
                if first:
                    ahead = text
                    continue
                now = (doc_id, text, MultisetHash.of(text))
                if held is not None:
                    row(held, text, now[2])
                held = now
                if len(out) >= 1000:
                    yield _batch(out)
                    out.clear()
        if held is not None:
            row(held, ahead, MultisetHash.of(ahead))
        if out:
            yield _batch(out)

    return with_next(docs).select("doc_id", "text", "ahead").transform(in_arrow, run, SCHEMA)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [x.split() for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])
