"""Repeated byte windows by a depth-limited radix sort of suffixes.

A suffix counts through WINDOW bytes only, so two suffixes are equal exactly
where the same window stands.  They are sorted by most-significant-digit passes,
wide digits first dealt and then sorted, and a group of one is dropped at once:
it can't be a repeated window.

* First digit: the GRAM bytes of the window with the least hash, the leftmost of
  them.  All windows that share it in a row (some dozens) travel as one entry
  with a hash of the bytes that they span, so about one entry in 40 bytes is
  dealt.  Entries are packed into one block of bytes for each bucket and task,
  after equal ones of the same task have been settled.
* In a bucket, entries with the same gram and span are repeats of the first of
  them.  Entries whose gram has one span only end here.  Of the others, four
  bits for each DIGIT bytes beside the gram tell how far an entry can have
  anything in common with another; windows that reach further end here too.
* Second digit: where a gram has several spans, each window is hashed through
  its full depth (128 bits) and grouped; all but the first of a group are repeats.

A gram with very many spans in one task is hot: its entries are dealt by span
instead, and a mark in its own bucket keeps it alive there, so no bucket gets an
unbounded group.  Which windows are repeats is judged on the input, and each
document loses the bytes that its repeats cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, partitions, stored

WINDOW, GRAM = 100, 16
#: What a window can reach beyond its gram on a side is cut into so many digits of so many bytes.
DIGITS = 6
DIGIT = (WINDOW - GRAM) // DIGITS
#: Window starts that are scanned at once; positions must fit into the low bits of a key.
CHUNK, LOW = 1 << 19, 20
#: Bytes of text for each bucket at most, on average: a task holds the entries of a bucket, some 40 bytes for as many of text.
BUCKET = 64 << 20
#: Entries of a task before they are settled and dealt; spans of a gram among them that make it hot.
FLUSH, HOT = 1 << 20, 256

#: The gram has 48 bits; left and right hold four bits for each digit beside it, the nearest one highest (0: past the end of the text).
ENTRY = np.dtype([("gram", "<u8"), ("span", "<u8"), ("key", "<i8"), ("first", "<u4"), ("count", "u1"), ("ahead", "u1"), ("left", "<u4"), ("right", "<u4")])
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _rolling(raw: np.ndarray, *widths: int) -> list[np.ndarray]:
    """Mixed 64-bit hashes of the bytes from each position, for each width."""
    h, width, parts = raw.astype(np.uint64) + np.uint64(1), 1, {}
    while width <= max(widths):
        parts[width] = h
        h = h[:-width] * _powers(width) + h[width:]
        width *= 2
    out = []
    for want in widths:
        made, done = None, 0
        for width in sorted(parts, reverse=True):
            if want & width:
                made = parts[width] if made is None else made[: len(raw) - want + 1] * _powers(width) + parts[width][done : done + len(raw) - want + 1]
                done += width
        made = (made ^ (made >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(made ^ (made >> np.uint64(29)))
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` keys."""
    made, have = keys, 1
    while 2 * have <= width:
        made = np.minimum(made[:-have], made[have:])
        have *= 2
    return np.minimum(made[: len(keys) - width + 1], made[width - have :]) if have < width else made


def entries(raw: bytes, key: int) -> np.ndarray:
    """The entries of a text: gram, hash of the span, first window start and number of windows in a row."""
    found = []
    for base in range(0, len(raw) - WINDOW + 1, CHUNK):
        part = raw[base : base + CHUNK + WINDOW - 1]
        grams, digits = _rolling(np.frombuffer(part, np.uint8), GRAM, DIGIT)
        digits = ((digits >> np.uint64(56)) % np.uint64(15)).astype(np.uint32) + np.uint32(1)
        high = np.uint64(_MASK >> LOW << LOW)
        least = _least((grams & high) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1)
        at = (least & np.uint64((1 << LOW) - 1)).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        made = np.empty(len(first), ENTRY)
        h = xxhash.xxh3_64_intdigest
        made["span"] = np.fromiter((h(part[a:b]) for a, b in zip(first.tolist(), (stop + WINDOW - 1).tolist(), strict=True)), np.uint64, len(first))
        gram_at = at[first]
        for side in ("left", "right"):
            made[side] = 0
            for k in range(DIGITS):
                where = gram_at + GRAM + k * DIGIT if side == "right" else gram_at - (k + 1) * DIGIT
                there = (where >= 0) & (where < len(digits))
                made[side] |= np.where(there, digits[np.where(there, where, 0)], 0).astype(np.uint32) << np.uint32(4 * (DIGITS - 1 - k))
        made["gram"], made["key"], made["first"], made["count"], made["ahead"] = grams[gram_at] & np.uint64((1 << 48) - 1), key, first + base, stop - first, gram_at - first
        found.append(made)
    return np.concatenate(found) if found else np.empty(0, ENTRY)


def _settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by gram, span and place; (the first entry of each gram and span, all others)."""
    e = e[np.lexsort((e["first"], e["key"], e["span"], e["gram"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["gram"][1:] != e["gram"][:-1]) | (e["span"][1:] != e["span"][:-1]) | (e["count"][1:] != e["count"][:-1])
    return e[new], e[~new]


def _reach(e: np.ndarray, side: str) -> np.ndarray:
    """Bytes beyond the gram that an entry can have in common with any other of its gram: by the digits of its neighbours in order."""
    order = np.lexsort((e[side], e["gram"]))
    g, x = e["gram"][order], e[side][order]
    apart = x[1:] ^ x[:-1]
    equal = sum((apart >> np.uint32(4 * k) == 0).astype(np.int64) for k in range(DIGITS))  # leading digits alike
    equal = np.where(g[1:] == g[:-1], equal, -1)
    best = np.full(len(e), -1)
    best[1:] = equal
    best[:-1] = np.maximum(best[:-1], equal)
    out = np.empty(len(e), np.int64)
    out[order] = np.where(best < DIGITS, (best + 1) * DIGIT - 1, WINDOW)
    return out


def _pack(e: np.ndarray) -> bytes:
    """Entries as compressed columns."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(e[n]).view(np.uint8).reshape(len(e), -1).T.tobytes() for n in e.dtype.names))


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at = len(raw) // kind.itemsize, 0
    e = np.empty(n, kind)
    for name in kind.names:
        width = kind[name].itemsize
        e[name] = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind[name]).ravel()
        at += n * width
    return e


#: kind 0: bytes from start to stop are repeats; 1: windows from start to stop need their full depth; 2: packed entries for a bucket.
DEALT = "kind int, part int, key long, start int, stop int, packed binary"
SETTLED = "kind int, key long, start int, stop int"


def _rows(kind: int, e: np.ndarray, extra: int) -> list[pa.Array]:
    start = e["first"].astype(np.int32)
    return [pa.array(np.full(len(e), kind, np.int32)), pa.array(np.ascontiguousarray(e["key"])), pa.array(start), pa.array(start + e["count"].astype(np.int32) + np.int32(extra))]


def _passed(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Settled repeats, on their way through the shuffle."""
    for at in range(0, len(e), 100_000):
        kind, key, start, stop = _rows(0, e[at : at + 100_000], WINDOW - 1)
        yield pa.record_batch([kind, pa.nulls(len(key), pa.int32()), key, start, stop, pa.nulls(len(key), pa.binary())], names=[x.split()[0] for x in DEALT.split(", ")])


def _blocks(e: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Entries packed into a block for each bucket."""
    order = np.argsort(part, kind="stable")
    e, part = e[order], part[order].astype(np.int32)
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    blocks = [_pack(e[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    k = len(blocks)
    return pa.record_batch([pa.array(np.full(k, 2, np.int32)), pa.array(part[cuts[:-1]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(blocks, pa.binary())], names=[x.split()[0] for x in DEALT.split(", ")])


def _deal(buckets: int):
    """First pass over batches of texts (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
                raw = text.as_py().encode()
                if len(raw) >= WINDOW:
                    held.append(entries(raw, key))
                    n += len(held[-1])
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, repeats = _settle(np.concatenate(held))
        yield from _passed(repeats)
        # grams with many spans go by span, and leave a mark (no windows) in their own bucket
        runs = np.flatnonzero(np.concatenate([[True], first["gram"][1:] != first["gram"][:-1]]))
        sizes = np.diff(np.concatenate([runs, [len(first)]]))
        hot = np.repeat(sizes > HOT, sizes)
        marks = first[runs[sizes > HOT]].copy()
        marks["count"], marks["span"] = 0, 0
        part = np.where(hot, first["span"], first["gram"]) % np.uint64(buckets)
        # what goes by span carries a mark of its own
        own = first[hot].copy()
        own["count"], own["span"] = 0, 0
        yield _blocks(np.concatenate([first, marks, own]), np.concatenate([part, marks["gram"] % np.uint64(buckets), part[hot]]))

    return run


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of the first digit: repeats of whole spans, and the windows that need their full depth."""
    blocks, names = [], [x.split()[0] for x in SETTLED.split(", ")]
    for batch in batches:
        passed = batch.filter(pc.equal(batch["kind"], 0))
        if passed.num_rows:
            yield passed.select(names)
        blocks += [x for x in batch["packed"].to_pylist() if x]
    if not blocks:
        return
    first, repeats = _settle(np.concatenate([_unpack(x, ENTRY) for x in blocks]))
    repeats = repeats[repeats["count"] > 0]
    same = np.concatenate([[True], first["gram"][1:] != first["gram"][:-1]])
    runs = np.flatnonzero(same)
    sizes = np.diff(np.concatenate([runs, [len(first)]]))
    held = np.repeat(sizes > 1, sizes) & (first["count"] > 0)  # several spans, or a span and a mark
    marked = np.repeat(np.add.reduceat(first["count"] == 0, runs) > 0, sizes) if len(first) else held
    # windows that reach further on a side than the entry has anything in common with another can't repeat
    at = first["first"].astype(np.int64) + first["ahead"]
    low = np.where(marked, 0, at - _reach(first, "left"))
    high = np.where(marked, np.iinfo(np.int64).max, at + GRAM + _reach(first, "right") - WINDOW)
    start = np.maximum(first["first"].astype(np.int64), low)
    stop = np.minimum(first["first"].astype(np.int64) + first["count"], np.where(marked, high, high + 1))
    keep = held & (start < stop)
    open_ = first[keep].copy()
    open_["first"], open_["count"] = start[keep], (stop - start)[keep]
    for kind, e, extra in ((0, repeats, WINDOW - 1), (1, open_, 0)):
        for at in range(0, len(e), 100_000):
            yield pa.record_batch(_rows(kind, e[at : at + 100_000], extra), names=names)


#: A window by 96 bits of its hash.
DEPTH = np.dtype([("high", "<u8"), ("low", "<u4"), ("key", "<i8"), ("first", "<u4"), ("count", "u1")])


def _settle_windows(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = e[np.lexsort((e["first"], e["key"], e["low"], e["high"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["high"][1:] != e["high"][:-1]) | (e["low"][1:] != e["low"][:-1])
    return e[new], e[~new]


def _deal_windows(buckets: int):
    """Second digit: each open window of a text by the hash of its full depth; repeats within the task are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, h, held, have = zstandard.ZstdDecompressor(), xxhash.xxh3_128_digest, [], 0
        for batch in batches:
            for doc, packed, spans in zip(batch["key"].to_pylist(), batch["packed"], batch["spans"].to_pylist(), strict=True):
                raw = unzip.decompress(packed.as_py())
                at = np.unique(np.concatenate([np.arange(s["start"], s["stop"]) for s in spans]))
                made = np.empty(len(at), DEPTH)
                both = np.frombuffer(b"".join([h(raw[a : a + WINDOW]) for a in at.tolist()]), ">u8").reshape(-1, 2)
                made["high"], made["low"], made["key"], made["first"], made["count"] = both[:, 0], both[:, 1] >> np.uint64(32), doc, at, 1
                held.append(made)
                have += len(at)
                if have >= FLUSH:
                    yield from flush(held)
                    held, have = [], 0
        if have:
            yield from flush(held)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, repeats = _settle_windows(np.concatenate(held))
        yield from _passed(repeats)
        yield _blocks(first, first["high"] % np.uint64(buckets))

    return run


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of the second digit: all windows of a group but the first repeat."""
    blocks, names = [], [x.split()[0] for x in SETTLED.split(", ")]
    for batch in batches:
        passed = batch.filter(pc.equal(batch["kind"], 0))
        if passed.num_rows:
            yield passed.select(names)
        blocks += [x for x in batch["packed"].to_pylist() if x]
    if blocks:
        _, repeats = _settle_windows(np.concatenate([_unpack(x, DEPTH) for x in blocks]))
        for at in range(0, len(repeats), 100_000):
            yield pa.record_batch(_rows(0, repeats[at : at + 100_000], WINDOW - 1), names=names)


def _zipped(docs: DataFrame) -> DataFrame:
    """(key, packed): texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([batch["key"], pa.array([z.compress(t.as_py().encode()) for t in batch["text"]], pa.binary())], names=["key", "packed"])

    return docs.transform(in_arrow, run, "key long, packed binary")


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(key, doc_id, text) with unique keys in the order of rows: doc_id itself where that is unique and never null.

    Otherwise the rows are stored in the order of doc_id (null first) and text,
    and numbered along it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if per.where("n > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text"), True
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.col("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "ordered"), False


def repeated_bytes(keyed: DataFrame) -> DataFrame:
    """(key, start, stop): byte runs of ``keyed(key, text)`` covered by a window that also starts earlier; they may overlap."""
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(keyed.sparkSession), int(size) // BUCKET + 1)
    # settled repeats have no bucket and go round by their key
    place = F.coalesce(F.col("part"), F.pmod(F.xxhash64("key", "start"), F.lit(n)).cast("int"))
    settled = stored(keyed.select("key", "text").transform(in_arrow, _deal(n), DEALT).repartitionById(n, place).transform(in_arrow, _sort_buckets, SETTLED), "settled")
    open_ = settled.where("kind = 1").groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    deep = _zipped(keyed.select("key", "text")).join(open_, "key").select("key", "packed", "spans").transform(in_arrow, _deal_windows(n), DEALT)
    again = deep.repartitionById(n, place).transform(in_arrow, _sort_windows, SETTLED)
    return settled.where("kind = 0").select("key", "start", "stop").unionAll(again.select("key", "start", "stop"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """What each row of ``docs(doc_id, text)`` keeps: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes and null text is empty.  A byte goes where a window of
    WINDOW bytes covers it that also starts earlier, in a smaller doc_id or
    earlier in the document.  Rows that repeat a doc_id are ordered by text, null
    doc_ids come first; texts shorter than a window keep all; an empty table
    gives no rows; other columns are ignored.  ``with_text`` adds the remaining
    bytes and the removed runs.
    """
    keyed, by_id = _keyed(docs)
    spans = repeated_bytes(keyed).groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = _zipped(keyed.select("key", "text"))
    rows = rows.withColumn("doc_id", F.col("key")) if by_id else rows.join(keyed.select("key", "doc_id"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, packed, found in zip(batch["doc_id"].to_pylist(), batch["packed"], batch["spans"].to_pylist(), strict=True):
                raw, runs = unzip.decompress(packed.as_py()), _merge(found)
                cuts = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *((kept, [{"start": a, "stop": b} for a, b in runs]) if with_text else ())))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            names = [x.split()[0] for x in RESULT.split(", ")] + ["kept", "runs"] * with_text
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

    return rows.join(spans, "key", "left").select("doc_id", "packed", "spans").transform(in_arrow, run, RESULT + ", kept binary, runs array<struct<start:int,stop:int>>" * with_text)
