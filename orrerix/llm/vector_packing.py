"""Vector bin packing of examples into training sequences.

A bin has three capacities: tokens, segments and loss-bearing tokens.  The open
bin takes, among the waiting examples that fit, the one with the largest dot
product of its demand and the room that is left, each dimension weighted by its
mean demand.  Where examples may be cut, an example that doesn't fit gives the
bin what it still holds, and a bin that can't be filled is cut at powers of two,
which need no padding.

Each task packs the examples of its own partition with a bounded set waiting,
so nothing is shuffled, memory doesn't grow with the input, and a repeated task
gives the same sequences.  Sequence ids carry the partition in their high bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, in_arrow, stored, text_or_empty
from .tokens import encoder, word_bpe_path

#: Examples that wait in a task for a bin.
WAITING = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


@dataclass
class Piece:
    """A run of an example: place in the example, tokens, loss-bearing tokens, and what the caller needs to know it again."""

    key: object
    start: int
    length: int
    loss: int
    sequence: int = -1
    offset: int = -1


@dataclass
class Packer:
    """Packs pieces as they come; ``add`` and ``flush`` yield the placed ones.

    With ``cut``, every token of an example is loss-bearing or none is.
    """

    limits: Limits = field(default_factory=Limits)
    cut: bool = True
    first_sequence: int = 0
    waiting: list[Piece] = field(default_factory=list)

    def __post_init__(self):
        self.sequence = self.first_sequence
        self.demand = np.zeros((0, 3))

    def add(self, piece: Piece) -> Iterator[Piece]:
        cap = self.limits
        if not self.cut and (piece.length > cap.tokens or piece.loss > cap.loss_tokens):
            raise ValueError(f"an example of {piece.length} tokens, {piece.loss} with loss, fits no sequence; truncate it or allow cuts")
        while self.cut and piece.length >= self._most(piece):
            head, piece = self._split(piece, self._most(piece))
            yield from self._close([head])
            if not piece.length:
                return
        self.waiting.append(piece)
        if len(self.waiting) >= WAITING:
            yield from self._pack(WAITING // 2)

    def flush(self) -> Iterator[Piece]:
        yield from self._pack(0)

    def _most(self, piece: Piece) -> int:
        return min(self.limits.tokens, self.limits.loss_tokens) if piece.loss else self.limits.tokens

    @staticmethod
    def _split(piece: Piece, n: int) -> tuple[Piece, Piece]:
        loss = n if piece.loss else 0
        return Piece(piece.key, piece.start, n, loss), Piece(piece.key, piece.start + n, piece.length - n, piece.loss - loss)

    def _pack(self, keep: int) -> Iterator[Piece]:
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], float)
        items = self.waiting
        need = np.array([[p.length, 1, p.loss] for p in items], float).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        share = need / cap
        weight = share.mean(axis=0) if len(items) else cap
        while alive.sum() > keep:
            room, chosen = cap.copy(), []
            while room[0] > 0 and room[1] > 0:
                fits = alive & (need <= room).all(axis=1)
                whole = np.flatnonzero(fits)
                last = self.cut and room[1] == 1 and chosen
                if len(whole) and not (last and not (need[whole, 0] == room[0]).any() and (need[alive, 0] > room[0]).any()):
                    best = whole[np.argmax(share[whole] @ (weight * room / cap))]
                    chosen.append(items[best])
                    room -= need[best]
                    alive[best] = False
                    continue
                rest = np.flatnonzero(alive)
                if not self.cut or not len(rest):
                    break
                best = rest[np.argmax(need[rest, 0])]
                n = int(min(room[0], room[2] if items[best].loss else room[0], need[best, 0]))
                if n <= 0:
                    break
                if n == need[best, 0]:
                    head, alive[best] = items[best], False
                else:
                    head, items[best] = self._split(items[best], n)
                    need[best], share[best] = [items[best].length, 1, items[best].loss], np.array([items[best].length, 1, items[best].loss]) / cap
                chosen.append(head)
                room -= [n, 1, head.loss]
            yield from self._close(chosen)
        self.waiting = [p for p, a in zip(items, alive, strict=True) if a]

    def _close(self, pieces: list[Piece]) -> Iterator[Piece]:
        total = sum(p.length for p in pieces)
        if not self.cut or total == self.limits.tokens:
            yield from self._emit(pieces)
            return
        queue = list(pieces)
        while total:
            room, part = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                piece = queue.pop(0)
                if piece.length > room:
                    piece, rest = self._split(piece, room)
                    queue.insert(0, rest)
                part.append(piece)
                room -= piece.length
            yield from self._emit(part)

    def _emit(self, pieces: list[Piece]) -> Iterator[Piece]:
        at = 0
        for p in pieces:
            p.sequence, p.offset = self.sequence, at
            at += p.length
            yield p
        self.sequence += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, limits: Limits | None = None, tokenizer_path: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack every ``docs(doc_id, text)`` row into sequences: a row for each piece; ``with_ids`` adds its ids as bytes.

    Null text is empty (the end id alone); rows that repeat a doc_id, and null
    doc_ids, are examples of their own; an empty table gives no rows; other
    columns are ignored.  All tokens of a document bear loss.
    """
    path, limits = tokenizer_path or word_bpe_path(), limits or Limits()
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer, out = encoder(path), Packer(limits, True, TaskContext.get().partitionId() << 33), []

        def placed(pieces: Iterator[Piece]) -> None:
            for p in pieces:
                doc_id, ids = p.key
                own = ids[4 * p.start : 4 * (p.start + p.length)]
                out.append((doc_id, p.start, p.length, zlib.crc32(own), len(ids) // 4, p.sequence, p.offset, p.loss, *[own] * with_ids))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = code.encode(text.as_py()) + end
                placed(packer.add(Piece((doc_id, ids), 0, len(ids) // 4, len(ids) // 4)))
                if len(out) >= 8192:
                    yield _batch(out, with_ids)
                    out.clear()
        placed(packer.flush())
        if out:
            yield _batch(out, with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).transform(in_arrow, pack, SCHEMA + ", ids binary" * with_ids)


def _batch(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    return pa.record_batch([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names=names)


PLACED = "sequence_id long, offset long, n_tokens long, n_loss long"


def pack_examples(examples: DataFrame, key: str, tokens: str = "n_tokens", loss: str = "n_loss", limits: Limits | None = None) -> DataFrame:
    """Place whole examples, which are never cut, under all three limits: key, sequence_id, offset, n_tokens, n_loss.

    The key may have any type and name, be null and repeat: each row is an
    example of its own (a key named as one of the other columns of the result
    comes out as ``key``).  Null counts are zero; ties go by the order of rows;
    an example beyond a limit raises, since dropping or cutting it would change
    the data; an empty table gives no rows; other columns are ignored.
    """
    limits = limits or Limits()
    kind = examples.schema[key].dataType
    chosen = examples.select(F.col(f"`{key}`").alias("key"), *(F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(n) for c, n in ((tokens, "n_tokens"), (loss, "n_loss"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, as_sent = Packer(limits, False, TaskContext.get().partitionId() << 33), None
        for batch in batches:
            as_sent, out = batch.column(0).type, []
            for i, (n, m) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                out += packer.add(Piece(batch.column(0)[i], 0, n, m))
            yield from made(out, as_sent)
        yield from made(list(packer.flush()), as_sent)

    def made(pieces: list[Piece], as_sent: pa.DataType) -> Iterator[pa.RecordBatch]:
        if pieces:
            yield pa.record_batch([pa.array([p.key.as_py() for p in pieces], as_sent), *(pa.array([getattr(p, n) for p in pieces], pa.int64()) for n in ("sequence", "offset", "length", "loss"))], names=["key", *(x.split()[0] for x in PLACED.split(", "))])

    schema = T.StructType([T.StructField("key", kind), *(T.StructField(x.split()[0], T.LongType()) for x in PLACED.split(", "))])
    placed = chosen.transform(in_arrow, pack, schema)
    return placed if key in placed.columns else placed.withColumnRenamed("key", key)


def conversation_examples(turns: DataFrame, tokenizer_path: str | None = None, limits: Limits | None = None) -> DataFrame:
    """(conv_id, turn, piece, n_tokens, n_loss): conversations of ``turns(conv_id, turn, role, text)`` as examples for instruction tuning.

    A turn is its ids and an end id, and the tokens of the assistant's turns bear
    loss.  A conversation within the limits is one example (null turn, piece 0);
    of a longer one each turn is an example, and a turn that alone exceeds a
    limit is cut into pieces.  Null text is empty, a null role bears no loss, a
    null conv_id is a conversation like any other, repeated turns count each;
    other columns are ignored; an empty table gives no rows.
    """
    path, limits = tokenizer_path or word_bpe_path(), limits or Limits()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = encoder(path)
        n = np.array([len(code.encode(t.as_py())) // 4 + 1 for t in batch["text"]])
        bears = np.array([r.as_py() == "assistant" for r in batch["role"]])
        return pa.record_batch([batch["conv_id"], batch["turn"], pa.array(n), pa.array(np.where(bears, n, 0))], names=["conv_id", "turn", "n_tokens", "n_loss"])

    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text_or_empty())
    counted = stored(rows.transform(in_arrow, by_batch(count), "conv_id string, turn long, n_tokens long, n_loss long"), "turns")
    total = counted.groupBy("conv_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_loss").alias("n_loss"))
    fits = (F.col("n_tokens") <= limits.tokens) & (F.col("n_loss") <= limits.loss_tokens)
    whole = total.where(fits).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(0).alias("piece"), "n_tokens", "n_loss")
    long = total.where(~fits).select(F.col("conv_id").alias("of"))
    cap = F.when(F.col("n_loss") > 0, F.lit(min(limits.tokens, limits.loss_tokens))).otherwise(F.lit(limits.tokens))
    each = counted.join(long, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").withColumn("cap", cap)
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("cap")).cast("int"))))
    n = F.least(F.col("cap"), F.col("n_tokens") - F.col("piece") * F.col("cap"))
    return whole.unionAll(pieces.select("conv_id", "turn", "piece", n.cast("long").alias("n_tokens"), F.when(F.col("n_loss") > 0, n).otherwise(F.lit(0)).cast("long").alias("n_loss")))


def pack_conversations(turns: DataFrame, limits: Limits | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """(conv_id, turn, piece, sequence_id, offset, n_tokens, n_loss): the examples of ``conversation_examples`` in sequences under all three limits."""
    limits = limits or Limits(4096, 16, 2048)
    examples = conversation_examples(turns, tokenizer_path, limits)
    placed = pack_examples(examples.select(F.struct("conv_id", "turn", "piece").alias("example"), "n_tokens", "n_loss"), "example", limits=limits)
    return placed.select("example.*", "sequence_id", "offset", "n_tokens", "n_loss")
