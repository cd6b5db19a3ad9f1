"""Repair of conversation structure by a time-major dynamic program over many conversations at once.

A conversation is well formed where the initials of its roles read ``(s?(ua)+)?``.
Four states say what has been kept so far: nothing, ``s``, something that ends
in ``u``, something that ends in ``a``.  Conversations are bucketed by length and
stacked turn by turn, so that one step of numpy updates the state costs of all
of them; costs are computed backwards and stored, and the cheapest edits are
then traced forwards, again one turn of all conversations at a time.

Spark sorts the turns by ranges of (conv_id, turn), so a long conversation is
dealt to several tasks, and cuts what a task has of it into segments of bounded
length.  A conversation that lies inside one task and one segment is finished
there.  Of the others every segment is first reduced to sixteen numbers, the
cheapest way between each two states; these are folded backwards along the
conversation, then the states that each segment ends in are followed forwards,
and at last every segment is traced on its own.  Only the hash of a repaired
conversation runs through one task, as a stream that keeps nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, partitions, stored

#: Turns and bytes of text of a segment, numbers of a cost tensor, and bytes of text that wait for one.
SEGMENT, SEGMENT_BYTES, CELLS, WAITING = 1024, 4 << 20, 1 << 18, 8 << 20
_SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
_FAR = 1 << 40
#: A turn's code is the place of its role's initial here (3: none of them) and four times its fault.
_INITIALS = "sua"
_BLANK, _DUPLICATE, _CUT = 1, 2, 3
_PAD = 16
#: The state after the next turn that fits, a user's or in state 2 the assistant's.
_NEXT = np.array([2, 2, 3, 2])
#: (initial, state) -> state, for a turn that is kept.
_FITS = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep, goes, rerole = np.full((17, 4), _FAR), np.zeros((17, 4), np.int64), np.full(17, _FAR)
    for code in range(16):
        initial, fault = code & 3, code >> 2
        if fault not in (_BLANK, _DUPLICATE):
            cost = TRUNCATED if fault == _CUT else 0
            rerole[code] = REROLE + cost
            for s in range(4):
                if (initial, s) in _FITS:
                    keep[code, s], goes[code, s] = cost, _FITS[initial, s]
    return keep, goes, rerole


_KEEP, _GOES, _REROLE = _tables()


def _closed(costs: np.ndarray) -> np.ndarray:
    """With one or two turns inserted here where that is cheaper."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[:, _NEXT])
    return costs


#: What the states cost at the end of a conversation: nothing or an ``a`` may stand there.
TERMINAL = _closed(np.array([[0, _FAR, _FAR, 0]]))[0]


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to the end before every turn, (turns + 1, conversations, 4), of codes (turns, conversations) and the costs after the last turn."""
    costs = np.empty((len(codes) + 1, *ends.shape), np.int64)
    costs[-1] = ends
    for t in range(len(codes) - 1, -1, -1):
        c, after = codes[t], costs[t + 1]
        best = np.minimum(DELETE + after, _KEEP[c] + np.take_along_axis(after, _GOES[c], axis=1))
        best = np.minimum(best, _REROLE[c][:, None] + after[:, _NEXT])
        costs[t] = np.where((c == _PAD)[:, None], after, _closed(best))
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and emissions of the cheapest edits (3 places a turn and 2 at the end, zero: none), and the states at the end.

    Of equal costs the least letter goes first.  Emissions: 1 user and 2
    assistant inserted, 3 the turn as it is, 4 user and 5 assistant instead of
    its role.  ``last`` says where missing turns are inserted at the end.
    """
    n, r, s = len(codes), np.arange(codes.shape[1]), start.copy()
    letters, emits = np.zeros((3 * n + 2, len(r)), np.uint8), np.zeros((3 * n + 2, len(r)), np.uint8)

    def insert(where: np.ndarray, place: int) -> None:
        nonlocal s
        letters[place, where] = ord("I")
        s = np.where(where, _NEXT[s], s)
        emits[place, where] = s[where] - 1

    for t in range(n):
        c, now, after = codes[t], costs[t], costs[t + 1]
        live = c != _PAD
        for k in range(2):
            need = now[r, s]
            insert(live & (DELETE + after[r, s] != need) & (INSERT + now[r, _NEXT[s]] == need), 3 * t + k)
        need = now[r, s]
        gone = live & (DELETE + after[r, s] == need)
        kept = live & ~gone & (_KEEP[c, s] + after[r, _GOES[c, s]] == need)
        changed = live & ~gone & ~kept
        letters[3 * t + 2] = np.select([gone, kept, changed], [ord("D"), ord("K"), ord("R")], 0)
        s = np.select([kept, changed], [_GOES[c, s], _NEXT[s]], s)
        emits[3 * t + 2] = np.select([kept, changed], [3, s + 2], 0)
    for k in range(2):
        insert(last & ((s == 1) | (s == 2)), 3 * n + k)
    return letters, emits, s


def _buckets(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of conversations of about one length, and their codes one turn after the other."""
    sizes = np.array([len(c) for c in codes])
    kinds = np.frompyfunc(int.bit_length, 1, 1)(sizes.astype(object)).astype(int) if len(sizes) else sizes
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        most = max(1, CELLS // (4 * (1 << int(kind))))
        for k in range(0, len(at), most):
            chosen = at[k : k + most]
            stack = np.full((sizes[chosen].max(), len(chosen)), _PAD, np.uint8)
            for j, i in enumerate(chosen):
                stack[: sizes[i], j] = np.frombuffer(codes[i], np.uint8)
            yield chosen, stack


def edits(codes: list[bytes], ends: np.ndarray, start: np.ndarray, last: np.ndarray) -> list[tuple[bytes, bytes, int, int]]:
    """(letters, emissions, cost, state at the end) of every list of codes."""
    made: list = [None] * len(codes)
    for chosen, stack in _buckets(codes):
        costs = backward(stack, ends[chosen])
        letters, emits, state = trace(stack, costs, start[chosen], last[chosen])
        r = np.arange(len(chosen))
        paid = costs[0][r, start[chosen]] - np.where(last[chosen], 0, ends[chosen][r, state])
        for j, i in enumerate(chosen):
            there = letters[:, j] > 0
            made[i] = letters[there, j].tobytes(), emits[there, j].tobytes(), int(paid[j]), int(state[j])
    return made


def _repaired(codes: bytes, letters: bytes, emits: bytes, roles: list[str], texts: list[str]) -> tuple[int, bytes]:
    """The number of repaired turns, and their lines; ``roles`` and ``texts`` are those of turns that aren't blank or duplicate."""
    lines, turns, rows = [], iter(codes), iter(zip(roles, texts, strict=True))
    for letter, emit in zip(letters, emits, strict=True):
        if letter == ord("I"):
            lines.append("user:" if emit == 1 else "assistant:")
        elif next(turns) >> 2 not in (_BLANK, _DUPLICATE):
            role, text = next(rows)
            if emit:
                lines.append(f"{role if emit == 3 else 'user' if emit == 4 else 'assistant'}:{text}")
    return len(lines), "\n".join(lines).encode()


def _illegal(codes: bytes) -> int:
    x = np.frombuffer(codes, np.uint8) & 3
    pairs = x[:-1] * 4 + x[1:]
    return int((~np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])).sum())


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): turns after the damage that the crc32 of ``conv_id:turn`` modulo 20 says, nulls as one space.

    0 drops a turn, which leaves an empty row with n = 0 for its conversation, 1
    empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it (n = 2), 4 sets its role to user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    gone = F.col("kind") == 0
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _coded(turns: DataFrame) -> DataFrame:
    """Turns with a code for the first of its copies and one for the others; equal turns are one row, and text stays where it may be kept."""
    each = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("key", F.sha2("text", 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = each.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("said_by"), F.col("key").alias("said")).agg(F.min(F.when(F.col("n") > 0, place)).alias("first"))
    joined = each.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("said_by")) & (F.col("key") == F.col("said")), "left")
    blank = F.rtrim(F.col("text"), F.lit(_SPACES)) == ""
    cut = ~F.right(F.rtrim(F.col("text"), F.lit(_SPACES)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, _BLANK).when(~F.col("first.turn").eqNullSafe(F.col("turn")), _DUPLICATE).when(cut, _CUT).otherwise(0)
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(_INITIALS)), F.lit(3))
    coded = joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), initial.alias("initial"))
    again = F.when(F.col("fault") == _BLANK, _BLANK).otherwise(_DUPLICATE)
    keeps = ~F.col("fault").isin(_BLANK, _DUPLICATE)
    return coded.select(
        "conv_id", "turn", "role", "n", (F.col("initial") + 4 * F.col("fault")).cast("int").alias("code"), (F.col("initial") + 4 * again).cast("int").alias("again"),
        F.when(keeps, F.col("text")).alias("kept"), F.substring("text", 1, 64).alias("head"), "text",
    )


class _Segment:
    def __init__(self, conv_id, number: int):
        self.conv_id, self.number = conv_id, number
        self.codes, self.roles, self.texts, self.bytes = bytearray(), [], [], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, codes: bytes) -> None:
        self.codes += codes
        if turn is not None:
            self.turns += turn != self.high  # turns come in order
            self.low, self.high = turn if self.low is None else self.low, turn

    def figures(self) -> dict:
        faults = np.bincount(np.frombuffer(self.codes, np.uint8) >> 2, minlength=4)
        first, last = (self.codes[0] & 3, self.codes[-1] & 3) if self.codes else (None, None)
        return {"low": self.low, "high": self.high, "turns": self.turns, "blank": int(faults[_BLANK]), "duplicate": int(faults[_DUPLICATE]), "truncated": int(faults[_CUT]), "illegal": _illegal(bytes(self.codes)), "first": first, "last": last}


_FIGURES = {"low": pa.int64(), "high": pa.int64(), "turns": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "first": pa.int32(), "last": pa.int32()}
_FOUND = {"cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
_OPEN = {"codes": pa.binary(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
_PLACE = {"part": pa.int32(), "number": pa.int32()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.string()): "array<string>"}


def _finished(segments: list[_Segment]) -> Iterator[dict]:
    n = len(segments)
    codes = [bytes(s.codes) for s in segments]
    for s, c, (letters, emits, cost, _) in zip(segments, codes, edits(codes, np.tile(TERMINAL, (n, 1)), np.zeros(n, np.int64), np.ones(n, bool)), strict=True):
        _, lines = _repaired(c, letters, emits, s.roles, s.texts)
        yield {"conv_id": s.conv_id, **s.figures(), "cost": cost, "audit": letters.decode(), "repaired_sha256": hashlib.sha256(lines).hexdigest()}


def _segments(coded: DataFrame, length: int) -> DataFrame:
    """A row for each conversation that lies in one segment of one task, with its results, and for each segment of the others, with its codes and texts."""
    kind = dict(coded.dtypes)["conv_id"]
    tasks = partitions(coded.sparkSession)
    dealt = coded.repartitionByRange(tasks, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = {"conv_id": None, **_PLACE, **_FIGURES, **_FOUND, **_OPEN}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, type_of = TaskContext.get().partitionId(), None
        whole: list[_Segment] = []
        waiting = number = 0
        now: _Segment | None = None
        opened = True  # whether the conversation at hand may have more rows before this segment or in another task

        def rows(made: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array([m.get(n) for m in made], t or type_of) for n, t in names.items()})

        def as_open(s: _Segment) -> dict:
            return {"conv_id": s.conv_id, "part": part, "number": s.number, **s.figures(), "codes": bytes(s.codes), "roles": s.roles, "texts": s.texts}

        for batch in batches:
            type_of = batch.schema.field(0).type
            for conv_id, turn, role, n, code, again, kept in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None and opened:
                        yield rows([as_open(now)])
                    elif now is not None:
                        whole.append(now)
                        waiting += now.bytes + len(now.codes)
                    opened = now is None  # the first conversation of a task may have begun in another
                    number += 1
                    now = _Segment(conv_id, number)
                if waiting >= WAITING or len(whole) >= CELLS // 16:
                    yield rows(list(_finished(whole)))
                    whole, waiting = [], 0
                left = n
                while left:
                    if len(now.codes) >= length or now.bytes >= SEGMENT_BYTES:
                        yield rows([as_open(now)])
                        opened, number = True, number + 1
                        now = _Segment(conv_id, number)
                    take = min(left, length - len(now.codes))
                    now.add(turn, bytes([code if left == n else again]) + bytes([again]) * (take - 1))
                    if left == n and kept is not None:
                        now.roles.append(role)
                        now.texts.append(kept)
                        now.bytes += len(kept)
                    left -= take
        if now is not None:
            yield rows([as_open(now)])  # the last conversation of a task may go on in another
        if whole:
            yield rows(list(_finished(whole)))

    schema = ", ".join(f"`{n}` {_SQL[t] if t else kind}" for n, t in names.items())
    return dealt.select("conv_id", "turn", "role", "n", "code", "again", "kept").transform(in_arrow, run, schema)


def _starts(pieces: DataFrame) -> DataFrame:
    """(part, number, ends, start, last): what every segment's end costs and the state that it starts in."""
    place = ["part", "number"]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(3).to_pylist()
            made = np.zeros((len(codes), 4, 4), np.int64)
            ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
            for chosen, stack in _buckets(codes):
                for state in range(4):
                    made[chosen, :, state] = backward(stack, np.tile(ends[state], (len(chosen), 1)))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made.reshape(-1, 16).tolist(), pa.list_(pa.int64()))], ["conv_id", *place, "ways"])

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("number", "ascending")])
        ways = np.array(group.column("ways").to_pylist(), np.int64).reshape(-1, 4, 4)
        ends = np.tile(TERMINAL, (len(ways), 1))
        for k in range(len(ways) - 1, 0, -1):
            ends[k - 1] = np.minimum(_FAR, (ways[k] + ends[k][None, :]).min(axis=1))
        last = [False] * (len(ways) - 1) + [True]
        return pa.table({"conv_id": group.column("conv_id"), **{c: group.column(c) for c in place}, "ends": pa.array(ends.tolist(), pa.list_(pa.int64())), "last": last})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = batch.column(3).to_pylist(), np.array(batch.column(4).to_pylist(), np.int64).reshape(-1, 4)
            last = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            goes = [[x[3] for x in edits(codes, ends, np.full(len(codes), s), last)] for s in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), batch.column(5), pa.array([list(x) for x in zip(*goes, strict=True)], pa.list_(pa.int64()))], ["conv_id", *place, "ends", "last", "goes"])

    def chain(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("number", "ascending")])
        state, starts = 0, []
        for goes in group.column("goes").to_pylist():
            starts.append(state)
            state = goes[state]
        return pa.table({**{c: group.column(c) for c in place}, "ends": group.column("ends"), "last": group.column("last"), "start": pa.array(starts, pa.int64())})

    kind = dict(pieces.dtypes)["conv_id"]
    codes = pieces.select("conv_id", *place, "codes")
    ways = codes.transform(in_arrow, reduce, f"conv_id {kind}, part int, number int, ways array<long>")
    ends = ways.groupBy("conv_id").applyInArrow(fold, f"conv_id {kind}, part int, number int, ends array<long>, last boolean")
    led = codes.join(ends.drop("conv_id"), place).select("conv_id", *place, "codes", "ends", "last").transform(in_arrow, follow, f"conv_id {kind}, part int, number int, ends array<long>, last boolean, goes array<long>")
    return led.groupBy("conv_id").applyInArrow(chain, "part int, number int, ends array<long>, last boolean, start long")


def _along(pieces: DataFrame) -> DataFrame:
    """The results of conversations in several segments, or in one that a task couldn't know to be whole."""
    kind = dict(pieces.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            found = edits(col["codes"], np.array(col["ends"], np.int64).reshape(-1, 4), np.array(col["start"], np.int64), np.array(col["last"], bool))
            lines = [_repaired(c, letters, emits, roles, texts) for c, (letters, emits, _, _), roles, texts in zip(col["codes"], found, col["roles"], col["texts"], strict=True)]
            made = [pa.array([x[2] for x in found], pa.int64()), pa.array([x[0].decode() for x in found], pa.string()), pa.array([n for n, _ in lines], pa.int64()), pa.array([b for _, b in lines], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], ["conv_id", "part", "number", "cost", "audit", "lines", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, any_line, kind_of = None, None, False, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array(at, kind_of), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for conv_id, lines, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if at != [conv_id]:
                    if at:
                        yield row()
                    at, h, any_line = [conv_id], hashlib.sha256(), False
                if lines:
                    h.update(b"\n" * any_line + text)
                    any_line = True
        if at:
            yield row()

    starts = stored(_starts(pieces), "starts")
    traced = pieces.select("conv_id", "part", "number", "codes", "roles", "texts").join(starts, ["part", "number"]).select("conv_id", "part", "number", "codes", "roles", "texts", "ends", "start", "last")
    traced = stored(traced.transform(in_arrow, run, f"conv_id {kind}, part int, number int, cost long, audit string, lines long, text binary"), "traced")
    hashes = traced.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "number").select("conv_id", "lines", "text").transform(in_arrow, digest, f"conv_id {kind}, repaired_sha256 string")
    # what meets where two segments meet
    line = Window.partitionBy("conv_id").orderBy("part", "number")
    before, first = F.lag("last").over(line), F.col("first")
    legal = F.concat_ws("", before, first).isin("01", "12", "21")
    edge = pieces.where("first is not null").select("conv_id", F.when(before.isNotNull() & ~legal, 1).otherwise(0).alias("illegal"), F.when(F.lag("high").over(line) == F.col("low"), -1).otherwise(0).alias("turns"))
    zero = F.lit(0).cast("long")
    figures = [c for c in _FIGURES if c not in ("first", "last")]
    rows = pieces.select("conv_id", *figures).unionByName(edge, allowMissingColumns=True)
    sums = rows.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.coalesce(F.sum(c), zero).alias(c) for c in figures[2:]))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "audit"))), lambda x: x["audit"]), "")
    told = traced.groupBy("conv_id").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    same = lambda df, as_: df.withColumnRenamed("conv_id", as_)
    return sums.join(same(told, "told_of"), F.col("conv_id").eqNullSafe(F.col("told_of"))).join(same(hashes, "hash_of"), F.col("conv_id").eqNullSafe(F.col("hash_of")))


def repair(conversations: DataFrame, length: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``conversations(conv_id, turn, role, text)`` after damage.

    Faults are counted once for a turn, blank before duplicate before truncated;
    a duplicate's role and text have been seen earlier in its conversation.
    ``audit`` has the initials of the cheapest edits (Delete, Insert, Keep,
    Rerole), of equal costs the least text.  Turns go by turn, null first, and
    turns of one number by role and text; so rows alike are side by side.

    Null roles and texts, and nulls in the key of the damage, are one space; a
    null conv_id is a conversation.  A conversation that loses all its turns has
    zeros, no audit and the hash of nothing.  An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    cut = stored(_segments(_coded(damaged(conversations)), length), "segments")
    names = ["conv_id", *(c for c in _FIGURES if c not in ("first", "last")), "cost", "audit", "repaired_sha256"]
    made = stored(cut.where("codes is null").select(*names).unionByName(_along(cut.where("codes is not null")).select(*names)), "repaired")
    discard(cut)
    return made.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), *_counts("blank", "duplicate", "truncated", "illegal", "cost"), "audit", "repaired_sha256")


def _counts(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
