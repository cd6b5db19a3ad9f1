"""Hard negatives by a Voronoi-partitioned kNN join over inner products.

Vectors are rounded down to integers and augmented by one more coordinate, the
square root of what their squared norm lacks of the largest, while an anchor has
zero there: among augmented vectors the nearest one has the largest inner
product.  Space is cut into the cells of a fixed number of pivots.  Anchors go
to the cell that they lie in.  A candidate goes to those cells whose anchors it
might serve, by the triangle inequality with the cell's radius, and nowhere
else:

* as a positive, unless it is farther from every anchor of its label there than
  the bound on their sixth neighbour of that label (the anchor itself is one of
  the six), which comes from a table of the six candidates nearest to the pivot
  of each cell and label;
* as a negative, unless the shell of distances that the anchors' bands of scores
  ask for passes it by.

In a cell, packed blocks of candidates are multiplied with the anchors exactly.
A cell's candidates are dealt to many tasks and its anchors to groups of bounded
size, so that a cell with a third of all rows is no larger to a task than
another, and a task holds one group of anchors and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, partitions, stored

#: Cells, and rows (by the hash of their vectors) that their pivots are fitted to; any pivots give the same result.
PIVOTS, SAMPLE = 16, 1024
#: Rows of a packed block at most, bytes of its vectors at most, and anchors of a group in a task.
BLOCK, BLOCK_BYTES, GROUP = 1024, 4 << 20, 16384
#: Labels share this many entries of the table of bounds, which is broadcast.
BUCKETS = 64
POSITIVES, NEGATIVES = 5, 3
#: A null id, which sorts after all others.
NO_ID = 2**63 - 1

_BLOCK_SCHEMA = "cell int, part long, side int, keys binary, ids binary, labels binary, vecs binary, lows binary, highs binary"


class _Form:
    """How the vectors of one table are stored and multiplied, and the pivots' cells."""

    def __init__(self, width: int, largest: float):
        self.width = width
        self.stored = "<i2" if largest < 32000 else "<f8"

    def fit(self, square: float, sample: np.ndarray) -> None:
        """``square`` is the largest squared norm; products of integers are exact in the float type chosen here."""
        if square >= 2**53:
            raise ValueError("inner products of these vectors need more than 53 bits")
        self.square = square
        self.exact = np.float32 if square < 2**24 else np.float64
        self.slack = 1e-6 * (1 + square**0.5)
        self.pivots = _pivots(self.augmented(sample))
        self.between = np.sqrt(_squares(self.pivots, self.pivots))

    def vectors(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.stored).reshape(len(column), self.width)

    def augmented(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0, self.square - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        return np.sqrt(_squares(self.augmented(x, anchors), self.pivots))

    @property
    def rows(self) -> int:
        return max(1, min(BLOCK, BLOCK_BYTES // max(1, self.width * np.dtype(self.stored).itemsize)))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T)


def _pivots(x: np.ndarray) -> np.ndarray:
    """Farthest points of the sample, moved to the means of their cells a few times."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    chosen = x[:1]
    while len(chosen) < PIVOTS and (far := _squares(x, chosen).min(axis=1)).max() > 1e-9:
        chosen = np.vstack([chosen, x[far.argmax()]])
    for _ in range(5):
        cell = _squares(x, chosen).argmin(axis=1)
        chosen = np.array([x[cell == k].mean(axis=0) if (cell == k).any() else chosen[k] for k in range(len(chosen))])
    return chosen


def _prepared(embeddings: DataFrame, relabel: int, classes: int) -> tuple[DataFrame, _Form]:
    """(row, vec_id, label, square, vec) of the rows that take part, stored, with integer vectors of one width."""
    v = F.col("vector")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("label is not null and vector is not null").where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    width, largest = rows.agg(F.coalesce(F.max(F.size(v)), F.lit(0)), F.coalesce(F.max(F.greatest(F.array_max(v), -F.array_min(v))), F.lit(0.0))).first()
    form = _Form(width, 256 * largest + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            x = np.zeros((batch.num_rows, form.width))
            x[np.arange(form.width)[None, :] < sizes[:, None]] = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False))
            packed = pa.array([r.tobytes() for r in x.astype(form.stored)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array((x * x).sum(axis=1)), packed], ["row", "vec_id", "label", "square", "vec"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "label", "vector")
    base = stored(numbered.transform(in_arrow, run, "row long, vec_id long, label long, square double, vec binary"), "vectors")
    square = base.agg(F.coalesce(F.max("square"), F.lit(0.0))).first()[0]
    # SAMPLE rows of one vector each: a bounded fit, by which results don't change
    sample = [r.vec for r in base.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
    form.fit(square, np.frombuffer(b"".join(sample), form.stored).reshape(len(sample), form.width))
    return base, form


def _in_cells(anchors: DataFrame, form: _Form) -> DataFrame:
    """The anchors with the cell that they lie in and their distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = form.distances(form.vectors(batch.column(3)), anchors=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], ["row", "vec_id", "label", "vec", "square", "cell", "away"])

    return anchors.select("row", "vec_id", "label", "vec", "square").transform(in_arrow, run, "row long, vec_id long, label long, vec binary, square double, cell int, away double")


def _positive_bounds(base: DataFrame, placed: DataFrame, form: _Form) -> tuple[np.ndarray, np.ndarray]:
    """By cell and label bucket: the radius of its anchors and the distance within which their positives lie, -inf where it has none."""
    need = POSITIVES + 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = form.distances(form.vectors(batch.column(1)))
            label, cell, away = batch.column(0).to_numpy(), d.argmin(axis=1), d.min(axis=1)
            order = np.lexsort((away, cell, label))
            label, cell, away = label[order], cell[order], away[order]
            first = np.r_[True, (label[1:] != label[:-1]) | (cell[1:] != cell[:-1])]
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            keep = rank < need
            yield pa.RecordBatch.from_arrays([pa.array(label[keep]), pa.array(cell[keep].astype(np.int32)), pa.array(away[keep])], ["label", "near", "away"])

    table = base.select("label", "vec").transform(in_arrow, nearest, "label long, near int, away double")
    table = table.withColumn("rank", F.row_number().over(Window.partitionBy("label", "near").orderBy("away"))).where(F.col("rank") <= need)
    groups = placed.groupBy("cell", "label").agg(F.max("away").alias("radius"))
    k = len(form.pivots)
    between = F.element_at(F.array(*(F.lit(float(x)) for x in form.between.ravel())), F.col("cell") * k + F.col("near") + 1)
    # at most k cells, and six rows of each of k cells, for each label
    reach = groups.join(table.select("label", "near", "away"), "label").select("cell", "label", (F.col("radius") + between + F.col("away")).alias("bound"))
    sixth = reach.withColumn("rank", F.row_number().over(Window.partitionBy("cell", "label").orderBy("bound"))).where(F.col("rank") == need)
    known = groups.join(sixth.select("cell", "label", "bound"), ["cell", "label"], "left").groupBy("cell", F.pmod("label", F.lit(BUCKETS)).alias("bucket"))
    radius, bound = np.zeros((k, BUCKETS)), np.full((k, BUCKETS), -np.inf)
    for r in known.agg(F.max("radius").alias("radius"), F.max(F.coalesce("bound", F.lit(float("inf")))).alias("bound")).collect():  # k x BUCKETS rows at most
        radius[r.cell, r.bucket], bound[r.cell, r.bucket] = r.radius, r.bound
    return radius, bound


class _Packer:
    """Blocks of rows for each cell."""

    def __init__(self, side: int, most: int):
        self.side, self.most, self.parts, self.held = side, most, {}, {}

    def add(self, cell: int, keys, ids, labels, vecs, bands=None) -> Iterator[pa.RecordBatch]:
        self.parts.setdefault(cell, []).append((keys, ids, labels, vecs, *(bands if bands is not None else ())))
        self.held[cell] = self.held.get(cell, 0) + len(keys)
        if self.held[cell] >= self.most:
            yield from self.flush(cell)

    def flush(self, cell: int) -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(x) for x in zip(*self.parts.pop(cell), strict=True)]
        self.held[cell] = 0
        order = np.lexsort((rows[0], rows[1]))  # by id, and rows of one id as they come
        rows = [x[order] for x in rows]
        for at in range(0, len(order), self.most):
            packed = [x[at : at + self.most].tobytes() for x in rows]
            packed += [None] * (6 - len(packed))
            yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "part": pa.array([int(rows[0][at])], pa.int64()), "side": pa.array([self.side], pa.int32())} | {n: pa.array([x], pa.binary()) for n, x in zip(("keys", "ids", "labels", "vecs", "lows", "highs"), packed, strict=True)})

    def rest(self) -> Iterator[pa.RecordBatch]:
        for cell in list(self.parts):
            yield from self.flush(cell)


def _candidates(base: DataFrame, form: _Form, serves) -> DataFrame:
    """Packed candidates, once for each cell that they might serve; ``serves(distances, labels)`` says which."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(1, form.rows)
        for batch in batches:
            keys, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            vecs = form.vectors(batch.column(3))
            for cell, keep in enumerate(serves(form.distances(vecs), labels).T):
                if keep.any():
                    yield from packer.add(cell, keys[keep], ids[keep], labels[keep], vecs[keep])
        yield from packer.rest()

    return base.select("row", "vec_id", "label", "vec").transform(in_arrow, run, _BLOCK_SCHEMA)


def _anchor_blocks(placed: DataFrame, form: _Form, bands: bool) -> DataFrame:
    """Packed anchors of each cell; ``bands`` go along as one low and high score for each positive, empty ones filled up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(0, form.rows)
        for batch in batches:
            keys, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            vecs, cells = form.vectors(batch.column(3)), batch.column(4).to_numpy()
            limits = [np.array(batch.column(i).to_pylist(), np.int64).reshape(-1, POSITIVES) for i in (5, 6)] if bands else None
            for cell in np.unique(cells):
                k = cells == cell
                yield from packer.add(int(cell), keys[k], ids[k], labels[k], vecs[k], [x[k] for x in limits] if bands else None)
        yield from packer.rest()

    return placed.select("row", "vec_id", "label", "vec", "cell", *(("lows", "highs") if bands else ())).transform(in_arrow, run, _BLOCK_SCHEMA)


def _best(scores: np.ndarray, keys: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n largest scores of every row, ties by column (columns are in order of id); -inf is none."""
    n, at = min(n, scores.shape[1]), np.arange(len(scores))
    got = np.empty((len(scores), n)), np.empty((len(scores), n), np.int64), np.empty((len(scores), n), np.int64)
    for k in range(n):
        j = scores.argmax(axis=1)
        got[0][:, k], got[1][:, k], got[2][:, k] = scores[at, j], ids[j], keys[j]
        scores[at, j] = -np.inf
    return got


def _merged(a: tuple, b: tuple, n: int) -> tuple:
    """Of two lists of best ones for each row the best of both."""
    score, ids, keys = (np.hstack(x) for x in zip(a, b, strict=True))
    order = np.lexsort((keys, ids, -score), axis=1)[:, :n]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (score, ids, keys))


class _Join:
    """One group of anchors, and the best candidates of each that have passed."""

    def __init__(self, form: _Form, negatives: bool):
        self.form, self.negatives, self.blocks = form, negatives, []

    def anchors(self, keys, ids, labels, vecs, bands) -> None:
        self.blocks.append([keys, ids, labels, vecs.astype(self.form.exact), bands, [None] * (POSITIVES if self.negatives else 1)])

    def candidates(self, keys, ids, labels, vecs) -> None:
        other = vecs.astype(self.form.exact).T
        for own, _, own_labels, x, bands, best in self.blocks:
            scores = (x @ other).astype(np.float64)
            same = own_labels[:, None] == labels[None, :]
            if not self.negatives:
                scores[~same | (own[:, None] == keys[None, :])] = -np.inf
                found = [_best(scores, keys, ids, POSITIVES)]
            else:
                scores[same] = -np.inf
                found = [_best(np.where((scores >= low[:, None]) & (scores <= high[:, None]), scores, -np.inf), keys, ids, NEGATIVES) for low, high in zip(bands[0].T, bands[1].T, strict=True)]
            n = NEGATIVES if self.negatives else POSITIVES
            for k, got in enumerate(found):
                best[k] = got if best[k] is None else _merged(best[k], got, n)

    def result(self) -> Iterator[pa.RecordBatch]:
        for own, own_ids, labels, _, _, best in self.blocks:
            for k, got in enumerate(best):
                if got is None:
                    continue
                score, ids, keys = got
                r, c = np.nonzero(np.isfinite(score))
                arrays = own[r], own_ids[r], labels[r], np.full(len(r), k, np.int64), keys[r, c], ids[r, c], score[r, c].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["row", "anchor_id", "anchor_label", "k", "other_row", "other_id", "score"])


def _joined(anchor_blocks: DataFrame, candidate_blocks: DataFrame, form: _Form, sizes: dict[int, int], negatives: bool) -> DataFrame:
    """The best candidates of every anchor in each task, to be reduced further.

    ``sizes`` has the number of anchors of each cell.  Blocks of candidates meet
    each group of anchors of their cell once.
    """
    tasks = partitions(anchor_blocks.sparkSession)
    groups = {c: -(-n // GROUP) for c, n in sizes.items()}
    deal = max(1, 4 * tasks // max(1, sum(groups.values())))
    count = F.element_at(F.create_map(*(F.lit(x) for c, g in groups.items() for x in (c, g))), F.col("cell")) if groups else F.lit(1)
    spread = lambda n: F.pmod(F.xxhash64("part"), n.cast("long")).cast("int")
    left = anchor_blocks.withColumn("group", spread(count)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    right = candidate_blocks.where(count.isNotNull()).withColumn("share", spread(F.lit(deal))).withColumn("group", F.explode(F.sequence(F.lit(0), count - 1)))
    names = ["cell", "group", "share", "side", "keys", "ids", "labels", "vecs", "lows", "highs"]
    dealt = left.select(*names).unionAll(right.select(*names)).repartition(tasks, "cell", "group", "share").sortWithinPartitions("cell", "group", "share", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, join = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for i, (*key, side) in enumerate(zip(*columns, strict=True)):
                if key != at:
                    if join:
                        yield from join.result()
                    at, join = key, _Join(form, negatives)
                keys, ids, labels = (np.frombuffer(batch.column(j)[i].as_py(), np.int64) for j in (4, 5, 6))
                vecs = np.frombuffer(batch.column(7)[i].as_py(), form.stored).reshape(len(keys), form.width)
                if side:
                    join.candidates(keys, ids, labels, vecs)
                else:
                    join.anchors(keys, ids, labels, vecs, [np.frombuffer(batch.column(j)[i].as_py(), np.int64).reshape(-1, POSITIVES) for j in (8, 9)] if negatives else None)
        if join:
            yield from join.result()

    return dealt.transform(in_arrow, run, "row long, anchor_id long, anchor_label long, k long, other_row long, other_id long, score long")


def _first(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("row", "k").orderBy(F.desc("score"), "other_id", "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame, every: int = 50, relabel: int = 7, classes: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings(vec_id, embedding, label)``.

    Anchors are rows whose vec_id is divisible by ``every``; of rows whose vec_id
    is divisible by ``relabel`` the label counts one up modulo ``classes``.  An
    anchor's positives are its first five other rows of its label, and each
    positive has the first three rows of other labels whose score is 50 to 95
    per cent of the positive's; higher scores come first, ties by smaller id.

    Rows with a null label or vector or a component that is null or not finite
    take no part.  A null id is no anchor and comes last among ties.  Shorter
    vectors count as filled up with zeros, empty ones score zero.  Repeated rows
    are rows of their own: copies of an anchor are positives of it, and each has
    its results.  A score of zero or less leaves no band but {0}.  Where squared
    norms of the rounded vectors reach 2^53 it raises.  An empty table gives no
    rows; further columns are ignored, whatever their names.
    """
    base, form = _prepared(embeddings, relabel, classes)
    placed = stored(_in_cells(base.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)), form), "anchors")
    sizes = lambda df: {r.cell: r.n for r in df.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  a row for each pivot
    radius, bound = _positive_bounds(base, placed, form)
    slack = form.slack

    def near(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
        b = labels % BUCKETS
        return d - radius[:, b].T <= bound[:, b].T + slack

    found = _joined(_anchor_blocks(placed, form, False), _candidates(base, form, near), form, sizes(placed), False)
    positives = stored(_first(found, POSITIVES).select("row", "anchor_id", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    banded = positives.withColumns({"low": F.expr("positive_score div 2 + positive_score % 2"), "high": F.expr("positive_score * 95 div 100")}).where("positive_score >= 0 and low <= high")
    none = F.struct(F.lit(0).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))  # a band that nothing is in
    filled = [F.coalesce(F.max(F.when(F.col("place") == k + 1, F.struct("low", "high"))), none).alias(f"b{k}") for k in range(POSITIVES)]
    bands = banded.groupBy("row").agg(*filled, F.min("low").alias("least"), F.max("high").alias("most"))
    bands = bands.select("row", "least", "most", *(F.array(*(F.col(f"b{k}.{x}") for k in range(POSITIVES))).alias(f"{x}s") for x in ("low", "high")))
    asked = stored(placed.join(bands, "row"), "bands")
    # the squared distance of an anchor and a candidate is both squares less twice their score; an anchor's own square lies within these bounds
    shells = {r.cell: r for r in asked.groupBy("cell").agg(F.max("away").alias("radius"), F.min(F.col("square") - 2 * F.col("most")).alias("inner"), F.max(F.col("square") - 2 * F.col("least")).alias("outer")).collect()}  # a row for each pivot
    cells = len(form.pivots)
    inner = np.array([max(0.0, shells[c].inner + form.square) ** 0.5 if c in shells else np.inf for c in range(cells)])
    outer = np.array([max(0.0, shells[c].outer + form.square) ** 0.5 if c in shells else -np.inf for c in range(cells)])
    radii = np.array([shells[c].radius if c in shells else 0.0 for c in range(cells)])

    def within(d: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return (d + radii >= inner - slack) & (d - radii <= outer + slack)

    found = _joined(_anchor_blocks(asked, form, True), _candidates(base, form, within), form, sizes(asked), True)
    negatives = _first(found, NEGATIVES).select("row", (F.col("k") + 1).cast("int").alias("place"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    made = stored(positives.join(negatives, ["row", "place"]), "negatives")
    discard(base, placed, positives, asked)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return made.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")
