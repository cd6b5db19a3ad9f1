"""Exact similarity search over stored vectors and sets.

Vectors are packed into blocks of bounded size, and each block of query vectors
is multiplied with each block of the searched table, so no pairs of rows are
formed by a join and only the best similarity of a pair of names leaves a block.
The blocks of the query set are broadcast while they have been counted to be at
most BROADCAST_BYTES as doubles; beyond, partitions of blocks are paired.  Rows
are dealt to tasks before they become blocks, since a file may be one task's, and
no block has more than BLOCK_BYTES, whatever its vectors' length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector

#: Vectors in a block, its bytes as doubles, and bytes of a query set that may be broadcast.
BLOCK, BLOCK_BYTES, BROADCAST_BYTES = 1024, 1 << 20, 64 << 20
#: Rows of a table whose pairs are all wanted.
MOST_PAIRED = 20_000


def prompt_similars(vectors: DataFrame, prompt: list[float] | Column | DataFrame, targets: DataFrame, k: int = 20_000, uri: str = "uri", embedding: str = "embedding") -> DataFrame:
    """(uri, similarity): the k vectors nearest to the prompt among ALL vectors, then those of target uris, the best for each uri.

    The prompt is a list, a column, or a table whose one row has an ``embedding``.
    The limit comes before the choice of targets: with few neighbours none of
    the k may belong to a target, and the result is empty.
    """
    return hits(vectors, prompt, k, uri, embedding).join(targets.select(uri).distinct(), uri, "left_semi")


def hits(vectors: DataFrame, prompt: list[float] | Column | DataFrame, k: int = 20_000, uri: str = "uri", embedding: str = "embedding") -> DataFrame:
    """(uri, similarity): the uris of the k vectors nearest to the prompt, the best similarity of each; one search for any number of targets."""
    rows = vectors.where(F.col(embedding).isNotNull()).select(uri, embedding)
    if isinstance(prompt, DataFrame):
        rows = rows.join(F.broadcast(prompt.select(F.col("embedding").alias("asked for")).limit(1)))  # one row
        asked = F.col("asked for")
    else:
        asked = F.array(*map(F.lit, prompt)) if isinstance(prompt, list) else prompt
    near = rows.select(uri, vector.dot(F.col(embedding), asked).alias("similarity")).orderBy(F.desc("similarity"), uri).limit(k)
    return near.groupBy(uri).agg(F.max("similarity").alias("similarity"))


def uri_similars(vectors: DataFrame, sources: DataFrame, targets: DataFrame, above: float | None = None, uri: str = "uri", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(source, target, similarity): the best inner product of any two vectors of a source and a target uri.

    ``above`` keeps larger ones only, before anything is shuffled.  All of one
    uri's vectors meet all of another's, so the work grows with the product of
    the numbers of different vectors; what a task holds is two blocks.
    """
    asked, searched = (vectors.join(x.select(uri).distinct(), uri, "left_semi").where(F.col(embedding).isNotNull()).select(uri, embedding).distinct() for x in (sources, targets))
    kind = vectors.schema[uri].dataType
    schema = T.StructType([T.StructField("source", kind), T.StructField("target", kind), T.StructField("similarity", T.DoubleType())])
    best = _paired(asked, searched, block).mapInArrow(_best_pairs(above), schema)
    return best.groupBy("source", "target").agg(F.max("similarity").alias("similarity"))


def _paired(asked: DataFrame, searched: DataFrame, block: int) -> DataFrame:
    """Every block of the one beside every block of the other."""
    sizes = [df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(df.columns[1])), F.lit(0)).alias("numbers")).first() for df in (asked, searched)]  # one row each
    few = sizes[0].numbers * 8 <= BROADCAST_BYTES
    tasks = int(searched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = tasks if few else math.ceil(tasks**0.5)  # where partitions are paired, all pairs are tasks

    def dealt(df: DataFrame, rows: int) -> DataFrame:
        # by another hash than the one of distinct, since Spark leaves out a repartition that changes nothing
        return df.repartition(max(1, min(most, -(-rows // block))), F.xxhash64(*df.columns))

    blocks = _blocks(asked.coalesce(1) if few else dealt(asked, sizes[0].rows), "a", block)
    # the searched side streams, so the columns of the asked one come first again by name
    made = _blocks(dealt(searched, sizes[1].rows), "b", block).join(F.broadcast(blocks) if few else blocks)
    return made.select("names a", "matrix a", "names b", "matrix b")


def _blocks(rows: DataFrame, side: str, size: int) -> DataFrame:
    """(names, matrix): so many vectors a row, as doubles, or fewer where they are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                part = part.slice(0, max(1, BLOCK_BYTES // max(1, 8 * max(map(len, part.column(1))))))
                names = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.record_batch([names, pa.array([np.array(part.column(1).to_pylist(), float).tobytes()], pa.binary())], names=[f"names {side}", f"matrix {side}"])
                at += part.num_rows
            del batch  # the next one comes before the loop lets go of this one

    kind = rows.schema[0].dataType
    return rows.mapInArrow(run, T.StructType([T.StructField(f"names {side}", T.ArrayType(kind)), T.StructField(f"matrix {side}", T.BinaryType())]))


def _best_pairs(above: float | None, k: int | None = None):
    """The best similarity of each pair of names of two blocks: those larger than ``above``, and of each name of the first what can be among its ``k``, ties included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.column(k).type.value_type for k in (0, 2)]
            for row in range(batch.num_rows):
                own, x, its, y = (batch.column(k)[row].as_py() for k in range(4))
                own, own_at = np.unique(np.array(own), return_inverse=True)
                its, its_at = np.unique(np.array(its), return_inverse=True)
                x, y = (np.frombuffer(m).reshape(n, -1) for m, n in ((x, len(own_at)), (y, len(its_at))))
                # vectors of one name in a row, then the best of each pair of names
                by, of = np.argsort(own_at, kind="stable"), np.argsort(its_at, kind="stable")
                best = np.maximum.reduceat(x[by] @ y[of].T, np.searchsorted(own_at[by], np.arange(len(own))), axis=0)
                best = np.maximum.reduceat(best, np.searchsorted(its_at[of], np.arange(len(its))), axis=1)
                keep = best > above if above is not None else np.ones_like(best, bool)
                if k is not None and k < best.shape[1]:
                    keep &= best >= np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k, None]
                i, j = np.nonzero(keep)
                yield pa.record_batch([pa.array(own[i].tolist(), kinds[0]), pa.array(its[j].tolist(), kinds[1]), pa.array(best[i, j])], names=["source", "target", "similarity"])
            del batch  # the next one comes before the loop lets go of this one

    return run


def by_index(vectors: DataFrame, wanted: DataFrame, index: str = "index") -> DataFrame:
    """The stored vectors with the wanted indexes, each as often as it is stored; an index that isn't there gives none."""
    return vectors.join(wanted.select(index).distinct(), index, "left_semi")


def search(index: DataFrame, queries: DataFrame, k: int, embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, index, similarity): the k stored vectors nearest to each of queries(query, embedding), by inner product, ties by index."""
    from .relational import top_per_group

    paired = _paired(queries.select("query", embedding), index.where(F.col(embedding).isNotNull()).select("index", embedding), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.column(k).type.value_type for k in (0, 2)]
            for row in range(batch.num_rows):
                own, x, its, y = (batch.column(c)[row].as_py() for c in range(4))
                own, its = np.array(own), np.array(its)
                scores = np.frombuffer(x).reshape(len(own), -1) @ np.frombuffer(y).reshape(len(its), -1).T
                # of each block of the index only what can be among the k, ties included
                least = np.partition(scores, max(0, len(its) - k), axis=1)[:, max(0, len(its) - k)]
                i, j = np.nonzero(scores >= least[:, None])
                yield pa.record_batch([pa.array(own[i].tolist(), kinds[0]), pa.array(its[j].tolist(), kinds[1]), pa.array(scores[i, j])], names=["query", "index", "similarity"])
            del batch  # the next one comes before the loop lets go of this one

    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("index", index.schema["index"].dataType), T.StructField("similarity", T.DoubleType())])
    return top_per_group(paired.mapInArrow(run, schema), "query", k, F.desc("similarity"), "index").select("query", "index", "similarity")


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df``, or an error when it is run and has more rows: for what needs a table whole."""
    size = df.agg(F.count(F.lit(1)).alias("rows of all"))  # one row
    fits = F.when(F.col("rows of all") <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what} takes at most {most} rows, not "), F.col("rows of all").cast("string"))).cast("boolean"))
    return df.join(F.broadcast(size)).where(fits).drop("rows of all")


def tanimoto_join(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of keys a < b whose item sets have a Tanimoto coefficient of at least the threshold (above 0).

    Two such sets share an item among the rarest few of each, so only those are
    joined; sizes that rule a pair out are left before the sets are compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    each = sets.select(F.col(key).alias("key"), F.array_distinct(items).alias("set")).where(F.size("set") > 0)
    exploded = each.select("key", F.explode("set").alias("item"))
    frequency = exploded.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    ranked = exploded.join(frequency, "item").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked"))
    size = F.size("ranked")
    prefix = ranked.select("key", "ranked", size.alias("size"), F.explode(F.slice("ranked", 1, (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int"))).alias("first")).select("key", "size", "first.item", F.transform("ranked", lambda x: x["item"]).alias("set"))
    a, b = (prefix.select(*(F.col(c).alias(f"{c}_{n}") for c in ("key", "size", "set")), "item") for n in "ab")
    close = (F.col("size_a") >= F.col("size_b") * threshold - 1e-9) & (F.col("size_b") >= F.col("size_a") * threshold - 1e-9)
    pairs = a.join(b, "item").where((F.col("key_a") < F.col("key_b")) & close)
    scored = pairs.withColumn("similarity", vector.tanimoto_sets(F.col("set_a"), F.col("set_b"))).where(F.col("similarity") >= threshold - 1e-12)
    return scored.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "similarity").distinct()


def similarity_to_examples(sets: DataFrame, examples: list[tuple[object, list]], items: str, key: str = "example") -> DataFrame:
    """A row for each set and example: the examples, a stated few, are part of the plan."""
    own = F.array(*(F.struct(F.lit(k).alias(key), F.array(*map(F.lit, bits)).alias("bits")) for k, bits in examples))
    made = sets.withColumn("of example", F.explode(own))
    return made.withColumn("similarity", vector.tanimoto_sets(F.col(items), F.col("of example.bits"))).withColumn(key, F.col(f"of example.{key}")).drop("of example")


def max_similarity(sets: DataFrame, examples: list[tuple[object, list]], items: str, name: str = "max_similarity") -> DataFrame:
    """The largest Tanimoto coefficient with any example; null without examples."""
    scores = [vector.tanimoto_sets(F.col(items), F.array(*map(F.lit, bits))) for _, bits in examples]
    return sets.withColumn(name, F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else F.lit(None).cast("double"))


def pairwise_matrix(sets: DataFrame, key: str, items: str, most: int = MOST_PAIRED) -> DataFrame:
    """(i, j, similarity) for all pairs, i with itself too: the matrix is the result, so a table of more than ``most`` rows raises."""
    own = bounded(sets.select(key, items), most, "a matrix of all pairs")
    a, b = own.select(F.col(key).alias("i"), F.col(items).alias("x")), own.select(F.col(key).alias("j"), F.col(items).alias("y"))
    upper = a.join(b, F.col("i") <= F.col("j")).select("i", "j", vector.tanimoto_sets(F.col("x"), F.col("y")).alias("similarity"))
    both = F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return upper.select(F.explode(both).alias("at"), "similarity").select("at.i", "at.j", "similarity")


def nearest_analogues(sets: DataFrame, examples: list[tuple[object, list]], key: str, items: str, below: float = 0.95, k: int = 4) -> DataFrame:
    """(example, key, similarity): the k nearest rows of each example that aren't nearly the same."""
    from .relational import top_per_group

    scored = similarity_to_examples(sets.select(key, items), examples, items).where(F.col("similarity") < below)
    return top_per_group(scored, "example", k, F.desc("similarity"), key).select("example", key, "similarity")
