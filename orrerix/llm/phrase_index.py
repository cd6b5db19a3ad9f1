"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

``Index`` makes one pass over the documents and stores the postings (term, row,
position) as an inverted index: every file is a segment of some documents, sorted
by term, so that a term's list lies together in each segment and statistics of
row groups and pages skip all else.  No posting is shuffled for that, and later
documents are further segments.  Beside it lies the dictionary of the terms with
their numbers of postings.  The index has all terms, so that any test set can be
looked up later, or those of one vocabulary only, where the test set is known and
nothing else will be asked.  One row for each document holds its number of words.
Everything else reads these tables, never the texts again:

1. the dictionary gives each window of an item its two rarest terms as anchors;
2. the postings of anchors, adjusted by their offsets, are intersected: a
   document and a diagonal (position less offset) stay where both anchors of
   some window meet;
3. the other postings of these diagonals decide which runs of terms are there.

Postings of a frequent term are thus read only on diagonals that the rare terms
left over.  What comes from the test items is broadcast where it has been counted
to have at most BROADCAST_ROWS rows and BROADCAST_BYTES of text, and joined by
shuffle beyond.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

WINDOW = 13
#: Rows and bytes of text that a table may have to be broadcast: a text without spaces is one word of any length.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of a row group of postings, and terms whose lists are asked for by name: Spark hands no more values than these to the file reader.
ROW_GROUP, NAMED = 4 << 20, 10
#: Values of the filter on document rows that is broadcast before the last join: a bound on its size.
ROW_BUCKETS = 1 << 18

#: Words are runs of 0-9, a-z, A-Z and of what isn't ASCII.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(word: Column) -> Column:
    """ASCII letters lowered, all else as it is."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BREAKS), "")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_row, item_id, n_item, offset, term): the words of every test item, in the shared folder.

    Items with null or empty text have none; items that repeat an item_id count
    as one item with several texts.
    """
    rows = items.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_id).cast("string").alias("item_id"), _words(F.col(text)).alias("words"))
    each = rows.select("item_row", "item_id", F.size("words").alias("n_item"), F.posexplode("words").alias("offset", "word"))
    return stored(each.withColumn("term", _lower(F.col("word"))).drop("word"), "items")


def _side(df: DataFrame) -> DataFrame:
    """A table that is broadcast if it is small, by its number of rows and the bytes of its texts."""
    texts = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(0)).cast("long")
    rows, held = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


class Index:
    """Stored postings of ``docs(doc_id, text)``: of the terms of ``vocabulary(term)``, or of all terms without one.

    Null and empty texts have no postings; repeated rows and null doc_ids have
    rows of their own; other columns are ignored, whatever their names.  A text
    without breaks is one term, however long.
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame | None = None):
        # the key of the text is made before words are, so that no text goes on
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), _words(F.col("text").cast("string")).alias("words"))
        # the null after the last word stands for the document itself, at a position that is its number of words
        each = rows.select("row", "doc_id", "text_key", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("pos", "word"))
        if vocabulary is None:
            found = each.withColumn("known", _lower(F.col("word")))
        else:
            terms = vocabulary.select(F.col("term").alias("known")).distinct()
            found = each.withColumn("word", _lower(F.col("word"))).join(_side(terms), F.col("word") == F.col("known"), "left").where("known is not null or word is null")
        named = found.select("row", "pos", F.col("known").alias("term"), F.when(F.col("word").isNull(), F.col("doc_id")).alias("doc_id"), F.when(F.col("word").isNull(), F.col("text_key")).alias("text_key"))
        # every task sorts what it has read: its file is a segment of the index
        self.table = stored(named.sortWithinPartitions("term", "row", "pos"), "postings", "zstd", ROW_GROUP)
        counts = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.dictionary = stored(counts.sortWithinPartitions("term"), "dictionary", "zstd", ROW_GROUP)
        self._made: list[DataFrame] = []

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        self._made.append(stored(df, name))
        return self._made[-1]

    def release(self) -> None:
        """Delete what look-ups have left; the postings stay. For a caller that has written the results of its look-ups."""
        discard(*self._made)
        self._made.clear()

    @property
    def postings(self) -> DataFrame:
        return self.table.where("term is not null").select("row", "pos", "term")

    def lists(self, terms: list[str]) -> DataFrame:
        """(row, pos, term): the postings of up to NAMED terms; row groups and pages without any of them aren't read."""
        if len(terms) > NAMED:
            raise ValueError(f"at most {NAMED} terms are asked for by name")
        return self.postings.where(F.col("term").isin(terms))

    def _of(self, asked: DataFrame) -> DataFrame:
        """The postings of asked(term, ...) with its other columns."""
        few = [r.term for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        return (self.lists(few) if len(few) <= NAMED else self.postings).join(_side(asked), "term")

    @property
    def documents(self) -> DataFrame:
        return self.table.where("term is null").select("row", "doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))

    def _counts(self, items: DataFrame) -> DataFrame:
        """(term, n) of the items' terms, from the dictionary."""
        return self.dictionary.join(_side(items.select("term").distinct()), "term", "left_semi")

    def _near(self, rows: DataFrame) -> DataFrame:
        """Postings of the given document rows, and of few others: a filter of bounded size goes ahead of the join."""
        bucket = F.pmod(F.xxhash64("row"), F.lit(ROW_BUCKETS))
        return self.postings.withColumn("bucket", bucket).join(F.broadcast(rows.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")

    def runs(self, items: DataFrame, window: int = WINDOW) -> DataFrame:
        """(row, item_row, item_id, start, length): maximal runs of item words in documents that hold at least one window.

        A window is ``window`` consecutive words of an item, or all words of a
        shorter item; items without words have none.
        """
        need = F.least(F.lit(window), F.col("n_item"))
        # a term that no document has takes its windows out
        counted = items.join(self._counts(items), "term")
        starts = F.sequence(F.greatest(F.lit(0), F.col("offset") - need + 1), F.least(F.col("offset"), F.col("n_item") - need))
        each = counted.select("item_row", "n_item", need.alias("need"), "offset", "term", "n", F.explode(starts).alias("first"))
        of = Window.partitionBy("item_row", "first")
        rarest = (
            each.withColumn("present", F.count(F.lit(1)).over(of))
            .where("present = need")
            .withColumn("rank", F.row_number().over(of.orderBy("n", "offset")))
            .where("rank <= 2")
        )
        rarest = self._stored(rarest.select("item_row", "first", "offset", "term"), "anchors")
        pairs = rarest.groupBy("item_row", "first").agg(F.min("offset").alias("a"), F.max("offset").alias("b")).groupBy("item_row").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
        anchors = rarest.select("item_row", "offset", "term").distinct()
        hits = self._of(anchors).select("row", "item_row", (F.col("pos") - F.col("offset")).alias("diagonal"), "offset")
        met = hits.groupBy("row", "item_row", "diagonal").agg(F.collect_set("offset").alias("met")).join(_side(pairs), "item_row")
        both = F.exists("pairs", lambda p: F.array_contains("met", p["a"]) & F.array_contains("met", p["b"]))
        kept = self._stored(met.where(both).select("row", "item_row", "diagonal"), "diagonals")
        wanted = kept.join(_side(items), "item_row").select("row", (F.col("diagonal") + F.col("offset")).alias("pos"), "term", "item_row", "item_id", "diagonal", "offset", need.alias("need"))
        there = wanted.join(self._near(kept), ["row", "pos", "term"])
        line = Window.partitionBy("row", "item_row", "diagonal").orderBy("offset")
        runs = there.withColumn("run", F.col("offset") - F.row_number().over(line)).groupBy("row", "item_row", "item_id", "need", "diagonal", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
        return runs.where("length >= need").select("row", "item_row", "item_id", "start", "length")

    def phrases(self, items: DataFrame, window: int = WINDOW) -> DataFrame:
        """(doc_id, item_id, start, length): the runs with their documents; of rows alike each has its own."""
        return self.runs(items, window).join(self.documents, "row").select("doc_id", "item_id", "start", "length")

    def near(self, items: DataFrame, slack: int) -> DataFrame:
        """(doc_id, item_id, start, stop): places where all different terms of an item lie within its length plus ``slack`` words.

        The rarest term of an item anchors the places, so each occurrence of it
        gives one at most; stop is past the last word, in any order of terms.
        Items without words are nowhere; documents without words, and null
        texts, hold none; repeated rows and items have places of their own.
        """
        terms = items.select("item_row", "item_id", "n_item", "term").distinct()
        ranked = terms.join(self._counts(items), "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item_row").orderBy(F.coalesce("n", F.lit(0)), "term")))
        ranked = self._stored(ranked.select("item_row", "item_id", "term", "rank", (F.col("n_item") + F.lit(slack)).alias("span"), F.count(F.lit(1)).over(Window.partitionBy("item_row")).alias("n_terms")), "ranked")
        first = self._of(ranked.where("rank = 1")).select("row", "item_row", "item_id", "n_terms", "span", F.col("pos").alias("anchor"))
        first = self._stored(first, "anchored")
        # the other terms of an item are read only in documents that have its rarest one
        wanted = first.select("row", "item_row").distinct().join(_side(ranked.select("item_row", "term", "span")), "item_row")
        others = self._near(first).join(wanted, ["row", "term"]).select("row", "item_row", F.floor(F.col("pos") / F.col("span")).alias("bucket"), "pos", "term")
        # buckets as wide as the span: a term within reach is in the anchor's bucket or one beside it
        reach = first.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("anchor") / F.col("span")) + d)))
        met = reach.join(others, ["row", "item_row", "bucket"]).where("abs(pos - anchor) < span")
        # any window of the span that holds the anchor: try each met position as its first
        held = met.groupBy("row", "item_row", "item_id", "n_terms", "span", "anchor").agg(F.collect_set(F.struct("pos", "term")).alias("met"))
        inside = F.transform(
            F.filter("met", lambda s: s["pos"] <= F.col("anchor")),
            lambda s: F.struct(
                F.size(F.array_distinct(F.transform(F.filter("met", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + F.col("span"))), lambda x: x["term"]))).alias("k"),
                s["pos"].alias("start"),
                F.array_max(F.transform(F.filter("met", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + F.col("span"))), lambda x: x["pos"])).alias("last"),
            ),
        )
        best = held.withColumn("best", F.array_max(F.filter(inside, lambda x: x["k"] == F.col("n_terms")))).where("best is not null")
        return best.join(self.documents, "row").select("doc_id", "item_id", F.col("best.start").alias("start"), (F.col("best.last") + 1).alias("stop"))


def proximity(docs: DataFrame, items: DataFrame, slack: int = 4) -> DataFrame:
    """(doc_id, item_id, start, stop): where ``docs(doc_id, text)`` hold all different terms of an item of ``items(item_id, text)`` close together.

    Close is within the item's length plus ``slack`` words, in any order, as
    ``Index.near`` says.  Null and empty texts and items are nowhere; repeated
    rows and items have rows of their own; other columns are ignored.
    """
    terms = item_terms(items)
    return Index(docs, terms).near(terms, slack)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, tenth: int = 20, index: Index | None = None) -> DataFrame:
    """One row for each of ``docs(doc_id, text)``: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit where it lies inside an occurrence of a window of an item; a
    document is contaminated with a hit and ``tenth`` times the hits at least its
    words.  Null and empty texts have no words and are clean; rows that repeat a
    doc_id stay rows of their own; without items nothing is hit; items with a
    null item_id hit but aren't listed; other columns are ignored.  An ``index``
    of all terms of ``docs`` that is there already is looked up; otherwise one of
    the items' terms is made.
    """
    terms = item_terms(items)
    index = index or Index(docs, terms)
    runs = stored(index.runs(terms, window).select("row", "item_id", "start", (F.col("start") + F.col("length")).alias("stop")), "runs")
    index.release()
    discard(terms)
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = runs.select("row", "start", "stop").distinct().withColumn("seen", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "seen"))).alias("hit"))
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = index.documents.join(hit, "row", "left").join(listed, "row", "left")
    n_hit, ids = F.coalesce(F.col("hit"), F.lit(0)).cast("long"), F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return found.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * tenth >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, whatever the names of these.

    Rows are told apart by doc_id and text, so rows alike in both share their
    fate.  Null and empty texts are clean; without items all rows stay; an empty
    table gives no rows.
    """
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & F.xxhash64(F.col("row.text").cast("string")).eqNullSafe(F.col("bad_text")), "left_anti").select("row.*")
