"""License scans by an exact set-similarity join of text blocks with license templates.

A block is WIDTH words that begin at a multiple of STEP, so text of up to
WIDTH - STEP + 1 words lies wholly in some block wherever it stands.  A template
matches a block that contains at least a given share of its different words.

Of the texts only the words of the templates are kept, with their places; all
others can't add to an overlap.  These are counted over all documents, which
puts them in one global order, rarest first.  A block and a template that share
enough words must share one of the rarest of each (prefix filter); the block must
hold enough words at all (length filter); and from the first shared word on both
must have enough words left (positional filter).  Blocks are joined with the
index of template prefixes on the word under these filters, and what is left is
compared word for word.  The templates and their words are a table of fixed
size; text is read once and never shuffled.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Words of a block, and words from one block's beginning to the next one's.
WIDTH, STEP = 64, 32
#: Share of a template's different words that a block must contain.
CONTAINED = 0.8
#: Phrases of the base labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Labels with sentences of the published license texts.
TEMPLATES = [
    ("agpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU Affero General Public License network server source"),
    ("apache", "Licensed under the Apache License Version 2.0 you may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS without warranties or conditions of any kind"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License If a copy was not distributed with this file you can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and of what isn't ASCII, A-Z lowered; null has none."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, _BREAKS), "")


def template_words(sentence: str) -> list[str]:
    """The different words of a template, by the same rule."""
    return sorted(set(filter(None, "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in sentence).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).split(" "))))


class Scan:
    """The template words of ``docs(doc_id, text)`` with their places, stored: (row, doc_id, n_words, hits).

    ``templates`` are (label, sentence) pairs and ``phrases`` (phrase, label)
    pairs.  Null text is empty and has no words; repeated rows and null ids have
    rows of their own; other columns are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, contained: float = CONTAINED):
        self.templates = [(label, words, math.ceil(contained * len(words) - 1e-9)) for label, sentence in templates if (words := template_words(sentence))]
        self.phrases = [(phrase.split(" "), label) for phrase, label in phrases]
        known = sorted({w for _, words, _ in self.templates for w in words} | {w for words, _ in self.phrases for w in words})
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words_of(F.col("text")).alias("words"))
        places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda s: s["word"].isin(*known))
        self.table = stored(rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), places.alias("hits")), "license-words")

    def ranks(self) -> dict[str, int]:
        """The place of every template word in the global order, rarest first, by the number of documents that have it; words that none has aren't there."""
        each = self.table.select(F.explode(F.array_distinct("hits.word")).alias("word"))
        counted = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "word").collect()  # the templates' words at most
        return {r.word: i for i, r in enumerate(counted)}

    def blocks(self) -> DataFrame:
        """(row, block, template, label, overlap, contained): every block that contains enough of a template; template is its place in the list."""
        spark, ranks = self.table.sparkSession, self.ranks()
        absent = len(ranks)
        index, whole = [], []
        for t, (label, words, need) in enumerate(self.templates):
            order = sorted((ranks.get(w, absent), w) for w in words)
            have = [r for r, _ in order if r < absent]
            if len(have) < need:
                continue  # no document has enough of its words
            # words that no document has are rarer than all others and stand before them
            missing, prefix = len(order) - len(have), len(order) - need + 1
            whole.append((t, label, len(order), have))
            index += [(r, t, missing + i, len(order), need) for i, r in enumerate(have) if missing + i < prefix]
        index_table = spark.createDataFrame(index, "rank int, template int, i int, size int, need int")
        first = sorted({w for w, r in ranks.items() if r in {x[0] for x in index}})
        of_words = spark.createDataFrame(sorted(ranks.items()), "word string, rank int")
        may = self.table.where(F.exists("hits", lambda h: h["word"].isin(*first)) if first else F.lit(False))
        places = may.select("row", F.explode("hits").alias("h")).select("row", F.col("h.word").alias("word"), F.floor(F.col("h.pos") / STEP).cast("int").alias("at"))
        within = places.select("row", "word", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - (WIDTH // STEP - 1)), F.col("at"))).alias("block"))
        sets = within.join(F.broadcast(of_words), "word").groupBy("row", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))
        n = F.size("held")
        probes = sets.select("row", "block", "held", F.posexplode("held").alias("j", "rank")).join(F.broadcast(index_table), "rank")
        met = probes.where((n >= F.col("need")) & (F.col("j") <= n - F.col("need")) & (F.least(F.col("size") - F.col("i"), n - F.col("j")) >= F.col("need")))
        pairs = met.groupBy("row", "block", "template").agg(F.first("held").alias("held"), F.first("need").alias("need"))
        texts = spark.createDataFrame(whole, "template int, label string, size int, ranks array<int>")
        compared = pairs.join(F.broadcast(texts), "template").withColumn("overlap", F.size(F.array_intersect("held", "ranks"))).where("overlap >= need")
        return compared.select("row", "block", "template", "label", "overlap", (F.col("overlap") / F.col("size")).alias("contained"))

    def phrase_places(self) -> Column:
        """Of ``hits`` the places where a phrase's words stand consecutively, as structs of the first word's place and the label."""

        def ends(h: Column, i: Column) -> Column:
            found = F.lit(None).cast("struct<start:long,label:string>")
            for words, label in self.phrases:
                n = len(words)
                before = lambda k: F.get(F.col("hits"), i - k)
                all_there = h["word"] == words[-1]
                for k in range(1, n):
                    all_there = all_there & F.coalesce((before(k)["word"] == words[-1 - k]) & (before(k)["pos"] == h["pos"] - k), F.lit(False))
                found = F.when(all_there, F.struct((h["pos"] - (n - 1)).cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(found)
            return found

        return F.filter(F.transform("hits", ends), lambda x: x.isNotNull())


def licenses(docs: DataFrame, scan: Scan | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs(doc_id, text)``.

    Base places are those of the phrases; ``labels`` has the labels of templates
    that a block contains beside theirs, both distinct, sorted and joined by
    commas.  The score is 1 with a base place, else the largest share of a
    template that matches, else 0.  Nulls, empty and long texts and repeated
    rows as ``Scan`` says: null and empty texts have no words, no places, empty
    labels and a score of 0.  An empty table gives no rows.
    """
    made = scan or Scan(docs)
    found = made.blocks().groupBy("row").agg(F.collect_set("label").alias("more"), F.max("contained").alias("best"))
    base = made.table.select("row", "doc_id", "n_words", made.phrase_places().alias("places"))
    joined = base.join(found, "row", "left")
    starts, of = F.col("places.start"), F.array_distinct("places.label")
    result = joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(of), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(of, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
    if scan is None:
        result = stored(result, "licenses")
        discard(made.table)
    return result
