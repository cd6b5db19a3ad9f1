"""Sets of bits of texts: the words of a text, each hashed to one of 2048 places."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 2048


def of_words(df: DataFrame, text: str, name: str = "bits") -> DataFrame:
    place = lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % BITS
    return df.withColumn(name, F.array_sort(F.array_distinct(F.transform(F.split(text, " "), place))))


def word_bits(text: str) -> list[int]:
    """The same of one text."""
    return sorted({int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % BITS for w in text.split(" ")})
