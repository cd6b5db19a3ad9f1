"""Toxicity by compression distance between two zstandard dictionaries.

The ordinary dictionary is trained by zstandard on all ordinary training texts,
whole.  The toxic one holds the words of toxic training texts whose beginnings
ordinary texts hardly use, before the same ordinary dictionary, so that both
explain ordinary words alike.  (A toxic dictionary that zstandard's trainer makes
of whole toxic texts is mostly ordinary words, as toxic texts are; README has the
figures of both.)  A window is one word between two fixed stretches of the
ordinary dictionary, since a bare word is too short for zstandard to compress;
its gain is the compressed length under the ordinary dictionary less that under
the toxic one.  The thresholds on gains are those that given shares of ordinary
words exceed, and the counts of a document's windows beyond them are calibrated
by a logistic fit, both on labelled documents that the dictionaries haven't seen.

A worker remembers the gain of a word, up to a bound; texts are scored whole, in
one pass over the documents, and only the two small dictionaries leave the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, in_arrow, text_or_empty
from .labels import logistic, sigmoid, training_rows

#: Labelled rows that the classifier learns from at most.
TRAINING_ROWS = 6000
#: Bytes of a word's beginnings by which the classes are contrasted, with the space before it; ends count as spaces.
STARTS = (5, 7, 9)
#: Least log ratio of the classes' document frequencies for a beginning to count as toxic.
LIFT = 4.0
ORDINARY_BYTES, NEGATIVE_BYTES, TOXIC_BYTES = 8192, 2048, 6144
#: Words of a sample, and bytes of a segment and of the pieces by which it is valued, when the ordinary dictionary is trained.
SAMPLE, SEGMENT, PIECE = 16, 64, 8
#: Shares of ordinary words that exceed the gains from which a document's windows are counted.
SHARES = (1e-3, 3e-4, 1e-4, 3e-5)
#: The least gain of an ordinary word that counts as a mistake of the dictionaries.
MISTAKE = 2
BEFORE, AFTER = slice(300, 348), slice(700, 712)
MEMO_WORDS = 300_000


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _starts(ws: Iterable[bytes]) -> set[bytes]:
    return {s for w in ws if len(w) >= 4 for s in _starts_of(w)}


def _starts_of(word: bytes) -> list[bytes]:
    padded = b" " + word + b" "
    return [padded[:n] for n in STARTS if n <= len(padded)]


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, chain_log=16, hash_log=15, search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    kind.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=kind, compression_params=how)


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; an empty toxic dictionary gives every text the prior."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    steps: tuple[int, ...] = (2, 3, 4, 5)

    @cached_property
    def gains(self) -> _Gains:
        return _Gains(self)

    def score(self, text: str) -> float:
        return float(sigmoid(np.dot(self.weights, [*self.features(text), 1.0])))

    def features(self, text: str) -> tuple[float, ...]:
        """Three largest gains of those from the first step on, logs of the numbers of gains from each step on, and of words; zeros without words."""
        ws = words(text)
        if not ws or not self.toxic:
            return (0.0,) * FEATURES
        memo = self.gains
        if len(memo) > MEMO_WORDS:
            memo.clear()
        got = sorted((g for g in map(memo.__getitem__, ws) if g >= self.steps[0]), reverse=True)
        most = [*got[:3], 0, 0, 0][:3]
        return *map(float, most), *(math.log1p(sum(g >= k for g in got)) for k in self.steps), math.log1p(len(ws))


FEATURES = 3 + len(SHARES) + 1


class _Gains(dict):
    """Word -> its gain."""

    def __init__(self, model: Model):
        super().__init__()
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic + model.ordinary)
        plain = model.ordinary[-ORDINARY_BYTES:]
        self.before, self.after = plain[BEFORE] + b" ", b" " + plain[AFTER].strip() + b" "

    def __missing__(self, word: bytes) -> int:
        window = self.before + word + self.after
        self[word] = gain = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return gain


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The bytes of the ordinary and the toxic dictionary.

    Words of ordinary text that a first pair of dictionaries takes for toxic go
    into the ordinary one, so that they gain nothing.
    """
    a, b = (Counter(s for t in texts for s in _starts(set(words(t)))) for texts in (toxic, ordinary))
    least = max(3, len(toxic) // 100)
    lift = lambda s: math.log((a[s] + 0.5) / (len(toxic) + 1)) - math.log((b[s] + 0.5) / (len(ordinary) + 1))
    marked = {s for s, n in a.items() if n >= least and lift(s) > LIFT}
    full = Counter(w for t in toxic for w in set(words(t)) if not marked.isdisjoint(_starts_of(w)))
    bad = b" " + _joined(reversed(_fitting(full, TOXIC_BYTES))) if full else b""
    plain = _trained(ordinary)
    if not bad:
        return plain, bad
    seen, negatives = Counter(w for t in ordinary for w in set(words(t))), Counter()
    for _ in range(2):
        gains = _Gains(Model(_joined(_fitting(negatives, NEGATIVE_BYTES)) + plain, bad, ()))
        negatives.update({w: n * g for w, n in seen.items() if n > 1 and (g := gains[w]) >= MISTAKE})
    return _joined(_fitting(negatives, NEGATIVE_BYTES)) + plain, bad


def _trained(texts: list[str]) -> bytes:
    """What zstandard's trainer takes from whole texts into ORDINARY_BYTES, without the tables ahead of it; of few texts their end."""
    samples = [b" ".join(ws[i : i + SAMPLE]) + b" " for ws in map(words, texts) for i in range(0, len(ws), SAMPLE)]
    try:
        made = zstandard.train_dictionary(ORDINARY_BYTES + TABLES, samples, k=SEGMENT, d=PIECE).as_bytes()
    except (zstandard.ZstdError, ValueError):  # the trainer wants more samples than that
        made = b"".join(samples)
    return made[-ORDINARY_BYTES:].rjust(ORDINARY_BYTES, b" ")


#: Bytes of tables that a trained dictionary begins with, at most.
TABLES = 300


def calibrated_steps(gains: Counter) -> tuple[int, ...]:
    """The least gains, each above the one before, that at most the given shares of ordinary words reach; gains are counted by how many words have them."""
    total, steps = sum(gains.values()), []
    for share in SHARES:
        step = steps[-1] + 1 if steps else 1
        while total and sum(n for g, n in gains.items() if g >= step) > share * total:
            step += 1
        steps.append(step)
    return tuple(steps)


def _fitting(ranked: Counter, room: int) -> list[bytes]:
    """The first words by rank that fit into so many bytes."""
    chosen = []
    for w, _ in sorted(ranked.items(), key=lambda x: (-x[1], x[0])):
        if len(w) + 1 <= room:
            chosen.append(w)
            room -= len(w) + 1
    return chosen


def _joined(ws: Iterable[bytes]) -> bytes:
    return b"".join(w + b" " for w in ws)


def train(rows: list[tuple[str, int]]) -> Model:
    """Fit on (text, label) rows: two thirds make the dictionaries, one third the calibration."""
    first, second = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    ordinary, toxic = dictionaries([t for t, y in first if y], [t for t, y in first if not y])
    y = np.array([y for _, y in second], float)
    prior = (y.sum() + 0.5) / (len(y) + 1) if rows else 0.0
    flat = (0.0,) * FEATURES + (math.log(prior / (1 - prior)) if prior else -35.0,)
    if not toxic or not 0 < y.sum() < len(y):
        return Model(ordinary, b"", flat)
    gains = Model(ordinary, toxic, flat).gains
    steps = calibrated_steps(Counter(gains[w] for t, label in second if not label for w in words(t)))
    draft = Model(ordinary, toxic, flat, steps)
    return Model(ordinary, toxic, tuple(logistic(np.array([draft.features(t) for t, _ in second]), y, ridge=0.1)), steps)


@lru_cache(maxsize=1)
def _in_worker(ordinary: bytes, toxic: bytes, weights: tuple[float, ...], steps: tuple[int, ...]) -> Model:
    return Model(ordinary, toxic, weights, steps)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, most: int = TRAINING_ROWS) -> Model:
    return train(training_rows(docs, labels, "toxic", modulus, held_out, most))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs(doc_id, text)``.

    Null text is empty; empty texts have no window and score by the intercept;
    texts of any length are scored whole; rows that repeat a doc_id, and null
    doc_ids, are scored each; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    parts = (model.ordinary, model.toxic, model.weights, model.steps)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _in_worker(*parts)
        return pa.record_batch([batch["doc_id"], pa.array([own.score(t.as_py()) for t in batch["text"]], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).transform(in_arrow, by_batch(run), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
