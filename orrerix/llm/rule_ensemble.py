"""Document quality by a sparse ensemble of rules.

Small decision trees on statistics of a text give their paths as conjunctive
rules; a lasso logistic fit keeps few of them; the score is a Spark column over
the statistics, so only the statistics need Python.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, in_arrow
from .labels import sigmoid, training_rows

TRAINING_ROWS = 6000
TREES, DEPTH, LASSO = 60, 3, 2e-3
STATISTICS = (
    "n_chars", "n_words", "word_chars", "upper", "digit", "mark", "stop", "comma", "bang", "bar", "other_mark", "line_end", "high",
    "marked_words", "capital_words", "distinct_words", "top_word", "repeated_next", "distinct_lines", "short_lines", "line_words", "distinct_pairs", "longest_word",
)


def _class(chars: bytes) -> np.ndarray:
    own = np.zeros(256, bool)
    own[list(chars)] = True
    return own


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_MARK = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_PLAIN_MARKS = _class(b".,!?;:'\"()-|")
_SPACE = _class(b" \t\n\r\x0b\x0c")


def statistics(text: str) -> tuple[float, ...]:
    """The numbers that rules test, in the order of STATISTICS; all zero for a text without words."""
    raw = text.encode()
    ws = raw.split()
    if not ws:
        return (0.0,) * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(ws)
    of = lambda mask: count[mask].sum() / n
    many = Counter(ws)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = b"".join(w[-1:] for w in ws)
    starts = b"".join(w[:1] for w in ws)
    return (
        float(np.log1p(n)), float(np.log1p(k)), (n - count[_SPACE].sum()) / k, of(_UPPER), of(_DIGIT), of(_MARK), count[46] / k, count[44] / k, count[33] / k, count[124] / k,
        of(_MARK & ~_PLAIN_MARKS), count[10] / k, count[128:].sum() / n,
        sum(map(ends.count, (b"*", b"#", b"%", b"&", b"$", b"!", b"|"))) / k,
        int(_UPPER[np.frombuffer(starts, np.uint8)].sum()) / k, len(many) / k ** 0.9, max(many.values()) / k,
        sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / k,
        len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), float(np.log1p(k / len(lines))),
        len(set(zip(ws, ws[1:], strict=False))) / max(1, k - 1), float(max(map(len, ws))),
    )


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is it above, limit) must hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, j] > t) == above for j, above, t in self.terms])

    def column(self, names: list[str]) -> Column:
        made = None
        for j, above, t in self.terms:
            one = F.col(names[j]) > F.lit(t) if above else F.col(names[j]) <= F.lit(t)
            made = one if made is None else made & one
        return made


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, names: list[str]) -> Column:
        """The score between 0 and 1 as one column expression."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(names), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, terms: tuple = ()) -> list[Rule]:
    """The rules of a tree grown on Gini impurity with a random half of the statistics at each node: every path from the root."""
    own = [Rule(terms)] if terms else []
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return own
    best = (1e-9, None)
    total, n = y.sum(), len(y)
    base = total * (n - total) / n
    for j in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 2)]:
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        left, k = ones[at], at + 1
        right = total - left
        gain = base - left * (k - left) / k - right * (n - k - right) / (n - k)
        gain[(k < 4) | (n - k < 4)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (gain[i], (int(j), float((v[at[i]] + v[at[i] + 1]) / 2)))
    if best[1] is None:
        return own
    j, t = best[1]
    above = x[:, j] > t
    for side in (False, True):
        keep = above == side
        own += _paths(x[keep], y[keep], depth - 1, rng, (*terms, (j, side, t)))
    return own


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal gradients; the intercept is free."""
    step = 4 / max(1e-9, np.linalg.norm(np.hstack([x, np.ones((len(x), 1))]), 2) ** 2 / len(x))
    w, b, v, c, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 1.0
    for _ in range(rounds):
        r = (sigmoid(x @ v + c) - y) / len(y)
        z = v - step * (x.T @ r)
        new, nb = np.sign(z) * np.maximum(np.abs(z) - step * penalty, 0), c - step * r.sum()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return w, b


def train(rows: list[tuple[str, int]], trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO, seed: int = 7) -> Ensemble:
    """Fit on (text, label) rows; with one class only, or none, the score is the share of label 1 (1 without labels)."""
    x, y = np.array([statistics(t) for t, _ in rows]).reshape(-1, len(STATISTICS)), np.array([v for _, v in rows], float)
    if not len(y) or y.min() == y.max():
        return Ensemble((), (), 30.0 if not len(y) or y.min() else -30.0)
    rng, found = np.random.default_rng(seed), {}
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y == 0).sum()))
    for _ in range(trees):
        drawn = rng.choice(len(y), len(y), p=weight / weight.sum())  # a bootstrap in which both classes weigh the same
        for rule in _paths(x[drawn], y[drawn], depth, rng):
            found.setdefault(rule.holds(x).tobytes(), rule)
    rules = [r for r in found.values() if 0 < r.holds(x).mean() < 1]
    w, b = _lasso(np.stack([r.holds(x) for r in rules], 1).astype(float), y, penalty)
    kept = np.flatnonzero(w)
    return Ensemble(tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), float(b))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most: int = TRAINING_ROWS) -> Ensemble:
    return train(training_rows(docs, labels, "quality", modulus, held_out, most))


def with_quality(docs: DataFrame, model: Ensemble, score: str = "score", threshold: float = 0.5, predicted: str = "predicted") -> DataFrame:
    """All columns of ``docs``, which must have ``text``, with a score and whether it reaches the threshold (1 or 0).

    Null text is empty and has zero statistics, as any text without words;
    repeated rows are scored each; columns of other names pass through unchanged,
    ones named as the two new ones are replaced.
    """
    base = docs.drop(score, predicted)
    at = base.columns.index("text")
    names, tag = [f"statistic {s}" for s in STATISTICS], "statistic"
    while any(c.startswith(f"{tag} ") for c in base.columns):
        tag += "_"
        names = [f"{tag} {s}" for s in STATISTICS]
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([statistics(t.as_py() or "") for t in batch.column(at)], float)
        return pa.record_batch([*batch.columns, *(pa.array(made[:, k]) for k in range(made.shape[1]))], names=[*batch.schema.names, *names])

    quoted = [f"`{n}`" for n in names]
    return base.transform(in_arrow, by_batch(run), schema).withColumn(score, model.column(quoted)).withColumn(predicted, (F.col(score) >= threshold).cast("int")).drop(*names)
