"""Document scores by masked pseudo-likelihood of a bidirectional window network.

The network predicts each token from the tokens on both sides of it, never from
the token itself: a sum of one embedding for each neighbour and its offset, a
tanh, and a softmax in two steps (class, then member).  A document's score is
the sum of the log-probabilities of all its tokens.

The most frequent words of the corpus have an id of their own; other words share
buckets by their ending.  Such a word has the probability of its bucket times
that of its spelling in the bucket: of the ending among the bucket's endings, and
of the letters before it by a model of letter triples from right to left.  Both
are counted over all words without an id, so no two words need to score alike
and rubbish scores as rubbish.

Word counts over all documents give the vocabulary and the spelling.  The texts
are then encoded once, two bytes for a token, and training and scoring read that
table.  Training visits every position of every document once: the first round
takes one position in SHARE and gives all tasks a common start, the second round
takes all others.  A task runs stochastic gradients in numpy and hands its
weights over in blocks, which are averaged in a shuffle by the positions behind
them.  Network and spelling have a fixed size, so that is all that reaches the
driver or is broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_arrow, partitions, stored, text_or_empty

#: Frequent words with an id of their own, buckets of the others by their ending, and classes of the softmax (of as many members each).
WORDS, BUCKETS, CLASSES = 3072, 1024, 64
VOCABULARY, MEMBERS = WORDS + BUCKETS, (WORDS + BUCKETS) // CLASSES
OFFSETS = (-2, -1, 1, 2)
WIDTH = 16
#: The first of two rounds trains on one position in SHARE, the second on all others.
SHARE, ROUNDS = 8, 2
#: Step of the output layer; neighbours' embeddings take half of it.
STEP, MINIBATCH = 0.1, 8192
#: Floats in a block of weights or counts.
BLOCK = 4096
#: Distinct words that a task counts before it hands them over, and that a worker remembers.
COUNTED, MEMO_WORDS = 600_000, 600_000
#: Positions that are scored, and tokens that are encoded at once.
TOGETHER = 1 << 13
#: Symbols of a spelling, of which 0 ends a word.
SYMBOLS, SMOOTH = 64, 0.1


def words(text: str) -> list[str]:
    return text.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all of ``docs(text)``; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words(text.as_py()))
                if len(held) > COUNTED:
                    yield made(held)
                    held.clear()
        if held:
            yield made(held)

    def made(held: Counter[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    return docs.select(text_or_empty()).transform(in_arrow, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = WORDS) -> list[str]:
    """The most frequent words, ties by the word."""
    return frequent(count_words(docs), size)


def frequent(counted: DataFrame, size: int = WORDS) -> list[str]:
    """The ``size`` words of ``counted(word, n)`` with the largest counts, ties by the word.

    The least count that makes it is found from two histograms (of the counts'
    sizes, then of the counts of one size), so that little more than the chosen
    words reaches the driver, however many partitions there are.
    """
    if not size:
        return []
    above, scale = 0, F.floor(F.log2("n") * 64)
    steps = sorted(counted.groupBy(scale.alias("at")).agg(F.count(F.lit(1)).alias("many")).collect(), reverse=True)  # some thousand rows
    least = None
    for at, many in steps:
        if above + many >= size:
            for n, own in sorted(counted.where(scale == at).groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect(), reverse=True):
                if above + own >= size:
                    least = n
                    break
                above += own
            break
        above += many
    chosen = [(r.n, r.word) for r in counted.where(F.col("n") > (least or 0)).collect()]
    if least is not None:
        chosen += [(least, r.word) for r in counted.where(F.col("n") == least).orderBy("word").limit(size - above).select("word").collect()]
    return [w for _, w in sorted(chosen, key=lambda x: (-x[0], x[1]))]


# spelling


def _symbols() -> np.ndarray:
    """The symbol of each byte: letters, digits and common marks have one of their own, others share."""
    of = np.full(256, 47, np.uint8)  # other marks and control characters
    of[97:123], of[48:58] = np.arange(1, 27), np.arange(27, 37)
    for i, c in enumerate(b".,;:!?'\"-|"):
        of[c] = 37 + i
    of[128:192] = 48 + np.arange(64) % 12
    of[192:] = 60 + np.minimum(3, np.abs(np.arange(192, 256) - 195))
    return of


_SYMBOL = _symbols()
#: What is left to tell the byte by, once its symbol is known.
_WITHIN = -np.log(np.maximum(1, np.bincount(_SYMBOL, minlength=SYMBOLS))).astype(np.float32)


def _bytes(ws: list[str]) -> list[bytes]:
    return [w.encode() for w in ws]


def spelled(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words in UTF-8, which have a byte or more: where the triples of each begin, the triples (two symbols and the one before them), and the ending.

    Words are read from right to left and end with 0.  The ending is the last
    symbol and the one before it, which is 0 for a single byte.
    """
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    # each word backwards, between two zeros behind and none ahead: s1 s2 .. sn 0 0
    at = np.concatenate([[0], np.cumsum(sizes + 2)])
    s = np.zeros(at[-1], np.int64)
    back = _SYMBOL[np.frombuffer(b"".join(r[::-1] for r in raws), np.uint8)]
    place = np.arange(len(back)) + 2 * np.repeat(np.arange(len(raws)), sizes)
    s[place] = back
    first = at[:-1]
    ending = s[first] * SYMBOLS + s[first + 1]
    # triples start at s1: (s1 s2 -> s3) .. (s[n-1] sn -> 0); a single byte has none
    n = np.maximum(0, sizes - 1)
    begin = np.concatenate([[0], np.cumsum(n)])
    where = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(first, n)
    return begin, (s[where] * SYMBOLS + s[where + 1]) * SYMBOLS + s[where + 2], ending


def bucket_of(ending: np.ndarray) -> np.ndarray:
    return (ending * 40503 >> 4) % BUCKETS


@dataclass(frozen=True)
class Vocabulary:
    """Words with an id, and log-probabilities of the spelling of others: of endings in their bucket, and of triples."""

    known: tuple[str, ...]
    endings: bytes
    triples: bytes

    def log_spelling(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and log-probability in the bucket of each word."""
        raws = _bytes(ws)
        begin, triples, ending = spelled(raws)
        running = np.concatenate([[0.0], np.cumsum(np.frombuffer(self.triples, "<f4")[triples].astype(float))])
        within = np.concatenate([[0.0], np.cumsum(_WITHIN[_SYMBOL[np.frombuffer(b"".join(raws), np.uint8)]].astype(float))])
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        stop = np.cumsum(sizes)
        return bucket_of(ending), np.frombuffer(self.endings, "<f4")[ending] + running[begin[1:]] - running[begin[:-1]] + within[stop] - within[stop - sizes]


def learn_words(docs: DataFrame) -> Vocabulary:
    """The vocabulary of ``docs(text)`` and the spelling of all its other words, from counts over the whole corpus."""
    counted = stored(count_words(docs), "words")
    known = frequent(counted)
    shared = counted.sparkSession.sparkContext.broadcast(frozenset(known))  # at most WORDS words
    size = SYMBOLS**3 + SYMBOLS**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skip = np.zeros(size, np.int64), shared.value
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True) if w not in skip]
            if rows:
                begin, triples, ending = spelled(_bytes([w for w, _ in rows]))
                n = np.array([n for _, n in rows])
                np.add.at(held, triples, np.repeat(n, np.diff(begin)))
                np.add.at(held, SYMBOLS**3 + ending, n)
        if held.any():
            blocks = [held[a : a + BLOCK].astype("<i8").tobytes() for a in range(0, size, BLOCK)]
            yield pa.record_batch([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.ones(len(blocks), np.int64)), pa.array(blocks, pa.binary())], names=["block", "n", "packed"])

    found = _summed(counted.transform(in_arrow, run, "block int, n long, packed binary"), "<i8")
    discard(counted)
    counts = (np.concatenate([found[b] for b in sorted(found)]) if found else np.zeros(size)).astype(float)
    triples, endings = counts[: SYMBOLS**3].reshape(-1, SYMBOLS) + SMOOTH, counts[SYMBOLS**3 :] + SMOOTH
    buckets = bucket_of(np.arange(SYMBOLS**2))
    inside = endings / np.bincount(buckets, endings, minlength=BUCKETS)[buckets]
    return Vocabulary(tuple(known), np.log(inside).astype("<f4").tobytes(), np.log(triples / triples.sum(axis=1, keepdims=True)).astype("<f4").tobytes())


def _summed(handed: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Blocks of ``handed(block, n, packed)`` summed, each in a task of its own: one copy reaches the driver."""
    wide = np.int64 if kind == "<i8" else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for block, n, packed in zip(batch["block"].to_pylist(), batch["n"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                own = total.setdefault(block, [0, 0])
                part = np.frombuffer(packed, kind).astype(wide)
                own[0] += n
                own[1] = own[1] + (part if kind == "<i8" else n * part)
        if total:
            made = [(s if kind == "<i8" else (s / n).astype("<f4")).tobytes() for n, s in total.values()]
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(made, pa.binary())], names=["block", "packed"])

    dealt = handed.repartition(partitions(handed.sparkSession), "block").transform(in_arrow, add, "block int, packed binary")
    return {r.block: np.frombuffer(r.packed, kind if kind == "<i8" else "<f4") for r in dealt.collect()}  # one copy of what has a fixed size


class Encoder:
    """Ids of texts and the summed log-probability of the spelling of their words without an id; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._fresh()

    def _fresh(self) -> None:
        self.memo = _Memo({w: i for i, w in enumerate(self.vocabulary.known)})
        self.ids, self.logs = np.arange(len(self.vocabulary.known), dtype=np.int32), np.zeros(len(self.vocabulary.known))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        out: list[tuple[np.ndarray, float]] = []
        if len(self.memo) > MEMO_WORDS:
            self._fresh()
        split = [words(t) for t in texts]
        codes = [np.fromiter(map(self.memo.__getitem__, ws), np.int32, len(ws)) for ws in split]
        if self.memo.pending:
            bucket, log = self.vocabulary.log_spelling(self.memo.pending)
            self.ids, self.logs = np.concatenate([self.ids, (WORDS + bucket).astype(np.int32)]), np.concatenate([self.logs, log])
            self.memo.pending.clear()
        for code in codes:
            out.append((self.ids[code], float(self.logs[code].sum())))
        return out


class _Memo(dict):
    """Word -> its place in the encoder's arrays; new words wait in ``pending``."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = made = len(self)
        self.pending.append(word)
        return made


@lru_cache(maxsize=1)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in a row of which all but a last one are short of so many characters together."""
    held, have = [], 0
    for t in texts:
        held.append(t)
        have += len(t)
        if have > 16 * TOGETHER:
            yield held
            held, have = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, spelling) for every row of ``docs(doc_id, text)``: two bytes for each token, and the log-probability of all spellings."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value)
        for batch in batches:
            made = [x for g in _groups(batch["text"].to_pylist()) for x in own.encode(g)]
            yield pa.record_batch([batch["doc_id"], pa.array([i.astype("<u2").tobytes() for i, _ in made], pa.binary()), pa.array([s for _, s in made], pa.float64())], names=["doc_id", "ids", "spelling"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).transform(in_arrow, run, "doc_id long, ids binary, spelling double")


# network

SHAPES = {"near": (len(OFFSETS), VOCABULARY + 1, WIDTH), "bias": (WIDTH,), "klass": (WIDTH, CLASSES), "klass_bias": (CLASSES,), "member": (CLASSES, WIDTH, MEMBERS), "member_bias": (CLASSES, MEMBERS)}


@dataclass
class Network:
    """Weights; token VOCABULARY stands for what lies beyond a document's ends."""

    near: np.ndarray
    bias: np.ndarray
    klass: np.ndarray
    klass_bias: np.ndarray
    member: np.ndarray
    member_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        return cls(**{n: (rng.normal(0, 0.1, s) if "bias" not in n else np.zeros(s)).astype(np.float32) for n, s in SHAPES.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        made, at = {}, 0
        for n, s in SHAPES.items():
            k = int(np.prod(s))
            made[n] = flat[at : at + k].reshape(s).astype(np.float32)
            at += k
        return cls(**made)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.near[0].take(around[:, 0], axis=0)
        for k in range(1, len(OFFSETS)):
            total += self.near[k].take(around[:, k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def _members(self, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Activations of the members of their class, of positions sorted by class."""
        z = np.empty((len(h), MEMBERS), np.float32)
        for c in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[c], cuts[c + 1])
            np.dot(h[own], self.member[c], out=z[own])
            z[own] += self.member_bias[c]
        return z

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        h = self.hidden(around)
        klass, member = np.divmod(token, MEMBERS)
        out = _log_softmax(h @ self.klass + self.klass_bias, klass)
        order, cuts = _by_class(klass)
        out[order] += _log_softmax(self._members(h.take(order, axis=0), cuts), member[order])
        return out

    def learn(self, around: np.ndarray, token: np.ndarray, step: float) -> None:
        """One gradient step on some positions; a weight moves by the sum of its gradients over the root of their number."""
        order, cuts = _by_class(token // MEMBERS)
        around, (klass, member), n = around.take(order, axis=0), np.divmod(token[order], MEMBERS), len(token)
        each, one = np.arange(n), np.ones(n, np.float32)
        h = self.hidden(around)
        g = _softmax(h @ self.klass + self.klass_bias)
        g[each, klass] -= 1
        back = g @ self.klass.T
        m = _softmax(self._members(h, cuts))
        m[each, member] -= 1
        for c in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[c], cuts[c + 1])
            back[own] += m[own] @ self.member[c].T
            scale = np.float32(step / (cuts[c + 1] - cuts[c]) ** 0.5)
            self.member[c] -= scale * (h[own].T @ m[own])
            self.member_bias[c] -= scale * (one[own] @ m[own])
        scale = np.float32(step / n**0.5)
        self.klass -= scale * (h.T @ g)
        self.klass_bias -= scale * (one @ g)
        back *= 1 - h * h
        self.bias -= np.float32(step / n) * (one @ back)
        for k in range(len(OFFSETS)):
            col = around[:, k].astype(np.int16)
            order = np.argsort(col, kind="stable")
            col = col[order]
            first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
            many = np.diff(np.concatenate([first, [n]]))
            self.near[k][col[first]] -= (step / 2 / many**0.5).astype(np.float32)[:, None] * np.add.reduceat(back.take(order, axis=0), first, axis=0)


def _by_class(klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.argsort(klass.astype(np.uint8), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(klass, minlength=CLASSES))])


def _exp(z: np.ndarray) -> np.ndarray:
    """Exponentials in place and their sums; activations beyond 60 either way, which trained weights never give, count as 60."""
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray) -> np.ndarray:
    total = _exp(z)
    z *= (1 / total)[:, None]
    return z


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = z[np.arange(len(z)), at]
    return np.clip(own, -60, 60) - np.log(_exp(z))


def around(ids: np.ndarray) -> np.ndarray:
    """The neighbours of every position of a document."""
    reach = max(map(abs, OFFSETS))
    padded = np.full(len(ids) + 2 * reach, VOCABULARY, np.int32)
    padded[reach : reach + len(ids)] = ids
    return np.stack([padded[reach + o : reach + o + len(ids)] for o in OFFSETS], axis=1)


def taught(ids: np.ndarray, turn: int) -> np.ndarray:
    """The positions of a document that a round trains on; the rounds share all of them out."""
    first = np.arange(len(ids)) % SHARE == zlib.crc32(ids.tobytes()) % SHARE
    return np.flatnonzero(first if turn == 0 else ~first)


def _train_round(rows: DataFrame, start: np.ndarray, turn: int) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(start.astype(np.float16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n, held, have = Network.of(shared.value.astype(np.float32)), 0, [], 0
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
        for batch in batches:
            for packed in batch["ids"]:
                own = np.frombuffer(packed.as_py(), "<u2").astype(np.int32)
                at = taught(own, turn)
                if len(at):
                    held.append((around(own)[at], own[at]))
                    have += len(at)
                if have >= 16 * MINIBATCH:
                    n += _learn(net, held, rng)
                    held, have = [], 0
        if held:
            n += _learn(net, held, rng)
        if n:
            flat = net.flat()
            blocks = [flat[a : a + BLOCK].astype("<f2").tobytes() for a in range(0, len(flat), BLOCK)]
            yield pa.record_batch([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), n)), pa.array(blocks, pa.binary())], names=["block", "n", "packed"])

    found = _summed(rows.select("ids").transform(in_arrow, run, "block int, n long, packed binary"), "<f2")
    shared.unpersist()
    return np.concatenate([found[b] for b in sorted(found)]) if found else start


def _learn(net: Network, held: list, rng: np.random.Generator) -> int:
    near, token = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
    order = rng.permutation(len(token))
    for a in range(0, len(order), MINIBATCH):
        net.learn(near[order[a : a + MINIBATCH]], token[order[a : a + MINIBATCH]], STEP)
    return len(token)


@dataclass(frozen=True)
class Model:
    """The words, the network, and the encoded texts that it was trained on (no part of the model)."""

    words: Vocabulary
    weights: bytes
    rows: DataFrame | None = field(default=None, compare=False, repr=False)

    @property
    def known(self) -> tuple[str, ...]:
        return self.words.known


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learn words, spelling and network from all of ``docs(doc_id, text)``; an empty table gives no words and the network's first weights."""
    learnt = learn_words(docs)
    rows = stored(encoded(docs, learnt), "encoded")
    flat = Network.fresh().flat()
    for turn in range(rounds):
        flat = _train_round(rows, flat, turn)
    return Model(learnt, flat.astype("<f4").tobytes(), rows)


@lru_cache(maxsize=1)
def _network(weights: bytes) -> Network:
    return Network.of(np.frombuffer(weights, "<f4"))


def _scores(net: Network, docs: list[np.ndarray]) -> list[float]:
    """Summed log-probability of the tokens of each document."""
    out, held, have = [], [], 0
    for k, own in enumerate(docs):
        held.append(own)
        have += len(own)
        if have >= TOGETHER or k == len(docs) - 1:
            near, token = np.concatenate([around(x) for x in held]), np.concatenate(held)
            log = np.concatenate([np.zeros(0), *(net.log_probabilities(near[a : a + TOGETHER], token[a : a + TOGETHER]) for a in range(0, len(token), TOGETHER))])
            sizes = np.array([len(x) for x in held])
            running, ends = np.concatenate([[0.0], np.cumsum(log)]), np.cumsum(sizes)
            out += (running[ends] - running[ends - sizes]).tolist()
            held, have = [], 0
    return out


def score_texts(model: Model, texts: list[str]) -> tuple[list[int], list[float]]:
    """Tokens and summed log-probability of each text."""
    made = [x for g in _groups(texts) for x in _encoder(model.words).encode(g)]
    return [len(i) for i, _ in made], [a + s for a, (_, s) in zip(_scores(_network(model.weights), [i for i, _ in made]), made, strict=True)]


def pseudo_likelihood(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_probability, score) for every row of ``docs(doc_id, text)``; score is the mean for a token.

    Without a model one is fitted to ``docs`` themselves, whose encoded texts are
    then read instead of encoding them again.  Null and empty texts have no
    tokens, log_probability 0 and score 0; texts of any length are scored whole;
    rows that repeat a doc_id, and null doc_ids, are scored each; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    if model is None:
        model = fit(docs)
        rows = model.rows
    else:
        rows = encoded(docs, model.words)
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _network(shared.value)
        for batch in batches:
            own = [np.frombuffer(x.as_py(), "<u2").astype(np.int32) for x in batch["ids"]]
            sums = np.array(_scores(net, own)) + batch["spelling"].to_numpy()
            yield pa.record_batch([batch["doc_id"], pa.array([len(x) for x in own], pa.int64()), pa.array(sums)], names=["doc_id", "n_tokens", "log_probability"])

    scored = rows.transform(in_arrow, run, "doc_id long, n_tokens long, log_probability double")
    return scored.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")).otherwise(0.0))
