"""Personal data by weak supervision.

One pass over whole texts finds the base matches of each kind by pattern and
wider candidates (phones without a country code, spelled-out addresses, secrets).
Every span gets the votes of regex, gazetteer and context labelers, and a
pattern: its kind, the votes, coarse features of its characters and what stands
beside it, of which no labeler knows.  Patterns are bounded by their make-up, so
their counts over all documents fit on the driver: expectation maximisation
estimates each labeler's reliability from the votes, and a logistic classifier
of spans is fitted to the resulting probabilities.  It sees no votes but those
of ``check``, so it judges a span by its form and surroundings, as what they tell
of the truth elsewhere, and not by repeating the vote.  A candidate is a span
where both say so; those that failed the check of a base kind are candidates
too, and base matches always are spans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, stored
from .labels import sigmoid

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("check", "gazetteer", "context", "variety", "border")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits, so looking behind spares long runs a second scan
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WIDE_PHONE = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_WIDE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63})+")
_NAMED = re.compile(r"(?i:api[_-]?key|token|secret|passw(?:or)?d|pwd)\"? ?[:=] ?[\"']?([^\s\"',;]{6,200})")
_KNOWN = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|sk-[A-Za-z0-9]{16,255})\b")
_LONG = re.compile(r"\b[0-9a-f]{32,128}\b")
_COUNTRY = re.compile(r"\+[1-9][0-9]{0,2}[ .-]?\Z")
#: Endings of domains.
_ENDS = frozenset("com org net edu gov mil int info biz name pro io ai app dev co me tv cc eu at au be br ca ch cl cn cz de dk es fi fr gr hk hu ie il in it jp kr lu mx nl no nz pl pt ro ru se sg sk tr tw ua uk us za online site shop blog cloud email tech xyz".split())
#: Calling codes of one and two digits; those of three begin with two digits of the second list.
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_CALLING_3 = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: First and last beginning of the numbers of card networks, and their lengths.
_NETWORKS = [("34", "34", {15}), ("37", "37", {15}), ("36", "36", {14}), ("38", "39", {14}), ("300", "305", {14}), ("3528", "3589", {16}), ("4", "4", {13, 16, 19}), ("51", "55", {16}), ("2221", "2720", {16}), ("6011", "6011", {16, 19}), ("644", "649", {16, 19}), ("65", "65", {16, 19}), ("62", "62", {16, 17, 18, 19}), ("50", "50", {12, 13, 14, 15, 16, 17, 18, 19}), ("56", "58", {12, 13, 14, 15, 16, 17, 18, 19})]
_FOR = {
    "email": frozenset("mail email contact write reach".split()),
    "ip": frozenset("ip host server address from".split()),
    "card": frozenset("card visa mastercard credit amex".split()),
    "phone": frozenset("phone tel call fax mobile telephone".split()),
    "secret": frozenset("token password key secret login".split()),
}
_AGAINST = frozenset("version isbn doi page section chapter sha commit checksum revision".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _network(digits: str) -> bool:
    """Whether a card network gives out such numbers."""
    return any(first <= digits[: len(first)] <= last and len(digits) in sizes for first, last, sizes in _NETWORKS)


def _calling(digits: str) -> bool:
    """Whether a number begins with the calling code of a country."""
    return digits[:1] in _CALLING or digits[:2] in _CALLING or digits[:2] in _CALLING_3


def _routed(shown: str) -> int:
    """1 for an address that a host on the network may have, 0 for one of a private net, -1 for one that no host has."""
    a, b = (int(x.lstrip("0")[:4] or "0") for x in shown.split(".")[:2])
    if a in (0, 127) or a >= 224 or (a, b) == (169, 254):
        return -1
    return 0 if a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32) else 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_ip(shown: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in shown.split("."))


Span = tuple[str, int, int]
#: Of candidates in the same place the one found in the surest way stays.
_RANK = ("known", "named", "wide", "long", "weak")


def _scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base matches, and what looks like a base kind and fails its check: evidence of what isn't personal data."""
    out, weak = [], []
    done, i = 0, text.find("@")
    while i >= 0:
        before = text[done:i]
        n = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, i + 1) if n else None
        if m:
            out.append(("email", i - n, m.end()))
        done = m.end() if m else i + 1
        i = text.find("@", done)
    for m in _IP.finditer(text):
        (out if _is_ip(m[0]) else weak).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 8:
            (out if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d) else weak).append(("card", *m.span()))
    i = text.find("+")
    while i >= 0:
        m = _PHONE.match(text, i)
        if m and 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
        i = text.find("+", m.end() if m else i + 1)
    return out, weak


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base matches, leftmost and without overlap within a kind."""
    return _scan(text)[0]


def _wide(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Candidates beyond the base kinds; a pattern is tried only where its words are in the text."""
    for m in _WIDE_PHONE.finditer(text):
        if not (m.start() and (text[m.start() - 1] in "+(.-_" or text[m.start() - 1].isalnum())):
            yield "phone", *m.span(), "wide"
    if "dot" in text and ("[at]" in text or "(at)" in text or " at " in text):
        for m in _WIDE_EMAIL.finditer(text):
            yield "email", *m.span(), "wide"
    small = text.lower()
    if any(w in small for w in ("token", "secret", "passw", "pwd", "api")):
        for m in _NAMED.finditer(text):
            yield "secret", *m.span(1), "named"
    if "AKIA" in text or "sk-" in text or "gh" in text and "_" in text:
        for m in _KNOWN.finditer(text):
            yield "secret", *m.span(), "known"
    for m in _LONG.finditer(text):
        yield "secret", *m.span(), "long"


def wide_spans(text: str, base: list[Span], weak: list[Span]) -> list[tuple[str, int, int, str]]:
    """Candidates (kind, start, end, how) that overlap no base match, or hold it wholly and more."""
    found = [*_wide(text), *((*s, "weak") for s in weak)]
    return _clear(found, base) if found else found


def _clear(found: list[tuple[str, int, int, str]], base: list[Span]) -> list[tuple[str, int, int, str]]:
    taken, out, j = sorted((a, b) for _, a, b in base), [], 0
    for kind, a, b, how in sorted(found, key=lambda s: (s[1], s[2], s[0], _RANK.index(s[3]))):
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        if not any(x < b and y > a and not (a <= x and y <= b and b - a > y - x) for x, y in taken[j : j + 4]) and not (out and out[-1][:3] == (kind, a, b)):
            out.append((kind, a, b, how))
    return out


def votes(text: str, kind: str, start: int, end: int, how: str) -> tuple[int, ...]:
    """1 for, -1 against, 0 silent, of each labeler.

    ``check`` is what the pattern itself verifies (digits, Luhn, ranges, a known
    prefix): a candidate that failed the check of a base kind has one vote
    against it, no more; names and bare long strings verify nothing.
    """
    span = text[start:end]
    ahead = re.findall(r"[A-Za-z]+", text[max(0, start - 40) : start].lower())[-3:]
    mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
    check = 1 if how in ("base", "known") or how == "named" and mixed and len(span) >= 12 else -1 if how == "weak" else 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[.\s\])]", span)[-1].lower() in _ENDS else 0
    elif kind == "ip":
        gazetteer = _routed(span)
    elif kind == "card":
        gazetteer = 1 if _network(_digits(span)) else -1
    elif kind == "phone":
        if span[0] == "+":
            gazetteer = 1 if _calling(_digits(span)) else -1
        else:
            gazetteer = 1 if _COUNTRY.search(text, max(0, start - 8), start) else -1 if _digits(span)[0] in "01" else 0
    else:
        gazetteer = 1 if how in ("known", "named") else 0
    context = 1 if not _FOR[kind].isdisjoint(ahead) else -1 if not _AGAINST.isdisjoint(ahead) else 0
    kinds = len(set(span))
    variety = -1 if kinds <= 3 else 1 if kinds >= 6 else 0
    border = -1 if (start and (text[start - 1].isalnum())) or (end < len(text) and text[end].isalnum()) else 1
    return check, gazetteer, context, variety, border


#: Buckets of the word before a span, and what may stand beside one: nothing, a blank, an opening or closing mark, a sign of naming, a letter or digit, anything else.
WORDS = 32
_BESIDE = {**dict.fromkeys(" \t\r\n", 1), **dict.fromkeys("([{<\"'", 2), **dict.fromkeys(")]}>.,;!?", 3), **dict.fromkeys(":=@/", 4)}


def _beside(c: str) -> int:
    return 0 if not c else _BESIDE.get(c, 5 if c.isalnum() else 6)


def _pattern(text: str, kind: str, start: int, end: int, how: str) -> str:
    span = text[start:end]
    n = len(span)
    tenth = lambda k: min(3, 4 * k // n)
    coarse = (min(6, int(math.log2(n))), tenth(sum(c.isdigit() for c in span)), tenth(sum(c.isupper() for c in span)))
    # changes between letters, digits and marks along the span
    sort = [0 if c.isdigit() else 1 if c.isalpha() else 2 for c in span[:64]]
    changes = sum(a != b for a, b in zip(sort, sort[1:], strict=False))
    word = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-1:]
    around = (min(7, changes), _beside(text[start - 1 : start] if start else ""), _beside(text[end : end + 1]), 1 + zlib.crc32(word[0].encode()) % WORDS if word else 0)
    return f"{KINDS.index(kind)};" + ";".join(",".join(map(str, x)) for x in (votes(text, kind, start, end, how), coarse, around))


#: Spans that the belief in labelers is worth.
BELIEF = 4.0
#: Spans that a weight of the classifier is worth.
PENALTY = 0.5

SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,pattern:string>>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())])


def spans_of(text: str) -> list[dict]:
    """Every base match and candidate of a text, sorted."""
    base, weak = _scan(text)
    every = [(*s, "base") for s in base] + wide_spans(text, base, weak)
    return sorted(({"start": a, "kind": KINDS.index(k), "end": b, "base": how == "base", "pattern": _pattern(text, k, a, b, how)} for k, a, b, how in every), key=lambda s: (s["start"], s["kind"], s["end"]))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for every row of ``docs(doc_id, text)``: its spans with their patterns.

    Null and empty texts have none; repeated rows and null doc_ids stay rows of
    their own; texts of any length are scanned whole; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([spans_of(t.as_py()) for t in batch["text"]], pa.list_(_SPAN))], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).transform(in_arrow, run, f"doc_id long, found {SPANS}")


def reliabilities(ballots: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation over vote patterns (rows of -1, 0, 1) with their counts.

    Gives each pattern's probability of being true, each labeler's votes under
    both truths (labeler, truth, vote) where it isn't silent, and the prior.
    Whether a labeler is silent tells nothing of the truth: its share stays 1.
    """
    truth = np.clip(0.5 + 0.5 * ballots.sum(axis=1) / max(1, ballots.shape[1]), 0.05, 0.95)
    tables, prior = np.ones((ballots.shape[1], 2, 3)), 0.5
    # a belief worth a few spans that labelers are right more often than wrong names the two truths; the counts soon outweigh it
    belief = BELIEF * np.array([[0.8, 0.0, 0.2], [0.2, 0.0, 0.8]])
    for _ in range(rounds):
        weight = np.stack([(1 - truth) * counts, truth * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for j in range(ballots.shape[1]):
            for v in (0, 2):
                tables[j, :, v] = weight[:, ballots[:, j] == v - 1].sum(axis=1) + belief[:, v]
        tables[:, :, ::2] /= tables[:, :, ::2].sum(axis=2, keepdims=True)
        like = sum(np.log(tables[j][:, ballots[:, j] + 1]) for j in range(ballots.shape[1])) + np.log([[1 - prior], [prior]])
        new = sigmoid(like[1] - like[0])
        if np.abs(new - truth).max() < 1e-9:
            break
        truth = new
    return truth, tables, prior


def judged(counted: dict[str, int]) -> dict[str, tuple[float, float]]:
    """Of each pattern the probability by expectation maximisation, and that by the classifier of form and surroundings fitted to it."""
    if not counted:
        return {}
    names = sorted(counted)
    counts = np.array([counted[p] for p in names], float)
    parts = [[list(map(int, x.split(","))) for x in p.split(";")] for p in names]
    ballots = np.array([p[1] for p in parts])
    truth, _, _ = reliabilities(ballots, counts)
    kinds, checks = range(len(KINDS)), (-1, 1)
    one = [(0, 0, k) for k in kinds] + [(1, 0, v) for v in checks] + [(2, j, v) for j in range(3) for v in range(7)] + [(3, j, v) for j in range(3) for v in range(8)] + [(3, 3, v) for v in range(WORDS + 1)]
    x = np.array([[float(p[a][b] == v) for a, b, v in one] + [1.0] for p in parts])
    # a weight of its own for each feature costs as much as PENALTY spans that speak against it
    w, penalty = np.zeros(x.shape[1]), PENALTY / counts.sum()
    weight = counts / counts.sum()
    for _ in range(100):
        q = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (weight * (q - truth)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, zip(truth.tolist(), sigmoid(x @ w).tolist(), strict=True), strict=True))


def classify(counted: dict[str, int]) -> dict[str, float]:
    """Probability of each pattern: the smaller one of that of the votes and that of the classifier of form and surroundings."""
    return {p: min(both) for p, both in judged(counted).items()}


def fit(found: DataFrame) -> dict[str, float]:
    """The classifier over patterns; their number is bounded by their make-up, not by the corpus."""
    rows = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    return classify({r.pattern: r.n for r in rows})


def _accepted(model: dict[str, float], threshold: float) -> list[str]:
    """Patterns whose spans the classifier takes."""
    return sorted(p for p, v in model.items() if v >= threshold)


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of ``docs(doc_id, text)``.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and
    then kind; base_sha256 is of the base matches alone, listed likewise.  Null
    and empty texts have none; rows that repeat a doc_id, and null doc_ids, stay
    rows of their own; other columns are ignored.
    """
    found = stored(find_spans(docs), "spans")
    accepted = _accepted(fit(found), threshold)
    names = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    kept = F.filter("found", lambda s: s["base"] | s["pattern"].isin(accepted)) if accepted else base
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(shown(base), 256).alias("base_sha256"), shown(kept).alias("spans"), (F.size(kept) - F.size(base)).cast("long").alias("n_added"))


def redacted(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; ``n_chars``, where there is one, follows.

    Overlapping spans are replaced as one, under the kind of the first.  Texts
    without spans, null ones among them, and all other columns stay as they are.
    Texts are scanned once: the rows are stored with the spans that were found.
    """
    own = "spans of row"
    while own in docs.columns:
        own += " again"
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[] if t is None else spans_of(t) for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(_SPAN))], names=[*batch.schema.names, own])

    rows = stored(docs.transform(in_arrow, scan, T.StructType([*kind.fields, T.StructField(own, T._parse_datatype_string(SPANS))])), "spans", "zstd")
    accepted = frozenset(_accepted(fit(rows.select(F.col(f"`{own}`").alias("found"))), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, columns = batch.column(at).to_pylist(), list(batch.columns[:-1])
            texts = [t if not spans else cleared(t, spans, accepted) for t, spans in zip(before, batch.columns[-1].to_pylist(), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                columns[size] = pa.array([n if t is None or t == b else len(t) for n, t, b in zip(columns[size].to_pylist(), texts, before, strict=True)], columns[size].type)
            yield pa.record_batch(columns, names=batch.schema.names[:-1])

    return rows.transform(in_arrow, run, kind)


def redact(text: str, accepted: frozenset[str]) -> str:
    """A text whose accepted spans are replaced."""
    return cleared(text, spans_of(text), accepted)


def cleared(text: str, spans: list[dict], accepted: frozenset[str]) -> str:
    """A text whose accepted ones of the given spans are replaced."""
    out, done = [], 0
    for s in spans:
        if not (s["base"] or s["pattern"] in accepted) or s["start"] < done and s["end"] <= done:
            continue
        if s["start"] >= done:
            out += [text[done : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])
