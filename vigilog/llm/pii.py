"""Personal data: overlapping candidate spans, boosted trees over their format and context, calibrated thresholds.

Four kinds: email, ip, card, phone. Strict patterns (leftmost, non-overlapping, checked) give the base spans, which
always stay. High-recall generators propose many overlapping spans: all short runs of number groups and everything
around an at sign. Trees score each candidate; they are fitted on the candidates of all documents with weak labels: true
are the finds of the strict patterns, and candidates whose format and context both speak for their kind ("tel 0044 20
7946 0958", "card" before a number with a right check digit). Candidates that only one of them, or a strict check, speaks
for are not used for fitting: they are what the trees are to decide. Half of the candidates, told by a hash of their
surroundings, fit the trees; the other half calibrates the least score of each kind at which nearly all accepted
candidates are true; a kind with few takes that of all kinds together. Accepted spans that touch neither a base span nor
a better candidate are added.

Candidates with the same features, label and half are one stored row with its count; trees and thresholds are made from
sums over these rows.
Rows are scanned where they are read; only the model (some kilobytes) is sent to the tasks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, packed, unpacked
from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: Share of true candidates among accepted ones that calibration asks for, and the fewest accepted ones it trusts.
PRECISION, LEAST_ACCEPTED = 0.99, 20
#: Thresholds are whole multiples of one part in this many; a power of two, so that they are exact.
SCORE_LEVELS = 1 << 16
#: Digits in one candidate.
MAX_DIGITS = 19
#: Candidates whose features are held at once.
BLOCK_CANDIDATES = 5_000
#: Words that announce each kind, up to 24 characters before it.
ANNOUNCED = [re.compile(rf"\b(?:{w})\b[^\n]{{0,12}}\Z", re.IGNORECASE) for w in (
    "e-?mail|mail|contact", "ip|host|server|addr(?:ess)?|ping", "card|visa|mastercard|amex|credit|debit|kreditkarte|carte|tarjeta",
    "tel(?:efon|ephone|éfono)?|phone|mobile|mobil|cell|fax|call|dial|sms|whatsapp",
)]
#: Telephone numbers as written inside a country, or with its prefix.
_NATIONAL = re.compile(r"\+.*|00[1-9].*|\(0?[0-9]{2,4}\)[ -]?[0-9]{3,4}[ -][0-9]{3,4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}", re.DOTALL)

Span = tuple[int, int, int]  # kind, start, end

_PERSONAL = re.compile("[@0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would also start at its first digit, so only those are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9]+(?:[\x20().+-]{1,3}[0-9]+)*")
_GROUP = re.compile("[0-9]+")
_AROUND_AT = re.compile(r"[^\s@<>\"'(),;]*@[^\s@<>\"'(),;]*")


def digits_of(s: str) -> str:
    return "".join(_GROUP.findall(s))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def valid_card(s: str) -> bool:
    number = digits_of(s)
    return 16 <= len(number) <= 19 and luhn(number)


def valid_phone(s: str) -> bool:
    return 8 <= len(digits_of(s)) <= 15


def base_spans(text: str) -> list[Span]:
    """The spans of the strict patterns, by kind and start."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for kind, pattern, valid in ((1, _IP, valid_ip), (2, _CARD, valid_card), (3, _PHONE, valid_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m[0])]
    return out


def candidates(text: str) -> Iterator[Span]:
    """Overlapping spans that could be personal data."""
    for m in _AROUND_AT.finditer(text) if "@" in text else ():
        start, end = m.start(), m.end()
        yield (0, start, end)
        shorter = len(m[0].rstrip(".!?:*#$%&-_"))
        if 0 < shorter < end - start:
            yield (0, start, start + shorter)
    for m in _NUMBERS.finditer(text):
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (start, _) in enumerate(groups):
            count = 0
            for j in range(i, len(groups)):
                a, end = groups[j]
                count += end - a
                if count > MAX_DIGITS:
                    break
                if j == i + 3 and count <= 12 and text.count(".", start, end) == 3:
                    yield (1, start, end)
                if count >= 12:
                    yield (2, start, end)
                if 7 <= count <= 15:
                    lead = text[max(0, start - 2) : start]
                    yield (3, start - (1 if lead[-1:] in ("+", "(") else 0) - (1 if lead == "+(" else 0), end)


def _letter(c: str) -> bool:
    return c.isalpha()


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s, before, after = text[start:end], text[max(0, start - 12) : start], text[end : end + 3]
    groups, number = _GROUP.findall(s), digits_of(s)
    left, right = before[-1:], after[:1]
    tail = s.rpartition("@")[2]
    return [
        kind, end - start, len(number), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count("."), s.count("-"), s.count(" "), s.count("("), s.startswith("+"), 13 <= len(number) <= 19 and luhn(number),
        len(groups) == 4 and valid_ip(".".join(groups)), len(set(number)),
        s.count("@"), len(s.partition("@")[0]), tail.count("."), len(tail.rpartition(".")[2]), bool(_DOMAIN.fullmatch(tail)), all(c in _LOCAL for c in s.partition("@")[0]),
        _letter(left), left.isdigit(), left in "+=/#\"'@." if left else 0, _letter(right), right.isdigit(), right in "=/\"'@" if right else 0,
        bool(re.search(r"[0-9][\x20.-]$", before)), bool(re.match(r"[\x20.-][0-9]", after)), before.count("="),
        announced(text, span), well_formed(text, span), s.startswith("00"),
    ]


def announced(text: str, span: Span) -> bool:
    """Whether a word shortly before names the kind."""
    return bool(ANNOUNCED[span[0]].search(text, max(0, span[1] - 24), span[1]))


def well_formed(text: str, span: Span) -> bool:
    """Whether the span alone has the format of its kind, in a wider sense than the strict pattern."""
    s, number = text[span[1] : span[2]], digits_of(text[span[1] : span[2]])
    if span[0] == 0:
        local, _, domain = s.partition("@")
        return bool(local) and all(c in _LOCAL for c in local) and bool(_DOMAIN.fullmatch(domain))
    if span[0] == 1:
        return valid_ip(s)
    if span[0] == 2:
        return 13 <= len(number) <= MAX_DIGITS and luhn(number)
    return 8 <= len(number) <= 15 and bool(_NATIONAL.fullmatch(s))


def weak_label(text: str, span: Span, base: set[Span]) -> float | None:
    """1 for true, 0 for false, None where the evidence is mixed."""
    if span in base:
        return 1.0
    if strictly_valid(text, span):
        return None
    signs = announced(text, span) + well_formed(text, span)
    return {0: 0.0, 1: None, 2: 1.0}[signs]


def strictly_valid(text: str, span: Span) -> bool:
    """Whether the span alone would be accepted by its kind's pattern and check."""
    return (span[0], 0, span[2] - span[1]) in base_spans(text[span[1] : span[2]])


class Taken:
    """Disjoint stretches of a text, with a fast test for overlap."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((a, b) for _, a, b in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, span: Span) -> bool:
        last = bisect_left(self.starts, span[2]) - 1
        return last >= 0 and self.ends[last] > span[1]

    def add(self, span: Span) -> None:
        """Take a span that overlaps nothing yet."""
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


@dataclass
class SpanModel:
    trees: BoostedTrees
    least: list[float]  # by kind; above 1: nothing is accepted

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """Accepted spans of each text that touch no base span; of overlapping ones the best, ties to the earlier longer."""
        out: list[list[Span]] = []
        for text, spans in zip(texts, base):
            taken, own = Taken(spans), []
            found = (c for c in candidates(text) if not taken.overlaps(c)) if _PERSONAL.search(text) else iter(())
            accepted: list[tuple[float, Span]] = []
            while some := list(islice(found, BLOCK_CANDIDATES)):
                score = self.trees.probability(np.array([features(text, c) for c in some], np.float64))
                accepted += [(-p, c) for p, c in zip(score.tolist(), some) if p >= self.least[c[0]]]
            for _, c in sorted(accepted, key=lambda x: (x[0], x[1][1], -x[1][2])):
                if not taken.overlaps(c):
                    taken.add(c)
                    own.append(c)
            out.append(own)
        return out


def examples(docs: DataFrame) -> DataFrame:
    """(x, y, fitting, n): how often a feature vector stands with a label, among the labelled candidates of all ``docs``."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((text, base, c) for text in batch.column(0).to_pylist() for base in (set(base_spans(text)),) for c in candidates(text))
            while some := list(islice(found, BLOCK_CANDIDATES)):
                known = [(text, c, label) for text, base, c in some if (label := weak_label(text, c, base)) is not None]
                if not known:
                    continue
                keys = (f"{text[max(0, c[1] - 30) : c[2] + 30]}{c[0]}{c[2] - c[1]}" for text, c, _ in known)
                fitting = [hashlib.blake2b(k.encode(), digest_size=7).digest()[-1] % 2 == 0 for k in keys]
                x = packed(np.array([features(text, c) for text, c, _ in known]))
                yield pa.RecordBatch.from_arrays([x, pa.array([label for *_, label in known]), pa.array(fitting)], ["x", "y", "fitting"])

    some = docs.where(F.col("text").rlike("[@0-9]")).select("text")
    return some.mapInArrow(labelled, "x binary, y double, fitting boolean").groupBy("x", "y", "fitting").agg(F.count("*").alias("n"))


def fit(docs: DataFrame) -> SpanModel | None:
    """Fit and calibrate on the candidates of all documents; None if they show no personal data or nothing else."""
    counted = stored(examples(docs), "candidates")
    if counted.where("fitting").agg(F.count_distinct("y")).first()[0] < 2:
        return None
    trees = BoostedTrees().fit(counted.where("fitting"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column(0))
                level = np.floor(SCORE_LEVELS * trees.probability(x)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(level), *batch.columns[1:]], ["kind", "level", "y", "n"])

    scores = counted.where("NOT fitting").select("x", "y", "n").mapInArrow(scored, "kind int, level long, y double, n long")
    sums = scores.groupBy("kind", "level").agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("right")).toArrow()
    kind, level, seen, right = (sums[c].to_numpy() for c in ("kind", "level", "seen", "right"))
    together = _threshold(level, seen, right)
    own = [_threshold(*(v[kind == k] for v in (level, seen, right))) for k in range(len(KINDS))]
    return SpanModel(trees, [o or together or 2.0 for o in own])


def _threshold(level: np.ndarray, seen: np.ndarray, right: np.ndarray) -> float | None:
    """The least score from which on the accepted candidates are true often enough, at least one half; None if too few are.

    Given are all candidates and the true ones by score level, each level once or, of several kinds, more than once.
    """
    levels, at = np.unique(-level, return_inverse=True)
    total, true = np.zeros((2, len(levels)), np.int64)
    np.add.at(total, at, seen)
    np.add.at(true, at, right)
    total, true = total.cumsum(), true.cumsum()
    good = (true >= PRECISION * total) & (total >= LEAST_ACCEPTED)
    return max(0.5, float(-levels[good].max()) / SCORE_LEVELS) if good.any() else None


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def found_spans(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row a row of ``docs``.

    The counts and the checksum are of the base spans; ``spans`` has the added ones too. Null and empty texts have no
    spans. Repeated rows and doc_ids stay rows of their own; texts are scanned whole, in time linear in their length.
    Other columns are ignored whatever their names; an empty table gives an empty table.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) if _PERSONAL.search(t) else [] for t in texts]
            more = model.added(texts, base) if model else [[] for _ in texts]
            counts = [[sum(s[0] == k for s in b) for b in base] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([written(b + m) for b, m in zip(base, more)], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def without(text: str, spans: list[Span]) -> str:
    """The text with a placeholder for each span; touching spans become one."""
    out, at, end = [], 0, -1
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if start < end:
            end = max(end, stop)
            at = end
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end = stop
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: SpanModel | None) -> DataFrame:
    """``docs``, all rows and columns, with placeholders in ``text``; ``n_chars``, if there is one, follows."""
    place = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(place).to_pylist()
            texts = [t or "" for t in given]
            base = [base_spans(t) if _PERSONAL.search(t) else [] for t in texts]
            more = model.added(texts, base) if model else [[] for _ in texts]
            columns = list(batch.columns)
            new = [g if not (b or m) else without(t, b + m) for g, t, b, m in zip(given, texts, base, more)]
            columns[place] = pa.array(new, batch.schema.field(place).type)
            if length is not None:
                old = batch.column(length).to_pylist()
                columns[length] = pa.array([n if g is t else len(t) for n, g, t in zip(old, given, new)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
