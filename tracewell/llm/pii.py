"""Personal data: fixed patterns, and a semi-Markov conditional random field over spans."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tracewell.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
# fixed values: the four base kinds.  The parts of the patterns that only keep the time
# linear (look-behinds, possessive repeats) don't change what matches.
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BEFORE_AT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

WINDOWS = 600  # stretches of text that a model is fitted on at most
LONGEST_WINDOW = 400  # characters of those
TOKENS = 16  # tokens of an entity at most
ROUNDS, RATE, RIDGE = 8, 0.3, 0.002
SURE = 0.9  # probability from which a span of the model is reported
# stretches of neighbouring words with a digit, @ or +
STRETCH = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+(?: [^\s0-9@+]*+[0-9@+]\S*+)*+")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(part: str) -> bool:
    """At most 255, leading zeros aside."""
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the base patterns, by kind as listed, then start."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in BEFORE_AT:
            start -= 1
        match = AFTER_AT.match(text, at) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(map(small, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if CARD_DIGITS[0] <= len(digits := digits_of(m[0])) <= CARD_DIGITS[1] and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(digits_of(m[0])) <= PHONE_DIGITS[1]:
            found.append(("phone", *m.span()))
    return found


# ------------------------------------------------------------------ the model


def candidates(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Token borders of a stretch, and the segments (first token, end token) that may be entities.

    An entity has at most TOKENS tokens, begins and ends with no blank, and either holds
    one @ or no letters and 7 to 19 digits.
    """
    tokens = [m.span() for m in TOKEN.finditer(text)]
    borders = [a for a, _ in tokens] + [len(text)]
    segments = []
    for i in range(len(tokens)):
        if text[borders[i]].isspace():
            continue
        digits = letters = ats = 0
        for j in range(i, min(i + TOKENS, len(tokens))):
            first = text[borders[j]]
            width = borders[j + 1] - borders[j]
            digits += width if "0" <= first <= "9" else 0
            letters += first.isalpha()
            ats += first == "@"
            if digits > 19 and not ats or ats > 1:
                break
            if not first.isspace() and (ats == 1 or not letters and digits >= 7):
                segments.append((i, j + 1))
    return borders, segments


def span_features(text: str, start: int, stop: int) -> list[str]:
    """Features of a whole span and its borders."""
    span = text[start:stop]
    digits = digits_of(span)
    shape = re.sub(r"[0-9]+", "d", re.sub(r"[^\W\d_]+", "a", span))
    parts = span.split(".")
    return [
        "shape=" + shape[:16],
        f"digits={len(digits)}",
        f"first={'d' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}",
        f"last={'d' if span[-1].isdigit() else 'a' if span[-1].isalpha() else span[-1]}",
        f"luhn={13 <= len(digits) <= 19 and luhn(digits)}",
        f"quad={len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)}",
        f"domain={AFTER_AT.search(span) is not None}",
        f"left={start > 0 and not text[start - 1].isspace()}",
        f"right={stop < len(text) and not text[stop].isspace()}",
        f"digit_beside={text[start - 1 : start].isdigit() or text[stop : stop + 1].isdigit()}",
        "any",
    ]


class Lattice:
    """All segmentations of a stretch: single outside tokens, and candidate segments of each kind."""

    def __init__(self, text: str):
        self.borders, segments = candidates(text)
        self.n = len(self.borders) - 1
        # (first token, end token, kind or None, features); by end token
        self.arcs: list[list[tuple[int, str | None, tuple[str, ...]]]] = [[] for _ in range(self.n + 1)]
        for i, j in segments:
            features = span_features(text, self.borders[i], self.borders[j])
            for kind in KINDS:
                self.arcs[j].append((i, kind, tuple(f"{kind}|{f}" for f in features)))
        for j in range(1, self.n + 1):
            c = text[self.borders[j - 1]]
            self.arcs[j].append((j - 1, None, ("O|" + ("d" if c.isdigit() else "a" if c.isalpha() else c),)))

    def marginals(self, weights: Mapping[str, float]) -> list[list[float]]:
        """Probability of every arc, by the forward and backward sums."""
        score = [[sum(weights.get(f, 0.0) for f in arc[2]) for arc in arcs] for arcs in self.arcs]
        forward = [0.0] + [-math.inf] * self.n
        for j in range(1, self.n + 1):
            forward[j] = _log_sum([forward[a[0]] + s for a, s in zip(self.arcs[j], score[j], strict=True)])
        backward = [-math.inf] * self.n + [0.0]
        gathered: list[list[float]] = [[] for _ in range(self.n + 1)]
        for j in range(self.n, 0, -1):
            if j < self.n:
                backward[j] = _log_sum(gathered[j])
            for a, s in zip(self.arcs[j], score[j], strict=True):
                gathered[a[0]].append(backward[j] + s)
        total = forward[self.n]
        return [
            [math.exp(forward[a[0]] + s + backward[j] - total) for a, s in zip(self.arcs[j], score[j], strict=True)]
            for j in range(self.n + 1)
        ]

    def best(self, weights: Mapping[str, float]) -> list[tuple[str, int, int]]:
        """(kind, start, stop) of the best segmentation: boundaries and kinds chosen together."""
        score, back = [0.0] + [-math.inf] * self.n, [None] * (self.n + 1)
        for j in range(1, self.n + 1):
            for arc in self.arcs[j]:
                s = score[arc[0]] + sum(weights.get(f, 0.0) for f in arc[2])
                if s > score[j]:
                    score[j], back[j] = s, arc
        found, j = [], self.n
        while j > 0:
            i, kind, _ = back[j]
            if kind:
                found.append((kind, self.borders[i], self.borders[j]))
            j = i
        return found[::-1]

    def gold(self, spans: Sequence[tuple[str, int, int]]) -> list[tuple[int, int]] | None:
        """Arcs (end token, number) of a given segmentation; None if it is none of the lattice's."""
        place = {b: i for i, b in enumerate(self.borders)}
        chosen, at = [], 0
        for kind, start, stop in sorted(spans, key=lambda s: s[1]):
            i, j = place.get(start), place.get(stop)
            if i is None or j is None or i < at:
                return None
            chosen += [(k, len(self.arcs[k]) - 1) for k in range(at + 1, i + 1)]
            arc = next((k for k, a in enumerate(self.arcs[j]) if a[:2] == (i, kind)), None)
            if arc is None:
                return None
            chosen.append((j, arc))
            at = j
        return chosen + [(k, len(self.arcs[k]) - 1) for k in range(at + 1, self.n + 1)]


def _log_sum(values: Sequence[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def train(texts: Sequence[str]) -> dict[str, float]:
    """Weights that make the base spans of the stretches likely: stochastic gradient ascent.

    Where base spans overlap, the longest counts.  The luhn, quad and domain features
    say what a pattern says; the others carry over to spellings that no pattern has.
    """
    examples = []
    for text in texts:
        spans: list[tuple[str, int, int]] = []
        for span in sorted(base_spans(text), key=lambda s: (s[1] - s[2], s[1], KINDS.index(s[0]))):
            if all(span[2] <= s[1] or s[2] <= span[1] for s in spans):
                spans.append(span)
        lattice = Lattice(text)
        if lattice.n and (gold := lattice.gold(spans)) is not None:
            examples.append((lattice, gold))
    weights: dict[str, float] = {}
    for r in range(ROUNDS):
        rate = RATE / (1 + r / 2)
        for lattice, gold in examples:
            chosen = set(gold)
            for j, chances in enumerate(lattice.marginals(weights)):
                for k, p in enumerate(chances):
                    gap = ((j, k) in chosen) - p
                    if abs(gap) > 1e-4:
                        for f in lattice.arcs[j][k][2]:
                            weights[f] = weights.get(f, 0.0) * (1 - rate * RIDGE) + rate * gap
    return weights


def model_spans(
    text: str, base: Sequence[tuple[str, int, int]], weights: Mapping[str, float]
) -> list[tuple[str, int, int]]:
    """Spans of the best segmentations that overlap no base span and are sure."""
    found = []
    ranges = sorted((a, b) for _, a, b in base)
    if not weights:
        return found
    at = 0
    for m in STRETCH.finditer(text):
        while at < len(ranges) and ranges[at][1] <= m.start():
            at += 1
        covered = [r for r in ranges[at : at + 1 + (m.end() - m.start())] if r[0] < m.end()]
        if sum(b - a for a, b in covered) >= m.end() - m.start() or len(digits_of(m[0])) < 7 and "@" not in m[0]:
            continue
        lattice = Lattice(m[0])
        spans = [
            (kind, a + m.start(), b + m.start())
            for kind, a, b in lattice.best(weights)
            if all(b + m.start() <= x or y <= a + m.start() for x, y in covered)
        ]
        if spans:
            place = {b: i for i, b in enumerate(lattice.borders)}
            chance = lattice.marginals(weights)
            for kind, a, b in spans:
                i, j = place[a - m.start()], place[b - m.start()]
                k = next(k for k, arc in enumerate(lattice.arcs[j]) if arc[:2] == (i, kind))
                if chance[j][k] >= SURE:
                    found.append((kind, a, b))
    return found


def fit(docs: DataFrame, text: str = "text", windows: int = WINDOWS) -> dict[str, float]:
    """Fit the model on at most ``windows`` distinct short stretches, chosen by hash from all texts.

    The base patterns are the labels.  Copies of a stretch count once, and the sample is
    dealt in turn to the sets of kinds that the patterns find in stretches, none of them
    included, so that every kind which occurs is learnt.  Only the sample comes to the driver.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                m[0]
                for t in batch.column(0).to_pylist()
                if t
                for m in STRETCH.finditer(t)
                if len(m[0]) <= LONGEST_WINDOW and ("@" in m[0] or len(digits_of(m[0])) >= 7)
            ]
            found = list(dict.fromkeys(found))
            kinds = [",".join(sorted({s[0] for s in base_spans(f)})) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(kinds, pa.string())], names=["stretch", "kinds"])

    stretches = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    distinct = stretches.mapInArrow(cut, "stretch string, kinds string").distinct()
    own = F.struct(F.xxhash64("stretch").alias("h"), "stretch")
    # a group of kinds is cut to the sample in each of 64 parts first, so that none is sorted in one task
    inside = Window.partitionBy("kinds", "part").orderBy("own")
    among = Window.partitionBy("kinds").orderBy("own")
    dealt = distinct.select("kinds", own.alias("own"), F.pmod(F.xxhash64("stretch"), F.lit(64)).alias("part"))
    dealt = dealt.withColumn("turn", F.row_number().over(inside)).where(F.col("turn") <= windows)
    dealt = dealt.withColumn("turn", F.row_number().over(among)).where(F.col("turn") <= windows)
    chosen = dealt.orderBy("turn", "own").limit(windows).collect()
    return train([r.own.stretch for r in sorted(chosen, key=lambda r: r.own)])


SPAN = StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("stop", LongType()),
    StructField("base", BooleanType()),
])


@lru_cache(maxsize=2)
def _weights(items: tuple) -> dict[str, float]:
    return dict(items)


def scan(
    docs: DataFrame, weights: Mapping[str, float], text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add pii_spans to every row: (kind, start, stop, base) by kind as in KINDS, then start; no shuffle.

    Places are code points, the end exclusive.  ``base`` tells matches of the base
    patterns from spans that only the model finds; no span of the model overlaps one.

    * null or empty text: an empty list.  Ties and repeated rows: each scanned.
    * texts of any length are scanned whole, in time proportional to their length.
    * empty weights (nothing to fit on): base spans only.
    * an empty table stays empty; a column named pii_spans: ValueError.
    """
    items = tuple(weights.items())

    def start():
        known = _weights(items)
        signs = re.compile(rb"[0-9@]")

        def run(texts):
            rows = []
            for raw in texts:
                if not raw or not signs.search(raw):
                    rows.append([])
                    continue
                t = raw.decode("utf-8")
                base = base_spans(t)
                spans = [(*s, True) for s in base] + [(*s, False) for s in model_spans(t, base, known)]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append([dict(zip(("kind", "start", "stop", "base"), s, strict=True)) for s in spans])
            return [rows]

        return run

    new = StructType([StructField("pii_spans", ArrayType(SPAN))])
    return map_texts(docs, text, list(docs.columns if keep is None else keep), new, start)
