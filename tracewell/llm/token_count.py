"""Token counts of a piece vocabulary: words proven to be one token are counted without merging."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tracewell.llm.bpe import NOTHING, PAIR, merge_places
from tracewell.llm.common import map_texts, refuse_clash

SPACE = "▁"  # fixed value: how the vocabulary writes a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in the file
LIMIT = 4096
REMEMBERED = 8 << 20  # characters of words whose counts a task remembers
FOREIGN = 1 << 20  # a character outside the vocabulary has its code point plus this as symbol
NEVER = float("inf")
SHORT = 32  # symbols up to which a scan beats a heap
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of every field of one message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = number() if size is None else size
        piece = raw[at : at + size]
        at += size
        yield tag >> 3, struct.unpack("<f", piece)[0] if tag & 7 == 5 else piece


class Pieces:
    """A piece vocabulary with byte fallback, read from a ``.model`` file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        trainer = next((dict(_fields(v)) for n, v in parts if n == 2), {})
        normalizer = next((dict(_fields(v)) for n, v in parts if n == 3), {})
        plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or not plain:
            raise ValueError("only merge vocabularies with byte fallback and without text normalisation are supported")
        self.costs: dict[str, float] = {}  # the lowest merges first
        for spec in (dict(_fields(v)) for n, v in parts if n == 1):
            kind = spec.get(3, NORMAL)
            if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                raise ValueError("unused and user-defined pieces are not supported")
            if kind == NORMAL:
                self.costs[spec[1].decode()] = -spec.get(2, 0.0)
        if any(SPACE in p.lstrip(SPACE) for p in self.costs):
            raise ValueError("no piece may have a space after another character")

    def merge(self, word: str) -> list[str]:
        """Symbols that are left of a word: the best pair first, the leftmost of equal ones."""
        return self.scan(word)[0] if len(word) <= SHORT else self._heap(word)

    def scan(self, word: str) -> tuple[list[str], int]:
        """The same by repeated scans, and how long the left part of the last merge was."""
        parts, cut, cost = list(word), 0, self.costs.get
        costs = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) < NEVER:
            i = costs.index(best)
            cut = len(parts[i])
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], NEVER)
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
        return parts, cut

    def _heap(self, word: str) -> list[str]:
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        pairs: list[tuple[float, int, str]] = []

        def enter(left: int, right: int) -> None:
            if (found := self.costs.get(both := parts[left] + parts[right])) is not None:
                heapq.heappush(pairs, (found, left, both))

        for i in range(len(parts) - 1):
            enter(i, i + 1)
        while pairs:
            _, left, both = heapq.heappop(pairs)
            if parts[left] is None or (right := after[left]) == len(parts) or parts[left] + parts[right] != both:
                continue  # an earlier merge took a part of it
            parts[left], parts[right], after[left] = both, None, after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                enter(left, after[left])
            if before[left] >= 0:
                enter(before[left], left)
        return [p for p in parts if p is not None]

    def count(self, word: str) -> int:
        """Tokens of one pre-token: a symbol outside the vocabulary takes one for each of its bytes."""
        return sum(1 if p in self.costs else len(p.encode()) for p in self.merge(word))


def prove(pieces: Pieces) -> bytes:
    """For each piece, in the order of the file, where the last merge of its characters joins it; 0 if they don't become it.

    Every piece goes through the merges once, alone.  What happens inside a stretch of a
    text that ends up as one symbol is what happens to the stretch alone, as merges that
    cross its ends would break it.  So a piece with 0 (and more than one character) never
    comes up, and any other is only ever made of the two parts found here.
    """
    cuts = []
    for piece in pieces.costs:
        parts, cut = pieces.scan(piece)
        cuts.append(cut if parts == [piece] else 0)
    return np.array(cuts, dtype=np.uint16).tobytes()


class Counter:
    """Counts the tokens of texts; remembers words it had to merge."""

    def __init__(self, pieces: Pieces, proof: bytes):
        self.pieces = pieces
        cuts = np.frombuffer(proof, dtype=np.uint16).tolist()
        alone = [(p, cut) for p, cut in zip(pieces.costs, cuts, strict=True) if cut or len(p) == 1]
        # a pre-token starts with the space before it; words are looked up without that one
        self.whole = {p[1:]: 1 for p, _ in alone if p[0] == SPACE and PRE_TOKEN.fullmatch(p)}
        self.symbols = {p: i for i, (p, _) in enumerate(alone)}
        # runs of spaces may have equal costs, for which the leftmost counts: they are merged one by one
        made = sorted((pieces.costs[p], p, cut) for p, cut in alone if cut and p[:2] != SPACE * 2)
        born = {p: rank for rank, (_, p, _) in enumerate(made)}
        self.pairs = [(self.symbols[p[:cut]], self.symbols[p[cut:]]) for _, p, cut in made if {p[:cut], p[cut:]} <= self.symbols.keys()]
        self.made = [self.symbols[p] for _, p, _ in made]
        self.ordered = (
            len(self.pairs) == len(made)
            and len({cost for cost, _, _ in made}) == len(made)
            and all(max(born.get(p[:cut], -1), born.get(p[cut:], -1)) < rank for rank, (_, p, cut) in enumerate(made))
        )
        keys = np.array([a * PAIR + b for a, b in self.pairs], dtype=np.int64)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        self.merges = {pair: rank for rank, pair in enumerate(self.pairs)}
        self.forget()

    def forget(self) -> None:
        """Keep the proven words only: a Python worker outlives its task."""
        self.known, self.size = dict(self.whole), 0

    def learn(self, words: Sequence[str]) -> list[int]:
        """Tokens of words with one space before each, merged all at once where the order of merges allows it."""
        if not words or not self.ordered:
            return [self.pieces.count(SPACE + w) for w in words]
        points = np.frombuffer("\0".join(["", *(SPACE + w for w in words), ""]).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        starts = np.cumsum(lengths) - lengths + 1
        present, place = np.unique(points, return_inverse=True)
        codes = np.array([self.symbols.get(chr(c), FOREIGN + c) for c in present.tolist()], dtype=np.int64)
        symbols = codes[place]
        symbols[0], symbols[starts + lengths - 1] = NOTHING, NOTHING
        merge_places(symbols, self.keys, self.ranks, self.merges, self.pairs, self.made)
        point = symbols - FOREIGN
        tokens = (symbols >= 0).astype(np.int64) + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        return np.add.reduceat(tokens, starts).tolist()

    def count(self, texts: Sequence[str]) -> list[int]:
        """Number of tokens of each text; a space is put before the first word, as the vocabulary has it."""
        rows = []
        for text in texts:
            text = text.replace(SPACE, " ")
            if not text:
                rows.append([])
            elif "  " in text or text[0] == " " or text[-1] == " ":
                rows.append([p[1:] for p in PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))])
            else:
                rows.append(text.split(" "))
        words = set().union(*rows)
        unknown = [w for w in words if w not in self.known]
        self.size += sum(map(len, unknown))
        if self.size > REMEMBERED:
            self.forget()
            unknown = [w for w in words if w not in self.known]
            self.size = sum(map(len, unknown))
        spaced = [w for w in unknown if SPACE in w]
        self.known.update((w, self.pieces.count(SPACE + w)) for w in spaced)
        plain = [w for w in unknown if SPACE not in w]
        self.known.update(zip(plain, self.learn(plain), strict=True))
        return [sum(map(self.known.__getitem__, row)) for row in rows]


@lru_cache(maxsize=4)
def _counter(path: str, proof: bytes) -> Counter:
    return Counter(Pieces(path), proof)


def add_counts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
    limit: int = LIMIT,
    names: Sequence[str] = ("n_bytes", "n_tokens", "over_limit"),
) -> DataFrame:
    """Add UTF-8 bytes, tokens, and whether there are more than ``limit`` tokens, for every whole text.

    ``path`` names the vocabulary's ``.model`` file, readable on the driver and on every
    executor.  The driver proves once how each piece comes about and sends one number
    per piece along; texts are counted where they lie, without a shuffle.  No begin or end
    token counts, and names of special tokens in a text are ordinary text.

    * null or empty text: 0 bytes, 0 tokens, not over the limit.
    * ties and repeated rows: each counted.  Texts of any length are counted whole; a
      word of any length is merged with a heap, in little more than linear time.
    * an empty table stays empty; columns named like the new ones: ValueError.
    """
    kept = list(docs.columns if keep is None else keep)
    refuse_clash(kept, names)
    proof = prove(Pieces(path))

    def start():
        counter = _counter(path, proof)

        def run(texts):
            found = counter.count([(t or b"").decode("utf-8", "replace") for t in texts])
            return [[len(t or b"") for t in texts], found, [n > limit for n in found]]

        run.close = counter.forget
        return run

    kinds = (LongType(), LongType(), BooleanType())
    return map_texts(docs, text, kept, StructType([StructField(n, k) for n, k in zip(names, kinds, strict=True)]), start)
