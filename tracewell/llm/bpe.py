"""Byte-level BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tracewell.llm.common import map_texts

# fixed value: how byte-level vocabularies split a text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Bytes, about, of the words used last whose codes a Python worker remembers: so many, or twice as many.
REMEMBERED = 8 << 20
ENTRY = 150  # bytes that an entry takes besides its word and codes
CHUNKS = re.compile(r" (?=\S)")
BLANKS = re.compile(r" \s")
FEW = 12  # places that are merged one by one
NOTHING = -1
PAIR = 1 << 32  # (left, right) as one number


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """A dictionary that forgets what was not asked for while others of ``size`` bytes were."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def age(self) -> None:
        if ENTRY * len(self) + sum(map(len, self)) + sum(map(len, self.values())) > self.size:
            self.old = dict(self)
            self.clear()

    def lacks(self, keys: set) -> set:
        """Those that are not known; the others are fresh again."""
        keys = keys.difference(self)
        again = keys.intersection(self.old)
        self.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return keys.difference(again)


class Vocabulary:
    """A byte-level BPE model read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level vocabularies without normalizer are supported")
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        codes = spec["model"]["vocab"]
        self.first = np.array([codes[letters[b]] for b in range(256)])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pairs = [(codes[a], codes[b]) for a, b in pairs]
        self.made = [codes[a + b] for a, b in pairs]
        self.merges = {pair: rank for rank, pair in enumerate(self.pairs)}
        born = dict.fromkeys(self.first.tolist(), -1) | {c: rank for rank, c in reversed([*enumerate(self.made)])}
        late = any(max(born.get(a, rank), born.get(b, rank)) >= rank for rank, (a, b) in enumerate(self.pairs))
        if late or len(set(self.made)) < len(pairs):
            raise ValueError("every merge must make a new symbol of earlier ones")
        keys = np.array([a * PAIR + b for a, b in self.pairs], dtype=np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = {k.encode(): v for k, v in added.items()}
        self.bytes = {
            code: bytes(byte_of[c] for c in word) if all(c in byte_of for c in word) else word.encode()
            for word, code in (codes | added).items()
        }
        # an added token is cut out first; of several at one place the longest
        names = sorted(added, key=lambda x: (-len(x), x))
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.split = regex.compile(SPLIT)
        self.known = Recent(REMEMBERED)  # codes of words
        self.chunks = Recent(REMEMBERED)  # of chunks without the space before them; a text's first one has a space instead

    def learn(self, words: Iterable[str]) -> None:
        """Encode words through an index from each pair to all its places in them."""
        if not (words := list(words)):
            return
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        # one more place after each word, so that no pair spans two words
        symbols = np.full(int(lengths.sum()) + len(raw), NOTHING, dtype=np.int64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[starts + lengths] = False
        symbols[inside] = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        merge_places(symbols, self.pair_keys, self.pair_ranks, self.merges, self.pairs, self.made)
        left = symbols >= 0
        ends = 4 * np.cumsum(np.add.reduceat(left.astype(np.int64), starts))
        codes = symbols[left].astype("<u4").tobytes()
        begins = [0, *ends[:-1].tolist()]
        self.known.update(zip(words, map(codes.__getitem__, map(slice, begins, ends.tolist())), strict=True))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Codes of each text as little-endian unsigned 32-bit integers.

        A text is cut before every space between white-free neighbours, where the
        split pattern always ends a word; the codes of such chunks are remembered.
        """
        self.chunks.age()
        self.known.age()
        rows: list[list[int | list[str]]] = []
        unknown: set[str] = set()
        for text in texts:
            row: list[int | list[str]] = []
            for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if i % 2:
                    row.append(self.added[part.encode()])
                elif part:
                    blanks = part[-1] == " " or BLANKS.search(part)
                    row.append(chunks := CHUNKS.split(part) if blanks else part.split(" "))
                    unknown.update(chunks[1:])
                    chunks[0] = " " + chunks[0]  # the only one without a space before it
                    unknown.add(chunks[0])
            rows.append(row)
        unknown = self.chunks.lacks(unknown)
        split = self.split.findall
        words = {c: split(c[1:] if c[0] == " " else " " + c) for c in unknown}
        self.learn(self.known.lacks({w for row in words.values() for w in row}))
        of = self.known.__getitem__
        self.chunks.update({c: b"".join(map(of, row)) for c, row in words.items()})
        of = self.chunks.__getitem__
        return [
            b"".join(b"".join(map(of, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in row) for row in rows
        ]

    def forget(self) -> None:
        """Free the remembered codes: a Python worker outlives its task."""
        self.known, self.chunks = Recent(REMEMBERED), Recent(REMEMBERED)

    def decode(self, codes: bytes) -> bytes:
        """Bytes that the codes stand for; codes outside the vocabulary stand for nothing."""
        known = self.bytes
        return b"".join([known.get(c, b"") for c in np.frombuffer(codes, dtype="<u4").tolist()])


def merge_places(
    symbols: np.ndarray,
    pair_keys: np.ndarray,
    pair_ranks: np.ndarray,
    merges: dict[tuple[int, int], int],
    pairs: list[tuple[int, int]],
    made_by: list[int],
) -> None:
    """Merge in place; what went into its left neighbour becomes NOTHING.

    ``places`` maps the rank of every pair present to where its left symbol stands.
    Ranks are taken in ascending order; all places of the pair are merged, and the
    pairs with both neighbours are entered.  Places that an earlier merge made stale
    are recognised by their symbols.  A merge only uses symbols of earlier merges, so
    no rank below the one at work can come up.  Pairs with few places are merged one
    by one, which costs less than array operations on them.
    """

    def ranks_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left >= 0) & (right >= 0), left * PAIR + right, -1)
        at = np.minimum(np.searchsorted(pair_keys, key), len(pair_keys) - 1)
        return np.where(pair_keys[at] == key, pair_ranks[at], -1)

    def enter(ranks: np.ndarray, where: np.ndarray) -> None:
        found = ranks >= 0
        ranks, where = ranks[found], where[found]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, where = ranks[order], where[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[begins].tolist(), begins, ends, strict=True):
            if rank not in places and rank not in single:
                heapq.heappush(active, rank)
            places.setdefault(rank, []).append(where[a:b])

    def one(rank: int, where: int) -> None:
        if rank not in single and rank not in places:
            heapq.heappush(active, rank)
        single.setdefault(rank, []).append(where)

    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    # the same memory, quicker to read one by one
    symbol, following, previous = memoryview(symbols), memoryview(after), memoryview(before)
    places: dict[int, list[np.ndarray]] = {}
    single: dict[int, list[int]] = {}
    active: list[int] = []
    enter(ranks_of(symbols[:-1], symbols[1:]), np.arange(n - 1))
    while active:
        rank = heapq.heappop(active)
        listed, lone = places.pop(rank, []), single.pop(rank, [])
        left, right = pairs[rank]
        whole = made_by[rank]
        if sum(map(len, listed)) + len(lone) <= FEW:
            for i in sorted([*lone, *(x for chunk in listed for x in chunk.tolist())]):
                j = following[i]
                if symbol[i] != left or symbol[j] != right:
                    continue
                k, h = following[j], previous[i]
                symbol[i], symbol[j] = whole, NOTHING
                following[i], previous[k] = k, i
                if h >= 0 and (found := merges.get((symbol[h], whole))) is not None:
                    one(found, h)
                if (found := merges.get((whole, symbol[k]))) is not None:
                    one(found, i)
            continue
        if lone:
            listed.append(np.array(lone))
        at = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
        at = at[symbols[at] == left]
        at = at[symbols[after[at]] == right]
        if left == right and len(at) > 1:  # in a run of equal symbols every second place counts
            follows = np.concatenate(([False], at[1:] == after[at[:-1]]))
            run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        rest = after[gone]  # each word ends with an empty place, so this one exists
        symbols[at], symbols[gone] = whole, NOTHING
        after[at], before[rest] = rest, at
        ahead = before[at]
        beside = np.concatenate((np.where(ahead >= 0, symbols[ahead], NOTHING), symbols[at]))
        enter(ranks_of(beside, np.concatenate((symbols[at], symbols[rest]))), np.concatenate((ahead, at)))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One copy per Python worker."""
    return Vocabulary(path)


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
    ids: str = "ids",
    decoded: str | None = None,
) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and n_tokens for every row.

    With ``decoded``, the text that the codes stand for is added in the same pass.

    ``path`` names the tokenizer's JSON file, readable on every executor.  Texts are
    encoded where they lie, without a shuffle; each distinct word of a batch goes
    through the pair index once.

    * null or empty text: no codes, n_tokens 0.  Ties and repeated rows: each encoded.
    * texts of any length are encoded whole; an added token inside a text is one code.
    * an empty table stays empty; columns named like the new ones: ValueError.
    """

    def start():
        model = vocabulary(path)

        def run(texts):
            found = model.encode([(t or b"").decode("utf-8") for t in texts])
            made = [found, [len(x) // 4 for x in found]]
            return made if decoded is None else [*made, [model.decode(x).decode("utf-8", "replace") for x in found]]

        run.close = model.forget
        return run

    new = StructType([StructField(ids, BinaryType()), StructField("n_tokens", LongType())])
    if decoded is not None:
        new = new.add(decoded, StringType())
    return map_texts(docs, text, list(docs.columns if keep is None else keep), new, start, at_once=1 << 20)


def decode(coded: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``decoded``, the text that the codes of every row stand for.

    Null codes give the empty text; bytes that are no UTF-8 become U+FFFD.
    """

    def start():
        model = vocabulary(path)
        return lambda rows: [[model.decode(r or b"").decode("utf-8", "replace") for r in rows]]

    kept = list(coded.columns if keep is None else keep)
    return map_texts(coded, ids, kept, StructType([StructField("decoded", StringType())]), start, binary=True)
