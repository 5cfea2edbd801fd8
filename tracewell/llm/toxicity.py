"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewell.llm.common import fresh, map_texts, refuse_clash, trimmed
from tracewell.session import materialize

SAMPLE = 20_000  # distinct labelled texts that a model is fitted on at most
VOTERS = 400  # terms that vote at most
LEAST_TOXIC = 5  # distinct toxic texts that must have a voter's term
LEAST_LIFT = 8.0  # how much more frequent the term is in toxic texts
LABEL_RATES = (0.01, 0.98)  # how often clean and toxic rows are labelled toxic
LEAST_CORRELATION = 0.3
STEMS = range(3, 9)  # lengths of the word beginnings that are pattern voters
THRESHOLD = 0.3
REMEMBERED = 2 << 20  # bytes of words that are known to vote or not
_FLUSH = 100_000

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> set[bytes]:
    """Distinct lower-case words; ASCII digits, signs and blanks separate them."""
    return set(text.decode("utf-8").lower().encode().translate(_LETTERS).split())


def terms_of(word: bytes) -> list[str]:
    """What can vote on a word: the word itself, and its beginnings, written with a star."""
    whole = word.decode("utf-8", "replace")
    return [whole, *(whole[:n] + "*" for n in STEMS if len(whole) >= n)]


@dataclass(frozen=True)
class Model:
    """Terms that vote, and the linear classifier over their votes."""

    terms: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(text, y) of the distinct labelled texts outside the held-out fold, at most ``most`` by hash of the text.

    Copies of a text count once for each label they have, so no group of copies fills the
    sample.  Texts are told apart by 64-bit hashes; the row with the smallest key stands for its copies.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("y"))
    )
    texts = docs.select(F.col(key).alias("_k"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_h"))
    own = (
        texts.join(chosen, "_k").groupBy("_h", "y").agg(F.min("_k").alias("_k"))
        .orderBy(F.xxhash64("_h"), "_h", "y").limit(most)
    )
    # a repeated key may have other texts as well
    named = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = named.withColumn("_h", F.xxhash64("text")).join(F.broadcast(own), ["_k", "_h"])  # `most` rows
    return found.dropDuplicates(["_h", "y"]).select("text", "y")


def held_out(key: str):
    """Rows that no model may learn from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many rows of each label a term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            terms = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_pydict({
                "term": pa.array(terms, pa.string()),
                "toxic": pa.array([seen[1][t] for t in terms], pa.int64()),
                "clean": pa.array([seen[0][t] for t in terms], pa.int64()),
            })
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[bool(y)].update({t for w in words_of((text or "").encode()) for t in terms_of(w)})
                if len(seen[0]) + len(seen[1]) > _FLUSH:
                    yield flush()
        yield flush()

    counted = rows.select("text", "y").mapInArrow(trimmed(count), "term string, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Voting:
    """Finds which terms a text has; remembers the words it has met."""

    def __init__(self, terms: Sequence[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.forget()

    def forget(self) -> None:
        """Free what was remembered: a Python worker outlives its task."""
        self.met: set[bytes] = set()
        self.hits: dict[bytes, frozenset[int]] = {}
        self.size = 0

    def votes(self, text: bytes) -> set[int]:
        words = words_of(text)
        if self.size > REMEMBERED:
            self.forget()
        fresh_words = words - self.met
        for word in fresh_words:
            if found := frozenset(self.place[t] for t in terms_of(word) if t in self.place):
                self.hits[word] = found
        self.met |= fresh_words
        self.size += sum(map(len, fresh_words))
        return set().union(*(self.hits[w] for w in self.hits.keys() & words))


def label_model(votes: np.ndarray, given: np.ndarray, counts: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior of being toxic for each distinct vector of votes with its given label.

    Generative model: a row is toxic with some probability, and each voter speaks with a
    rate that depends on it.  Rates, and correlations between voters given the truth,
    are estimated by expectation maximisation over the rows, ``counts`` of each kind.
    A voter's say is divided by one plus its correlations with the others, so that a
    word and its stems count about once; a voter whose term is absent abstains.  The given label is one more voter; its rates
    are fixed, which keeps the hidden truth what the labels mean.
    """
    x = votes.astype(float)
    total = counts.sum()
    label = np.where(given, np.log(LABEL_RATES[1] / LABEL_RATES[0]), np.log((1 - LABEL_RATES[1]) / (1 - LABEL_RATES[0])))
    q = np.where(given, 0.9, 0.05)
    for _ in range(rounds):
        of = np.stack((counts * (1 - q), counts * q))  # clean, toxic
        mass = of.sum(axis=1)
        rate = np.clip((of @ x + 0.05) / (mass[:, None] + 1.0), 1e-4, 1 - 1e-4)
        share = np.zeros((x.shape[1], x.shape[1]))
        for y in (0, 1):
            centred = x - rate[y]
            spread = np.sqrt(rate[y] * (1 - rate[y]))
            share += (centred.T * of[y]) @ centred / total / np.outer(spread, spread)
        together = np.clip(share, 0, 1)
        together[together < LEAST_CORRELATION] = 0
        np.fill_diagonal(together, 0)
        say = 1 / (1 + together.sum(axis=1))
        spoken = np.log(rate[1] / rate[0]) * say
        prior = np.clip(mass[1] / total, 1e-4, 1 - 1e-4)
        logit = np.log(prior / (1 - prior)) + label + x @ spoken
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def linear_classifier(
    votes: np.ndarray, posterior: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 25
) -> tuple[np.ndarray, float]:
    """Logistic regression of posterior labels on votes, by Newton's method."""
    x = np.column_stack((votes.astype(float), np.ones(len(votes))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (posterior - p)) - penalty * w
        curve = (x.T * (counts * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
    voters: int = VOTERS,
) -> Model:
    """Fit voters, label model and classifier on at most ``sample`` distinct labelled texts.

    Voters are words and word beginnings much more frequent in texts labelled toxic.
    Their votes on the sample, packed as bits and counted by kind, come to the driver:
    at most ``sample`` rows of ``voters`` bits.  Rows of the held-out fold, and rows
    without label or key, are never used; of repeated labels the largest counts.
    Without toxic or without clean rows the model gives every text the same score.
    """
    # read three times; at most `sample` rows
    rows = materialize(training_rows(docs, labels, key, text, label, sample), "toxicity-sample")
    size = {r.y: r.n for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model((), (), -5.0 if not toxic else 5.0)
    lift = (F.col("toxic") + 0.5) / (toxic + 1.0) / ((F.col("clean") + 0.5) / (clean + 1.0))
    chosen = (
        term_counts(rows).where(F.col("toxic") >= LEAST_TOXIC)
        .withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT)
        .orderBy((F.col("toxic") * F.log("lift")).desc(), "term").limit(voters)
    )
    terms = tuple(sorted(r.term for r in chosen.collect()))

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(terms)
        for batch in batches:
            bits = []
            for t in batch.column(0).to_pylist():
                row = np.zeros(len(terms), dtype=np.uint8)
                row[list(voting.votes((t or "").encode()))] = 1
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column(1)], names=["bits", "y"])

    kinds = rows.select("text", "y").mapInArrow(trimmed(cast), "bits binary, y int").groupBy("bits", "y").count().collect()
    votes = np.array([np.unpackbits(np.frombuffer(k.bits, np.uint8))[: len(terms)] for k in kinds]).reshape(-1, len(terms))
    counts = np.array([k["count"] for k in kinds], dtype=float)
    posterior = label_model(votes, np.array([k.y > 0 for k in kinds]), counts)
    weights, bias = linear_classifier(votes, posterior, counts)
    return Model(terms, tuple(weights.tolist()), bias)


def score(
    docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = None, name: str = "toxicity"
) -> DataFrame:
    """Add the probability that each whole text is toxic; no shuffle.

    Nothing but the text goes into a score.  Null and empty texts get the score of a
    text on which no voter speaks; repeated rows get equal scores.  An empty table
    stays empty; a column named like the new one: ValueError.
    """
    kept = list(docs.columns if keep is None else keep)
    refuse_clash(kept, [name])

    def start():
        voting, weights = Voting(model.terms), np.array(model.weights)

        def run(texts):
            logits = [model.bias + float(sum(weights[i] for i in sorted(voting.votes(t or b"")))) for t in texts]
            return [[float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in logits]]

        run.close = voting.forget
        return run

    return map_texts(docs, text, kept, StructType([StructField(name, DoubleType())]), start)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows that the model doesn't call toxic, with their columns."""
    name = fresh(docs, "_toxicity")[0]
    return score(docs, model, text, name=name).where(F.col(name) < threshold).drop(name)
