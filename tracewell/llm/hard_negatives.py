"""Hard negatives by angular triangle filtering: angles to reference directions bound scores before any is computed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.llm.common import running_sums
from tracewell.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # a negative's score as percentages of the positive's
REFERENCES, SAMPLE = 8, 64  # reference directions, and rows by hash from which they are taken
BLOCK = 8192  # rows that are scored together
RUN = 128  # consecutive rows of a block that share bounds
GROUP = 32  # blocks whose anchors travel together
SALTS = 64  # ways that blocks of one label and length are dealt
_ANGLE, _SHARE, _SCORE = 1e-6, 1e-9, 1e-3  # slack of angles, and relative and absolute slack of bounds
NONE = (1 << 63) - 1  # asks for more than any score
_WIDTHS = ("<i2", "<i4", "<i8")


def quantized(df: DataFrame, key: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """(key, label, anchor, ints): rows that take part, every component x as floor(256 * x)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = df.select(
        F.col(key).try_cast("bigint").alias("key"), label.cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("ints"),
    )
    found = found.where(F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("ints").isNotNull() & ~F.exists("ints", bad))
    return found.withColumn("ints", F.transform("ints", lambda x: F.floor(x * SCALE).cast("bigint")))


def pack(vectors: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold all of them."""
    least, most = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    kind = next(k for k in _WIDTHS if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
    return [row.tobytes() for row in vectors.astype(kind)]


def unpack(packed: Sequence[bytes], dim: int) -> np.ndarray:
    """Rows of ``pack``, whatever their widths."""
    if not dim:
        return np.zeros((len(packed), 0), dtype=np.int64)
    if len({len(p) for p in packed}) == 1:
        return np.frombuffer(b"".join(packed), f"<i{len(packed[0]) // dim}").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(p, f"<i{len(p) // dim}") for p in packed], dtype=np.int64).reshape(-1, dim)


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; the direction of a zero vector is zero."""
    x = vectors.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def references(sample: Sequence[Sequence[int]], dim: int, number: int = REFERENCES) -> np.ndarray:
    """Directions of sampled rows of this length, each the farthest from those before; the rest follow a fixed rule."""
    rows = [r for r in sample if len(r) == dim and any(r)]
    chosen: list[np.ndarray] = []
    if rows:
        directions = unit(np.array(rows, dtype=np.int64))[0]
        nearest = np.full(len(rows), -2.0)
        for _ in range(min(number, len(rows))):
            i = int(np.argmin(nearest))
            chosen.append(directions[i])
            nearest = np.maximum(nearest, directions @ directions[i])
    rng = np.random.default_rng(dim)
    while len(chosen) < number:
        more = rng.normal(size=dim)
        chosen.append(more / max(float(np.linalg.norm(more)), 1e-300))
    return np.array(chosen).reshape(number, dim)


def angles(directions: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ to.T, -1, 1))


@dataclass(frozen=True)
class Bounds:
    """Least and largest angle to each reference, and length, of some rows; arrays with one row per set of rows."""

    near: np.ndarray
    far: np.ndarray
    short: np.ndarray
    long: np.ndarray

    @staticmethod
    def of(angle: np.ndarray, norm: np.ndarray, run: int) -> Bounds:
        starts = np.arange(0, len(norm), run)
        return Bounds(
            np.minimum.reduceat(angle, starts), np.maximum.reduceat(angle, starts),
            np.minimum.reduceat(norm, starts), np.maximum.reduceat(norm, starts),
        )


def score_bounds(a: Bounds, b: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """No score of a row of ``a`` with a row of ``b`` is below the first or above the second.

    For every reference, two angles to it bound the angle between two rows from both
    sides; the narrowest interval over all references, as cosines, times the lengths.
    """
    least, most = np.zeros((len(a.short), len(b.short))), np.full((len(a.short), len(b.short)), np.pi)
    for k in range(a.near.shape[1]):
        gap = np.maximum(b.near[None, :, k] - a.far[:, None, k], a.near[:, None, k] - b.far[None, :, k])
        both = a.far[:, None, k] + b.far[None, :, k]
        around = 2 * np.pi - (a.near[:, None, k] + b.near[None, :, k])
        least = np.maximum(least, gap)
        most = np.minimum(most, np.minimum(both, around))
    high = np.cos(np.clip(least - _ANGLE, 0, np.pi))
    low = np.cos(np.clip(most + _ANGLE, 0, np.pi))
    short, long = a.short[:, None] * b.short[None, :], a.long[:, None] * b.long[None, :]
    slack = long * _SHARE + _SCORE
    return np.where(low < 0, low * long, low * short) - slack, np.where(high > 0, high * long, high * short) + slack


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: floating-point products where all sums are exact, Python's integers beyond.

    Those beyond a long are held just below ``NONE`` and its negative, so that no score reaches it.
    """
    most = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), 1 - NONE, NONE - 1).astype(np.int64)


def first_of(value: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` highest values, equal ones by key."""
    if len(value) > 4 * most:
        cut = np.partition(value, len(value) - most)[len(value) - most]
        chosen = np.flatnonzero(value >= cut)
        return chosen[np.lexsort((key[chosen], -value[chosen]))[:most]]
    return np.lexsort((key, -value))[:most]


def windows(scores_of: Sequence[int]) -> list[tuple[int, int]]:
    """Least and largest score of a negative for each positive's score."""
    return [(-(-LEAST * p // 100), MOST * p // 100) for p in scores_of]


class Block:
    """Rows that are scored together, as they travel."""

    def __init__(self, row: dict, base: np.ndarray):
        self.keys = np.array(row["keys"], dtype=np.int64)
        self.x = unpack(row["vectors"], row["dim"])
        directions, self.norm = unit(self.x)
        self.angle = angles(directions, base)

    def bounds(self, run: int) -> Bounds:
        return Bounds.of(self.angle, self.norm, run)


def _blocks(placed: DataFrame, size: int, name: str) -> DataFrame:
    """One row per block of at most ``size`` places of a label and length: its rows in their order."""
    item = F.sort_array(F.collect_list(F.struct("pos", "key", "packed")))
    found = placed.groupBy("label", "dim", F.floor((F.col("pos") - 1) / size).cast("bigint").alias("block")).agg(item.alias("items"))
    field = lambda f: F.transform("items", lambda x: x[f]).alias
    return materialize(found.select("label", "dim", "block", field("pos")("places"), field("key")("keys"), field("packed")("vectors")), name)


def _arrow_rows(df: DataFrame, schema: str, work) -> DataFrame:
    """Rows that ``work`` makes of each row."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = work(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def mine(
    df: DataFrame, label: Column, anchor: Column, key: str = "vec_id", vector: str = "embedding", name: str = "negatives",
    block: int = BLOCK, run: int = RUN, group: int = GROUP,
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are the ``POSITIVES`` other rows of its label with the highest
    scores; a positive's negatives are the first ``NEGATIVES`` rows of other labels whose
    score is ``LEAST`` to ``MOST`` percent of the positive's.  Equal scores go by key.

    * rows with a null key or label, a null vector or a null or non-finite component take
      no part; vectors of unequal length are never compared; zero vectors score 0.
    * each of several rows with one key counts, as anchor and as partner; rows with an
      anchor's key are no partners of it.  Sums beyond a long are held at its limits.
    * an empty table gives no rows; only the named columns are read, so names can't clash.

    Rows lie in blocks along (label, length, nearest reference, angle).  Every anchor is a
    stated query against all rows, in blocks: pairs of an anchor group and a block are
    dropped by their bounds before vectors travel, runs of a block before they are scored.
    ``block``, ``run`` and ``group`` are numbers of rows, rows and blocks; results don't depend on them.
    """
    rows = quantized(df, key, vector, label, anchor)
    sample = [r.ints for r in rows.select("ints", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(SAMPLE).collect()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = batch.column(3)
            sizes = ints.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = ints.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                x = flat[starts[own][:, None] + np.arange(dim)].reshape(len(own), dim).astype(np.int64)
                angle = angles(unit(x)[0], references(sample, dim))
                cell = angle.argmin(axis=1)
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(np.full(len(own), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(own)), cell]), pa.array(pack(x), pa.binary()), pa.array(np.ones(len(own), np.int64))],
                    names=["key", "label", "anchor", "dim", "cell", "angle", "packed", "one"],
                )

    placed = rows.mapInArrow(place, "key bigint, label string, anchor boolean, dim int, cell int, angle double, packed binary, one bigint")
    placed = running_sums(placed, ["label", "dim"], ["cell", "angle", "key"], {"pos": "one"}, name)
    placed = materialize(placed.select("label", "dim", "pos", "key", "anchor", "packed"), name)
    blocks = _blocks(placed, block, name)
    groups = _blocks(placed.where("anchor"), block * group, name)

    # positives: first those among the neighbours in an anchor's own block, which tell what others must reach
    found = "label string, dim int, pos bigint, key bigint, partner bigint, score bigint"
    home = placed.where("anchor").groupBy("label", "dim", F.floor((F.col("pos") - 1) / block).cast("bigint").alias("block"))
    home = blocks.join(home.agg(F.sort_array(F.collect_list("pos")).alias("anchors")), ["label", "dim", "block"])

    def near(row: dict) -> list:
        keys, x, first = np.array(row["keys"], dtype=np.int64), unpack(row["vectors"], row["dim"]), row["places"][0]
        out = []
        for start in range(0, len(row["anchors"]), 256):
            some = np.array(row["anchors"][start : start + 256]) - first
            for i, line in zip(some.tolist(), scores(x[some], x), strict=True):
                other = np.flatnonzero(keys != keys[i])
                top = other[first_of(line[other], keys[other], POSITIVES)]
                out += [(row["label"], row["dim"], first + i, int(keys[i]), int(keys[j]), int(line[j])) for j in top]
        return list(zip(*out, strict=True)) or [[]] * 6

    own = materialize(_arrow_rows(home, found, near), name)
    least = own.groupBy("label", "dim", "pos").agg(F.when(F.count("*") == POSITIVES, F.min("score")).alias("least"))

    def reach(row: dict) -> list:
        base = references(sample, row["dim"])
        left, right = Block({"keys": row["a_keys"], "vectors": row["a_vectors"], "dim": row["dim"]}, base), Block(row, base)
        runs, out = right.bounds(run), []
        # what an anchor's own block holds is known already
        known = [(p - 1) // block == row["block"] for p in row["a_places"]]
        floor = np.array([NONE if k else -NONE if x is None else x for k, x in zip(known, row["goals"], strict=True)], dtype=np.int64)
        for start in range(0, len(floor), 256):
            part = slice(start, start + 256)
            _, high = score_bounds(Bounds.of(left.angle[part], left.norm[part], 1), runs)
            hits: dict[int, list] = {}
            for k in np.flatnonzero((high >= floor[part, None]).any(axis=0)).tolist():
                who = np.flatnonzero(high[:, k] >= floor[part])
                line = scores(left.x[part][who], right.x[k * run : (k + 1) * run])
                for i, j in zip(*np.nonzero(line >= floor[part][who][:, None]), strict=True):
                    hits.setdefault(int(who[i]), []).append((int(line[i, j]), int(right.keys[k * run + j])))
            for i, pairs in hits.items():
                a = int(left.keys[start + i])
                value, other = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))
                value, other = value[other != a], other[other != a]
                out += [(row["label"], row["dim"], row["a_places"][start + i], a, int(other[j]), int(value[j])) for j in first_of(value, other, POSITIVES)]
        return list(zip(*out, strict=True)) or [[]] * 6

    goals = _with_goals(groups, least, "least", "bigint", block * group)
    pairs = _pairs(goals, blocks, sample, same=True, name=name)
    away = _arrow_rows(_payloads(pairs, goals, blocks), found, reach)
    order = Window.partitionBy("label", "dim", "pos").orderBy(F.desc("score"), "partner")
    positives = own.unionByName(away).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= POSITIVES)
    positives = materialize(positives, name)

    listed = positives.groupBy("label", "dim", "pos").agg(F.sort_array(F.collect_list(F.struct("nth", "partner", "score"))).alias("wanted"))
    goals = _with_goals(groups, listed, "wanted", "array<struct<nth:int,partner:bigint,score:bigint>>", block * group)

    def between(row: dict) -> list:
        base = references(sample, row["dim"])
        left, right = Block({"keys": row["a_keys"], "vectors": row["a_vectors"], "dim": row["dim"]}, base), Block(row, base)
        runs, out = right.bounds(run), []
        for start in range(0, len(left.keys), 256):
            part = slice(start, start + 256)
            low, high = score_bounds(Bounds.of(left.angle[part], left.norm[part], 1), runs)
            open_runs, spans = np.zeros(low.shape, dtype=bool), []
            for i, wanted in enumerate(row["goals"][part]):
                spans.append([(w, *s) for w, s in zip(wanted or [], windows([w["score"] for w in wanted or []]), strict=True) if s[0] <= s[1]])
                for _, lo, hi in spans[-1]:
                    open_runs[i] |= (high[i] >= lo) & (low[i] <= hi)
            columns = np.flatnonzero(open_runs.any(axis=0))
            who = np.flatnonzero(open_runs.any(axis=1))
            if not len(who):
                continue
            some = np.concatenate([np.arange(k * run, min((k + 1) * run, len(right.keys))) for k in columns])
            keys, table = right.keys[some], scores(left.x[part][who], right.x[some])
            for i, line in zip(who.tolist(), table, strict=True):
                at = np.flatnonzero((line >= min(s[1] for s in spans[i])) & (line <= max(s[2] for s in spans[i])) & (keys != left.keys[start + i]))
                at = at[np.lexsort((keys[at], -line[at]))]
                falling = -line[at]
                for w, lo, hi in spans[i]:
                    first = int(np.searchsorted(falling, -hi))
                    for j in at[first : first + NEGATIVES]:
                        if line[j] >= lo:
                            out.append((row["a_label"], row["dim"], row["a_places"][start + i], int(left.keys[start + i]), w["nth"], w["partner"], w["score"], int(keys[j]), int(line[j])))
        return list(zip(*out, strict=True)) or [[]] * 9

    schema = "label string, dim int, pos bigint, key bigint, nth int, partner bigint, goal bigint, other bigint, score bigint"
    pairs = _pairs(goals, blocks, sample, same=False, name=name)
    found = _arrow_rows(_payloads(pairs, goals, blocks), schema, between)
    order = Window.partitionBy("label", "dim", "pos", "nth").orderBy(F.desc("score"), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select(
        F.col("key").alias("anchor_id"), F.col("partner").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _with_goals(groups: DataFrame, goals: DataFrame, value: str, kind: str, size: int) -> DataFrame:
    """Groups of anchors with what is known of each anchor, null where nothing is."""
    keyed = goals.groupBy("label", "dim", F.floor((F.col("pos") - 1) / size).cast("bigint").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", value))).alias("known")
    )
    known = F.coalesce("known", F.lit(None).cast(f"map<bigint,{kind}>"))
    return groups.join(keyed, ["label", "dim", "block"], "left").withColumn("goals", F.transform("places", lambda p: F.try_element_at(known, p))).drop("known")


def _summaries(blocks: DataFrame, sample, goals: str) -> DataFrame:
    """Bounds over each whole block, and the least that any of its anchors asks for."""

    def work(row: dict) -> list:
        x = Block(row, references(sample, row["dim"]))
        all_of = x.bounds(len(x.norm))
        floor = NONE
        for g in row["goals"] if goals else ():
            if goals == "least":  # an anchor with too few neighbours takes any
                floor = min(floor, -NONE if g is None else g)
            elif g:  # the last positive has the lowest score
                floor = min(floor, windows([g[-1]["score"]])[0][0])
        return [[row["label"]], [row["dim"]], [row["block"]], [all_of.near[0].tolist()], [all_of.far[0].tolist()], [float(all_of.short[0])], [float(all_of.long[0])], [floor]]

    schema = "label string, dim int, block bigint, near array<double>, far array<double>, short double, long double, floor bigint"
    return _arrow_rows(blocks, schema, work)


def _pairs(goals: DataFrame, blocks: DataFrame, sample, same: bool, name: str) -> DataFrame:
    """(a_label, a_block, label, dim, block): groups of anchors and blocks of the same or of other labels that may hold a partner."""
    a = _summaries(goals, sample, "least" if same else "wanted").select(*(F.col(c).alias(f"a_{c}") for c in ("label", "dim", "block", "near", "far", "short", "long", "floor")))
    a = a.withColumn("a_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    b = _summaries(blocks, sample, "").drop("floor").withColumn("salt", F.pmod(F.xxhash64("label", "block"), F.lit(SALTS)).cast("int"))
    on = (F.col("dim") == F.col("a_dim")) & (F.col("salt") == F.col("a_salt"))
    on = on & ((F.col("label") == F.col("a_label")) if same else (F.col("label") != F.col("a_label")))
    gap = F.array_max(F.zip_with(
        F.zip_with("near", "a_far", lambda x, y: x - y), F.zip_with("a_near", "far", lambda x, y: x - y), lambda x, y: F.greatest(x, y)
    ))
    high = F.cos(F.greatest(gap - _ANGLE, F.lit(0.0)))
    long, short = F.col("long") * F.col("a_long"), F.col("short") * F.col("a_short")
    most = F.when(high > 0, high * long).otherwise(high * short) + long * _SHARE + _SCORE
    kept = a.join(b, on).where(most >= F.col("a_floor"))
    return materialize(kept.select("a_label", "a_block", "label", "dim", "block"), name)


def _payloads(pairs: DataFrame, goals: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs with the vectors of both sides."""
    a = goals.select(
        F.col("label").alias("a_label"), "dim", F.col("block").alias("a_block"), F.col("places").alias("a_places"), F.col("keys").alias("a_keys"),
        F.col("vectors").alias("a_vectors"), "goals",
    )
    b = blocks.select("label", "dim", "block", "keys", "vectors")
    return pairs.join(a, ["a_label", "dim", "a_block"]).join(b, ["label", "dim", "block"])
