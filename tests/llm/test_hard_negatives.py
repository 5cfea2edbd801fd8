"""Hard negatives against scoring everything with everything."""

import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives as hn


def brute(rows):
    """Results for (place, key, label, vector, anchor) rows."""
    taking = []
    for place, key, label, vector, anchor in rows:
        if None in (key, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taking.append((place, key, label, [math.floor(256 * float(x)) for x in vector], anchor))
    out = []
    for a in (r for r in taking if r[4]):
        score = lambda r: sum(x * y for x, y in zip(a[3], r[3], strict=True))
        partners = sorted(((-score(r), r[1], r[2] == a[2]) for r in taking if len(r[3]) == len(a[3]) and r[1] != a[1]))
        for value, key, same in [p for p in partners if p[2]][:5]:
            other = [(n, k) for n, k, s in partners if not s and 50 * -value <= 100 * -n <= 95 * -value]
            out += [(a[1], key, rank, k, -value, -n) for rank, (n, k) in enumerate(other[:3], 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(
        [(k, lab, v, a, "x", 1) for _, k, lab, v, a in rows], "vec_id bigint, label int, embedding array<double>, is_anchor boolean, pos string, block int"
    ).repartition(3)
    found = hn.mine(df, F.col("label"), F.col("is_anchor"), **sizes)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(seed, n=160):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        vector = [c + rng.gauss(0, rng.choice([0.05, 1.0])) for c in centre]
        rows.append([i, i if i % 17 else i // 2, rng.choice([0, 0, 1, 2]), vector, i % 9 == 0])
    rows[3][2] = None
    rows[4][3] = None
    rows[5][3] = [None, *rows[5][3][1:]]
    rows[6][3] = [math.nan, *rows[6][3][1:]]
    rows[7][3] = [math.inf, *rows[7][3][1:]]
    rows[8][1] = None
    rows[9][3] = [0.0] * 6
    rows[18][3] = [0.0] * 6
    rows[10][3] = rows[20][3] = rows[21][3] = rows[22][3] = rows[30][3]
    for i in range(40, 60):
        rows[i][3] = rows[i][3][:4]
    rows[61][3] = []
    rows[63][3] = []
    rows[64][3] = [x * 1e6 for x in rows[64][3]]
    rows[72][3] = [x * 3e9 for x in rows[72][3]]
    return [tuple(r) for r in rows]


def test_mining_equals_brute_force(spark):
    """In small blocks; the query's SQL covers the usual ones."""
    rows = table(3)
    found = mined(spark, rows, block=16, run=4, group=2)
    assert found == brute(rows) and len(found) > 50


def test_empty_table(spark):
    assert mined(spark, []) == []


VECTORS = st.lists(st.lists(st.integers(-300, 300), min_size=5, max_size=5), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(VECTORS, VECTORS, st.integers(1, 4))
def test_bounds_hold_every_score(a, b, run):
    x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    base = hn.references(a[:2], 5, 4)
    sides = []
    for rows in (x, y):
        directions, norm = hn.unit(rows)
        sides.append(hn.Bounds.of(hn.angles(directions, base), norm, run))
    low, high = hn.score_bounds(*sides)
    exact = x @ y.T
    for i in range(len(x)):
        for j in range(len(y)):
            assert low[i // run, j // run] <= exact[i, j] <= high[i // run, j // run]


def test_bounds_are_tight_along_a_reference():
    base = np.array([[1.0, 0.0]])
    rows = np.array([[300, 1], [0, 300], [-300, 5]], dtype=np.int64)
    directions, norm = hn.unit(rows)
    sides = hn.Bounds.of(hn.angles(directions, base), norm, 1)
    low, high = hn.score_bounds(sides, sides)
    assert high[0, 2] < -80_000 and low[0, 0] > 80_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 9)), max_size=60), st.integers(1, 6))
def test_first_of_breaks_ties_by_key(pairs, most):
    value, key = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
    chosen = [pairs[i] for i in hn.first_of(value, key, most)]
    assert chosen == sorted(pairs, key=lambda p: (-p[0], p[1]))[:most]


def test_wide_sums_are_whole_numbers():
    x = np.array([[1 << 30, 3], [-(1 << 30), 7]], dtype=np.int64)
    assert hn.scores(x, x).tolist() == [[int(sum(a * b for a, b in zip(p, q, strict=True))) for q in x.tolist()] for p in x.tolist()]
    assert hn.scores(np.array([[1 << 62]]), np.array([[1 << 62]])).tolist() == [[hn.NONE - 1]]
    assert (hn.unpack(hn.pack(x[:1] % 99) + hn.pack(x[1:]), 2) == np.vstack((x[:1] % 99, x[1:]))).all()
