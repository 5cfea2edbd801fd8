"""Joins of texts and vectors against brute force, with hot groups and edge cases."""

import random

import numpy as np
import pytest

from tracewell.llm import cover_tree, jaccard_join
from tracewell.llm.common import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_join(rows, gram=4, share=85):
    sets = {}
    for key, text in rows:
        w = (text or "").lower().split()
        size = min(gram, len(w))
        sets[key] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= share * max(1, len(sets[a] | sets[b])) and sets[a] & sets[b]
    ]
    component = roots(sets, links)
    return {k: (len(s), component[k]) for k, s in sets.items()}


def family_rows(seed, size):
    """Originals, exact copies, chains of edits, and texts that share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows, key = [], 0
    while key < size:
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 30, 60, 120]))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            rows.append((key, " ".join(base)))
            key += 1
            if rng.random() < 0.7 and len(base) > 10:
                base[rng.randrange(len(base))] = rng.choice(words)
    return rows


@pytest.mark.parametrize("gram,share", [(4, 85), (5, 80)])
def test_join_by_brute_force(spark, monkeypatch, gram, share):
    monkeypatch.setattr(jaccard_join, "BUCKET", 3000)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = family_rows(gram, 400) + [(1000 + i, f"hot text number one two three four five six {i % 2}") for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, " \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, gram=gram, share=share).collect()}
    assert found == plain_join(rows, gram, share)
    kept = {r.doc_id for r in jaccard_join.keep_one(df, gram=gram, share=share).collect()}
    assert kept == {c for _, c in found.values()}


@pytest.mark.parametrize("gram,share", [(4, 85), (5, 80)])
def test_number_of_links_by_brute_force(spark, monkeypatch, gram, share):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rows = family_rows(gram + 7, 250) + [(1000 + i, f"hot text number one two three four five six {i % 2}") for i in range(60)]
    base = [f"v{i}" for i in range(120)]
    rows += [(2000 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(0, 60, 2)]  # one family, all different
    rows += [(3000, None), (3001, " \n")]
    sets = {}
    for k, t in rows:
        w = (t or "").split()
        sets[k] = {tuple(w[i : i + gram]) for i in range(max(1, len(w) - gram + 1))} if w else set()
    near = lambda a, b: 100 * len(a & b) >= share * len(a | b) and bool(a & b)
    expected = {k: sum(near(s, t) for j, t in sets.items() if j != k) for k, s in sets.items()}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.n_links for r in jaccard_join.links(df, gram=gram, share=share).collect()} == expected
    assert max(expected[k] for k in range(2000, 2060, 2)) > 2
    assert jaccard_join.links(df.where("false")).count() == 0


def test_keep_one_with_repeated_rows_and_null_keys(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (6, "A b c d e"), (None, "a b c d e"), (7, "x"), (None, "y"), (8, None), (5, "z z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id or -1, r.text) for r in jaccard_join.keep_one(df).collect()), key=str)
    assert kept == sorted([(5, "a b c d e"), (7, "x"), (-1, "y"), (8, None), (5, "z z")], key=str)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.node: r.root for r in components(df, "a", "b", "test").collect()}
    assert found == roots({x for p in links for x in p}, links)
    assert components(df.where("false"), "a", "b", "test").count() == 0


def plain_links(rows, cosine):
    valid = {k: (g, np.array(v, dtype=float)) for k, v, g in rows
             if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v))}
    unit = {k: (g, v / np.linalg.norm(v)) for k, (g, v) in valid.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1])
             and float(unit[a][1] @ unit[b][1]) >= cosine]
    component = roots([k for k, _, _ in rows], links)
    return {k: (sum(k in p for p in links), component[k], component[k] == k) for k, _, _ in rows}


@pytest.mark.parametrize("cell", [2048, 40])
def test_cover_trees_by_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(cover_tree, "CELL", cell)
    monkeypatch.setattr(cover_tree, "FANOUT", 5)
    rng = np.random.default_rng(4)
    rows, key = [], 0
    for label, size in ((0, 260), (1, 60), (2, 1)):
        while sum(r[2] == label for r in rows) < size:
            base = rng.normal(size=6)
            for _ in range(rng.choice([1, 2, 12])):
                rows.append((key, (base + rng.normal(size=6) * rng.choice([0, 0.05, 0.3])).astype("f4").tolist(), label))
                key += 1
    odd = [None, [], [0.0] * 6, [float("nan")] * 6, [float("inf"), 1.0], [None, 1.0], [1e30] * 6, [1e-30] * 6, [1.0, 2.0]]
    rows += [(5000 + i, v, 0) for i, v in enumerate(odd)] + [(6000, [1.0] * 6, None)]
    rows += [(7000 + i, [float(i + 1)] * 6, 3) for i in range(90)]  # one direction, many lengths
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(df).collect()}
    assert found == plain_links(rows, cover_tree.COSINE)
    assert cover_tree.near_duplicates(df.where("false")).count() == 0


def test_vectors_with_repeated_and_null_keys(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.1], 0), (None, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(df).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False)], key=str)
