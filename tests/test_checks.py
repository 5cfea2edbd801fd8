"""Checks with planted faults, hot runs and hot workflows, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import values
from tracewell.operators import checks, diff
from tracewell.operators.ranking import sliding


def walk(steps):
    """Chain, end and hops of every (run, step) by walking parents one by one."""
    links = {(r, s): (p, c) for r, s, p, c in steps}
    out = {}
    for run, step in links:
        own = sorted(s for r, s in links if r == run)
        at, hops = step, 0
        while hops <= len(own):
            parent = links[run, at][0]
            if parent is None:
                end = ("root" if at == own[0] else "orphan", at, hops)
                break
            if (run, parent) not in links:
                end = ("missing", at, hops)
                break
            at, hops = parent, hops + 1
        else:
            end = ("cycle", None, None)
        parent, child = links[run, step]
        unlinked = (run, parent) in links and links[run, parent][1] != step
        out[run, step] = (*end, unlinked, child is not None and (run, child) not in links and step != own[-1])
    return out


def test_chains_equal_a_walk(spark):
    rng = random.Random(3)
    steps = [("long", s, s - 1 if s > 1 else None, s + 1) for s in range(1, 301)]
    steps += [("loop", s, s - 1 or None, s + 1) for s in range(1, 20) if s != 5] + [("loop", 5, 12, 6)]
    steps += [("self", 1, 1, 2), ("self", 2, 1, None), ("one", 7, None, 8), (None, 1, None, None)]
    for run in range(12):
        n = rng.randrange(1, 14)
        steps += [(f"r{run}", s, rng.choice([None, s - 1, s - 1, rng.randrange(1, 16)]), rng.choice([None, s + 1, rng.randrange(1, 16)])) for s in range(1, n)]
    df = spark.createDataFrame([(r, s, None if p is None else str(p), None if c is None else str(c)) for r, s, p, c in steps],
                               "run_id string, step int, parent_step string, child_step string").repartition(5)
    found = {(r.run_id, r.step): (r.chain, r.end_step, r.hops, r.unlinked, r.dangling) for r in checks.chains(df).collect()}
    expected = walk([s for s in steps if s[0] is not None])
    assert {k: v for k, v in found.items() if k[0] is not None} == expected
    assert {v[0] for v in expected.values()} == {"root", "orphan", "missing", "cycle"}


def test_chains_of_nothing_and_of_odd_links(spark):
    empty = spark.createDataFrame([], "run_id string, step bigint, parent_step string, child_step string")
    assert checks.chains(empty).count() == 0
    odd = spark.createDataFrame([("a", 1, "x", ""), ("a", 2, "1", "3"), ("a", 2, "1", "3")], "run_id string, step bigint, parent_step string, child_step string")
    assert sorted((r.step, r.chain) for r in checks.chains(odd).collect()) == [(1, "root"), (2, "root")]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_sliding_window_of_a_hot_key(spark, n):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(n)
    rows = [("hot", i, rng.random() < 0.3) for i in range(400)] + [(k, i, True) for k in ("a", "b", None) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, i int, hit boolean").repartition(6)
    found = sliding(df, ["k"], ["i"], n, {"rows": F.count(F.lit(1)), "hits": F.count_if("hit")})
    parts = df.repartitionByRange("k", "i").select(F.spark_partition_id().alias("p"), "k").where("k = 'hot'").distinct().count()
    assert parts > 1  # the hot key does lie in several partitions
    got = {(r.k, r.i): (r.rows, r.hits) for r in found.collect()}
    by = {}
    for k, i, hit in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by.setdefault(k, []).append(hit)
        window = by[k][-n:]
        assert got.pop((k, i)) == (len(window), sum(window))
    assert not got
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_approval_streaks(spark):
    rows = [("w", f"r{i:02}", i, ok) for i, ok in enumerate([True] * 6 + [False] + [True] * 4 + [None] + [True] * 5)]
    rows += [("v", f"v{i}", 0, True) for i in range(4)]
    df = spark.createDataFrame(rows, "workflow string, run_id string, timestamp int, approved boolean")
    flagged = {r.run_id for r in checks.approval_streaks(df, 5).where("always_approves").collect()}
    assert flagged == {"r04", "r05", "r16"}


def test_circular_checks(spark):
    rows = [
        ("a", 0, "writer", "", "draft"), ("a", 1, "verifier", "draft", "fine"), ("a", 2, "verifier", "fine", "fine too"),
        ("a", 3, "writer", "fine too", "fine too"), ("a", 4, "verifier", "fine too", "x"), ("a", 5, "verifier", "fine too", "y"),
        ("b", 0, "verifier", None, ""), ("b", 1, "verifier", "", "z"), ("b", 2, "verifier", "Z", "z"), ("c", 9, "verifier", "q", "q"),
    ]
    df = spark.createDataFrame(rows, "run_id string, pos bigint, agent string, raw_input string, raw_output string")
    found = {(r.run_id, r.pos, r.previous_pos) for r in checks.circular_checks(df, "verifier").collect()}
    assert found == {("a", 2, 1), ("a", 4, 2)}


def test_handoff_contracts(spark):
    rows = [
        ("r", 0, "a", '{"x": 1, "y": "u", "z": 0}', '{"x": 2, "q": [1]}', None),
        ("r", 1, "b", '{"x": 1}', '{"x": 2.0, "y": ""}', '{"x": 1}'),
        ("r", 2, "c", "{}", "{}", None),
    ]
    df = spark.createDataFrame(rows, "run_id string, pos bigint, agent string, i string, o string, f string")
    df = df.withColumns({n: values.parse_state(F.col(c)) for n, c in (("input_state", "i"), ("output_state", "o"), ("filtered_state", "f"))})
    found = {r.pos: r for r in checks.handoff_contracts(df, {"b": ("y", "x"), "c": ("y", "x")}).collect()}
    assert set(found) == {0, 1}  # nothing follows the last step
    first, second = found[0], found[1]
    assert (first.missing_keys, first.dropped_keys, first.mutated_keys, first.shrunk) == (["y"], ["y"], ["x"], False)
    assert (second.missing_keys, second.dropped_keys, second.mutated_keys, second.shrunk) == (["y"], [], [], False)
    assert {r.pos: r.missing_keys for r in checks.handoff_contracts(df, {}).collect()} == {0: [], 1: []}


def test_step_checks(spark):
    rows = [(1, "SUCCESS", "x", " ", 5.0), (2, "ERROR", "x", None, 0.0), (3, "SUCCESS", "v", "ok", 0.0), (4, "SUCCESS", "v", "long enough answer indeed", 1.0), (5, None, "v", "", None)]
    df = spark.createDataFrame(rows, "id int, status string, agent string, raw_output string, latency_ms double")
    found = sorted((r.id, r.check) for r in checks.step_checks(df, "v").collect())
    assert found == [(1, "silent_failure"), (2, "failed_step"), (3, "suspiciously_fast"), (3, "trivial_check")]


def test_cosine_states_why_there_is_none(spark):
    pairs = [
        ([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0]), ([0.0], [1.0]), ([None], [1.0]), ([math.nan], [1.0]), ([math.inf], [1.0]), ([], []),
    ]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    value, reason = diff.cosine(F.col("a"), F.col("b"))
    found = [tuple(r) for r in df.select(value, reason).collect()]
    assert found[0][0] == pytest.approx(math.sqrt(0.5)) and found[0][1] is None
    assert [f[1] for f in found[1:]] == ["length", "missing", "zero", "invalid", "invalid", "invalid", "zero"]
    assert all(f[0] is None for f in found[1:])


def test_embedding_diff_needs_no_python(spark):
    from tracewell.plans.checks import embedding_diff

    plan = embedding_diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
