"""Totals and baseline that batches keep up to date equal those over all steps."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.sources import store
from tracewell.streaming import rollup

SCHEMA = "run_id string, step bigint, workflow string, agent string, status string, latency_ms double, tokens_total bigint, timestamp timestamp"
NOON = datetime(2024, 5, 1, 12)


def row(rng, run, step, minute):
    return (run, step, f"wf_{run}", "a", rng.choice(["SUCCESS", "SUCCESS", "FAILURE", "ERROR"]), 1e6 + rng.random(), rng.randrange(99), NOON + timedelta(minutes=minute))


def expected(rows):
    latest = {}
    for r in rows:
        if (r[0], r[1]) not in latest or latest[r[0], r[1]][7] <= r[7]:
            latest[r[0], r[1]] = r
    totals = {}
    for run in {k[0] for k in latest}:
        own = [latest[k] for k in sorted(latest) if k[0] == run]
        failed = [r[4] for r in own if r[4] != "SUCCESS"]
        totals[run] = (own[0][2], min(r[7] for r in own), failed[-1] if failed else "SUCCESS", pytest.approx(sum(r[5] for r in own)), sum(r[6] for r in own), len(own))
    return totals, [r[5] for r in latest.values()]


def test_batches_out_of_order_and_again(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "store")
    batches = [
        [row(rng, "a", s, s) for s in (3, 4)] + [row(rng, "b", 1, 1)],
        [row(rng, "a", s, s) for s in (1, 2)] + [row(rng, "c", 7, 1)],  # before what is known
        [row(rng, "a", 3, 50), row(rng, "b", 2, 2), row(rng, "b", 2, 60)],  # a step replaced, one repeated in the batch
    ]
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        rollup.merge_batch(df, root, "s", i)
        if i == 2:
            rollup.merge_batch(df, root, "s", i)  # a retry
            store.compact(spark, root, "totals")
    totals, latency = expected([r for b in batches for r in b])
    assert {r.run_id: tuple(r)[1:] for r in rollup.run_totals(spark, root).collect()} == totals
    base = rollup.baseline(spark, root).first()
    assert (base.n_runs, base.n_steps, base.active) == (3, len(latency), False)
    assert base.latency_mean == pytest.approx(statistics.mean(latency), rel=1e-12)
    assert base.latency_std == pytest.approx(statistics.stdev(latency), rel=1e-9)


def test_moments_merge_and_are_taken_back(spark):
    rng = random.Random(1)
    values = [(1e9 + rng.random(), rng.randrange(50)) for _ in range(300)]
    df = spark.createDataFrame(values, "latency_ms double, tokens_total bigint").withColumn("i", F.monotonically_increasing_id())
    kept = values[100:]
    ids = df.orderBy("i").limit(100)
    parts = [rollup.moments(df, 1), rollup.moments(ids, -1), rollup.moments(df.where("false"), 1)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("runs_n", F.lit(2).cast("bigint"))
    found = rollup.merged_baseline(rows).first()
    assert found.n_steps == 200
    assert found.latency_mean == pytest.approx(statistics.mean(v[0] for v in kept), rel=1e-12)
    assert found.latency_std == pytest.approx(statistics.stdev(v[0] for v in kept), rel=1e-6)
    assert found.token_std == pytest.approx(statistics.stdev(v[1] for v in kept), rel=1e-9)


def test_nothing_stored(spark, tmp_path):
    root = str(tmp_path / "none")
    assert rollup.run_totals(spark, root).isEmpty()
    base = rollup.baseline(spark, root).first()
    assert (base.n_steps, base.active, base.latency_mean) == (0, False, None)
