"""Compacted tables: lookups, retries, broken compactions, migrations."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.plans import stored
from tracewell.sources import store

SMALL = "/root/testdata/sf0.001"


def steps(spark, rows):
    return spark.createDataFrame(rows, "run_id string, step bigint, agent string, latency_ms double")


@pytest.fixture
def root(spark, tmp_path):
    """Three ingests, the first two compacted; a hot run among them."""
    root = str(tmp_path / "store")
    first = [(f"r{i}", s, "a", 1.0) for i in range(40) for s in (1, 2)] + [("hot", s, "a", 1.0) for s in range(200)]
    store.write_batch(steps(spark, first), root, "steps", 0)
    store.write_batch(steps(spark, [("r1", 2, "b", 2.0), ("r2", 9, "b", 2.0)]), root, "steps", 1)
    store.write_batch(steps(spark, [("r1", 1, "c", 3.0)]), root, "steps", 2)
    assert store.compact(spark, root, "steps").upto == 1
    return root


def shown(df):
    return {(r.run_id, r.step): (r.agent, r.latency_ms) for r in df.collect()}


def test_reads_equal_those_before_compaction(spark, root):
    found = shown(store.read_table(spark, root, "steps"))
    assert len(found) == 281 and found["r1", 1] == ("c", 3.0) and found["r1", 2] == ("b", 2.0) and found["r2", 9] == ("b", 2.0)
    assert found["r3", 1] == ("a", 1.0)
    store.compact(spark, root, "steps", keep=0)
    assert store.state(spark, root, "steps").upto == 2
    assert shown(store.read_table(spark, root, "steps")) == found
    assert store.compact(spark, root, "steps", keep=0).version == 2  # nothing new: no new version


def test_a_lookup_reads_one_bucket(spark, root):
    base = f"{root}/{store.state(spark, root, 'steps').base}"
    own = spark.range(1).select(store.bucket(F.lit("r1"), store.BUCKETS)).first()[0]
    spoiled = [f for f in glob.glob(f"{base}/bucket=*/part-*") if f"bucket={own}/" not in f]
    for path in spoiled:
        with open(path, "wb") as file:
            file.write(b"no parquet")
        crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
        os.path.exists(crc) and os.remove(crc)
    assert spoiled and shown(store.read_table(spark, root, "steps", "r1")) == {("r1", 1): ("c", 3.0), ("r1", 2): ("b", 2.0)}
    with pytest.raises(Exception, match="no parquet|not a Parquet|FAILED_READ_FILE|CANNOT_READ"):
        store.read_table(spark, root, "steps").collect()


def test_a_broken_compaction_changes_nothing(spark, root, monkeypatch):
    before = shown(store.read_table(spark, root, "steps"))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "put_state", fail)
        with pytest.raises(RuntimeError):
            store.compact(spark, root, "steps", keep=0)
    assert store.state(spark, root, "steps").upto == 1 and shown(store.read_table(spark, root, "steps")) == before


def test_two_writers_of_one_version_collide(spark, root):
    now = store.state(spark, root, "steps")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.put_state(spark, root, "steps", now)


def test_ingest_numbers_come_from_names(spark, root):
    assert store.ingest_number(spark, root, "steps", "s1", 0) == 3
    store.write_batch(steps(spark, [("x", 1, "s", 1.0)]), root, "steps", 3, "s1", 0)
    assert store.ingest_number(spark, root, "steps", "s1", 0) == 3  # a retry keeps its number
    assert store.ingest_number(spark, root, "steps", "s1", 1) == 4
    assert store.ingest_number(spark, root, "runs", "s1", 1) == 0


def test_recent_keys_do_not_shuffle_the_base(spark, root):
    plan = store.read_table(spark, root, "steps")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "BroadcastHashJoin" in plan


def test_recent_rows_are_dealt_before_they_are_sorted(spark, tmp_path):
    """A file of a few MB may hold millions of rows: no task may sort what its input split holds."""
    root = str(tmp_path / "store")
    rows = [("r", 1, "a", 1.0), ("r", 1, "a", 1.0), ("r", None, "a", 1.0), (None, 1, "a", 1.0), (None, None, "a", 1.0)]
    store.write_batch(steps(spark, rows), root, "steps", 0)
    store.write_batch(steps(spark, [(r, s, "b", 2.0) for r, s, *_ in rows]), root, "steps", 1)
    found = store.read_table(spark, root, "steps")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(run_id" in plan and "Aggregate" not in plan[plan.rindex("Exchange"):]
    assert found.count() == 4 and shown(found) == {(r, s): ("b", 2.0) for r, s, *_ in rows}


def test_migration_refuses_narrowing(spark, tmp_path):
    root = str(tmp_path / "store")
    for bad in (
        [c for c in schema.RUN_COLUMNS if c[0] != "status"],
        [(c, "int" if c == "total_tokens" else t) for c, t in schema.RUN_COLUMNS],
        [(c, "bigint" if c == "status" else t) for c, t in schema.RUN_COLUMNS],
    ):
        with pytest.raises(ValueError):
            store.migrate(spark, root, "runs", bad)
    store.migrate(spark, root, "runs", [*schema.RUN_COLUMNS, ("owner", "string")])
    runs = spark.createDataFrame([("r", "me")], "run_id string, owner string")
    store.write_batch(runs, root, "runs", 0)
    assert store.read_table(spark, root, "runs").select("run_id", "owner", "status").first() == ("r", "me", None)


def test_lookups_of_unknown_runs_and_empty_tables(spark, root):
    assert store.steps_of_run(spark, root, "nobody").count() == 0
    store.write_batch(steps(spark, []), root, "steps", 7)
    store.compact(spark, root, "steps", keep=0)
    assert store.read_table(spark, root, "steps").count() == 281


def test_documents_come_back_whole(spark):
    found = stored.stored_trace_steps(spark, SMALL).groupBy("run_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    assert found.where("n <> last + 1").isEmpty() and not found.where("n > 10").isEmpty()
