"""Token reports attached to steps across micro-batches, in whatever order both arrive.

Steps that wait for their report, and reports that wait for their step, are one snapshot
per ingest number; a batch reads the snapshot before its own, so a retry changes nothing
and the cost of a batch grows with what waits, not with what was stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import schema
from tracewell.session import materialize
from tracewell.sources import store

KEY = ["run_id", "step"]
STEP, REPORT, CLOCK = "step", "report", "clock"
WAITING = f"kind STRING, {schema.ddl(schema.STEP_COLUMNS)}, seen TIMESTAMP"
TOKENS = ("tokens_prompt", "tokens_completion", "tokens_total")


def _path(root: str, number: int) -> str:
    return f"{root}/waiting/n{number:09d}"


def waiting(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest snapshot, or the newest before an ingest number."""
    # only snapshots that were written to the end
    found = [int(p.rsplit("/n", 1)[1].split("/")[0]) for p in store.found_paths(spark, f"{root}/waiting/n*/_SUCCESS")]
    found = [n for n in found if before is None or n < before]
    return spark.read.schema(WAITING).parquet(_path(root, max(found))) if found else spark.createDataFrame([], WAITING)


def _latest(rows: DataFrame) -> DataFrame:
    return store.latest(rows.withColumn("_seq", F.col("timestamp")), tuple(KEY), ("_seq",))


def attach_batch(batch: DataFrame, root: str, source: str, batch_id: int, wait: str) -> None:
    """Store what a batch of steps and reports settles; keep the rest waiting.

    ``batch`` has kind (step or report) and the columns of steps; a report carries its
    time as timestamp, tokens_prompt and tokens_completion.  A step and its report are
    stored once both are there.  A step whose report has not come when events ``wait``
    later have been seen is stored without tokens; a report that comes after its step was
    stored corrects it, and of several reports the last one counts.  A report whose step has
    not come by then is put aside in the table of reports, where a very late step finds it.
    """
    spark = batch.sparkSession
    number = store.ingest_number(spark, root, "steps", source, batch_id)
    shaped = store.conform(batch, [("kind", "string"), *schema.STEP_COLUMNS])
    held = waiting(spark, root, number)
    seen = held.where(F.col("kind") == CLOCK).select("seen").unionByName(shaped.select(F.col("timestamp").alias("seen")))
    last = seen.agg(F.max("seen").alias("seen")).first().seen
    rows = materialize(held.where(F.col("kind") != CLOCK).drop("seen").unionByName(shaped), "token-batch")
    steps = _latest(rows.where(F.col("kind") == STEP).drop("kind"))
    reports = _latest(rows.where(F.col("kind") == REPORT).drop("kind"))
    aside = store.read_table(spark, root, "reports", before=number)
    # very late steps meet reports that were put aside
    steps = materialize(steps, "token-steps")
    reports = materialize(_latest(reports.unionByName(aside.join(steps.select(*KEY), KEY, "left_semi"))), "token-reports")
    # what is stored of the keys in hand, found once
    keys = steps.select(*KEY).unionByName(reports.select(*KEY))
    stored = materialize(store.read_table(spark, root, "steps", before=number).join(keys, KEY, "left_semi"), "token-stored")
    plain = [c for c, _ in schema.STEP_COLUMNS if c not in TOKENS]
    zero = F.lit(0).cast("bigint")
    counted = [F.coalesce(c, zero).alias(c) for c in TOKENS[:2]]
    brought = reports.select(*KEY, *counted).withColumn("tokens_total", F.col("tokens_prompt") + F.col("tokens_completion"))
    matched = steps.select(*plain).join(brought, KEY)
    lone_reports = materialize(reports.join(steps.select(*KEY), KEY, "left_anti"), "token-late")
    corrections = stored.select(*plain).join(brought.join(lone_reports.select(*KEY), KEY, "left_semi"), KEY)
    corrections = materialize(corrections, "token-corrections")
    lone_steps = steps.join(reports.select(*KEY), KEY, "left_anti")
    early = F.col("timestamp") >= F.lit(last) - F.expr(f"INTERVAL {wait}") if last is not None else F.lit(True)
    early = F.coalesce(early, F.lit(False))
    # a step that was stored before keeps the tokens it had
    had = stored.select(*KEY, *TOKENS)
    given_up = lone_steps.where(~early).select(*plain).join(had, KEY, "left").select(*plain, *(F.coalesce(c, zero).alias(c) for c in TOKENS))
    store.write_batch(matched.unionByName(corrections).unionByName(given_up), root, "steps", number, source, batch_id)
    open_reports = lone_reports.join(corrections.select(*KEY), KEY, "left_anti")
    store.write_batch(open_reports.where(~early), root, "reports", number, source, batch_id)
    clock = spark.createDataFrame([(CLOCK, last)], "kind STRING, seen TIMESTAMP")
    kept = lone_steps.where(early).withColumn("kind", F.lit(STEP)).unionByName(open_reports.where(early).withColumn("kind", F.lit(REPORT)))
    kept.unionByName(clock, allowMissingColumns=True).select(*(c.split(" ")[0] for c in WAITING.split(", "))).write.mode("overwrite").parquet(_path(root, number))


def attach_continuously(events: DataFrame, root: str, checkpoint: str, wait: str) -> StreamingQuery:
    """Attach token reports to steps under ``root``; one stream may write to a root at a time."""
    source = store.source_name(checkpoint)
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: attach_batch(batch, root, source, batch_id, wait))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def attached_steps(spark: SparkSession, root: str) -> DataFrame:
    """All steps with the tokens known so far: stored ones, and those that still wait, with none."""
    stored = store.read_table(spark, root, "steps")
    held = waiting(spark, root).where(F.col("kind") == STEP).select(*stored.columns)
    zero = F.lit(0).cast("bigint")
    fresh = held.join(stored.select(*KEY, *(F.col(c).alias(f"_{c}") for c in TOKENS)), KEY, "left").select(
        *(F.coalesce(f"_{c}", zero).alias(c) if c in TOKENS else F.col(c) for c in stored.columns)
    )
    return stored.join(held.select(*KEY), KEY, "left_anti").unionByName(fresh)
