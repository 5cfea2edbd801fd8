"""Step events as a stream.

Captured steps are stored as they come, however late, and repeats are told apart when
the store is read; totals are derived from the stored steps.  No step waits in the
state of a stream, and none is dropped behind a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.config import DEFAULT, Config
from tracewell.functions import values
from tracewell.operators import handoff, metrics
from tracewell.sources import store

STEP_EVENT = """
  run_id STRING, workflow STRING, step BIGINT, agent STRING, output STRING, status STRING,
  error_type STRING, error_message STRING, latency_ms DOUBLE, tokens_prompt BIGINT,
  tokens_completion BIGINT, timestamp TIMESTAMP, input_state STRING, returned_state STRING
"""


def parse_step_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Typed step records from JSON event text.

    A step that raised keeps ``Type: message`` as its error, has no output, and
    hands its input state on unchanged.  ``unreadable_events`` has what is left out.
    """
    e = raw.select(F.from_json(column, STEP_EVENT).alias("e")).where("e.run_id IS NOT NULL").select("e.*")
    failed = F.col("error_type").isNotNull()
    zero = F.lit(0).cast("bigint")
    prompt, completion = (F.coalesce(c, zero) for c in ("tokens_prompt", "tokens_completion"))
    return e.select(
        "run_id",
        "workflow",
        "step",
        F.replace("agent", F.lit("_node"), F.lit("")).alias("agent"),
        F.when(failed, F.lit("")).otherwise(F.coalesce("output", F.lit(""))).alias("raw_output"),
        F.when(failed, F.lit("ERROR")).otherwise(F.coalesce("status", F.lit("SUCCESS"))).alias("status"),
        F.when(failed, F.concat(F.col("error_type"), F.lit(": "), F.coalesce("error_message", F.lit("")))).alias("error"),
        "latency_ms",
        prompt.alias("tokens_prompt"),
        completion.alias("tokens_completion"),
        (prompt + completion).alias("tokens_total"),
        "timestamp",
        "input_state",
        F.when(~failed, F.col("returned_state")).alias("returned_state"),
    )


def unreadable_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Rows whose text is no step event or names no run."""
    return raw.where(F.from_json(column, STEP_EVENT)["run_id"].isNull())


def record_steps(events: DataFrame) -> DataFrame:
    """Step events with their three states and what the step did to them.

    Row by row, so it serves streams as well.  A step that raised returned nothing,
    and its output state is its input state.
    """
    states = {
        "input_state": values.parse_state(F.col("input_state")),
        "filtered_state": values.parse_state(F.col("returned_state")),
    }
    merged = handoff.finalize_handoff(events.withColumns(states).drop("returned_state"))
    return handoff.handoff_diff(merged).withColumnRenamed("handoff_summary", "diff_summary")


def store_batches(path: str, source: str) -> Callable[[DataFrame, int], None]:
    """Sink that stores each micro-batch in a folder of its own; a retry replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/source={source}/batch={batch_id}")

    return write


def collect_steps(events: DataFrame, key: tuple[str, ...], order: str, out: str, checkpoint: str) -> StreamingQuery:
    """Store what run totals need of every step under ``out``; any number of streams may share it."""
    columns = dict.fromkeys((*key, "run_id", "workflow", order, "timestamp", "status", "latency_ms", "tokens_total"))
    return (
        events.select(*columns).writeStream
        .foreachBatch(store_batches(out, store.source_name(checkpoint)))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def assembled_runs(spark: SparkSession, out: str, key: tuple[str, ...], order: str) -> DataFrame:
    """Run totals of all stored steps; a repeated step counts once, its latest time wins."""
    steps = spark.read.option("basePath", out).parquet(out).drop("source", "batch")
    steps = steps.withColumn("_seq", F.col("timestamp"))
    return metrics.roll_up(store.latest(steps, key, ("_seq",)), order)


def upsert_steps(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Store steps and their metrics continuously; a repeated step replaces the old row.

    Every batch gets an ingest number above those in use, and keeps it when it is retried.
    """
    source = store.source_name(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        # the newest event wins when one batch repeats a step
        rows = store.latest(batch, ("run_id", "step"), ("timestamp_seq",))
        number = store.ingest_number(batch.sparkSession, root, "steps", source, batch_id)
        stored = store.write_batch(rows, root, "steps", number, source, batch_id)
        store.write_batch(metrics.long_metrics(stored), root, "metrics", number, source, batch_id)

    ordered = events.withColumn("timestamp_seq", F.col("timestamp"))
    return (
        ordered.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def attach_tokens(
    steps: DataFrame, tokens: DataFrame, key: tuple[str, ...], within: str, delay: str | None = None
) -> DataFrame:
    """Steps with the token counts reported for them, or none after ``within``.

    ``tokens`` carries the key, ``token_time``, ``prompt`` and ``completion``.  Both sides
    may be stored steps, or streams; streams need a ``delay`` and lose what comes later
    than that, so late arrivals ask for storing both sides first.
    """
    t = tokens if delay is None else tokens.withWatermark("token_time", delay)
    t = t.select(*(F.col(c).alias(f"_{c}") for c in key), "token_time", "prompt", "completion")
    s = steps if delay is None else steps.withWatermark("timestamp", delay)
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"_{c}"))
    near = (F.col("token_time") >= F.col("timestamp")) & (
        F.col("token_time") <= F.col("timestamp") + F.expr(f"INTERVAL {within}")
    )
    zero = F.lit(0).cast("bigint")
    prompt, completion = F.coalesce("prompt", zero), F.coalesce("completion", zero)
    return s.join(t, same & near, "leftOuter").select(
        *steps.columns,
        prompt.alias("tokens_prompt"),
        completion.alias("tokens_completion"),
        (prompt + completion).alias("tokens_total"),
    )


def live_flags(steps: DataFrame, snapshot: Row | None = None, config: Config = DEFAULT) -> DataFrame:
    """Anomalous steps of a stream, row by row.

    ``snapshot`` is the single baseline row as it stood when the stream started.
    """
    latency = F.col("latency_ms")
    usual = snapshot is not None and snapshot["active"] and snapshot["latency_std"] > 0
    limit = snapshot["latency_mean"] + config.latency_stddev_multiplier * snapshot["latency_std"] if usual else None
    flags = {
        "latency_flag": latency > config.latency_threshold_ms,
        "statistical_flag": latency > limit if usual else F.lit(False),
    }
    return steps.withColumns(flags).where(F.col("latency_flag") | F.col("statistical_flag"))


def append_parquet(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_table_stream(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A table of Parquet files as a stream; the table is one file or a folder of files.

    The path is a glob, which the file source resolves to either.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")
