"""Views of plain activity and conversation tables as runs and steps.

``events`` become numeric workflow steps, ``conversations`` become text steps.
All columns are row-level expressions, so the same code serves batch and
streaming frames; only the position of an event in its run needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.values import quoted
from tracewell.operators.ranking import dense_position

TOOL_CALLS = "array<struct<name:string,output_text:string,has_output:boolean,has_error:boolean>>"


# Order keys are microseconds times ORDER_UNIT plus the event.
ORDER_UNIT = 10**19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def call(output: str | None, failed: bool) -> str:
    """SQL of a list with one tool call."""
    said = "NULL" if output is None else quoted(output)
    has = str(output is not None).lower()
    return (
        f"CAST(array(named_struct('name', 'lookup', 'output_text', {said}, 'has_output', {has}, "
        f"'has_error', {str(failed).lower()})) AS {TOOL_CALLS})"
    )


NO_CALLS = f"CAST(array() AS {TOOL_CALLS})"


def as_steps(events: DataFrame) -> DataFrame:
    """One step per event: a run is a user's week, the event type names the agent."""
    week = "date_sub(to_date(ts), weekday(to_date(ts)))"
    agents = {"view": "researcher", "click": "writer", "purchase": "verifier", "signup": "router"}
    cases = " ".join(f"WHEN '{kind}' THEN '{agent}'" for kind, agent in agents.items())
    base = events.selectExpr(
        "event_id",
        "ts AS timestamp",
        f"concat('run_', user_id, '_', date_format({week}, 'yyyyMMdd')) AS run_id",
        "concat('wf_', user_id % 3) AS workflow",
        f"CASE event_type {cases} ELSE 'tool' END AS agent",
        "event_type = 'error' AS _error",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "round(value * 100, 0) AS latency_ms",
    )
    return base.selectExpr(
        "event_id",
        "timestamp",
        "run_id",
        "workflow",
        "agent",
        "k",
        "latency_ms",
        "floor(k * 10 / 3) AS tokens_prompt",
        "k * 10 - floor(k * 10 / 3) AS tokens_completion",
        "CAST(k * 10 AS BIGINT) AS tokens_total",
        "IF(_error, 'ERROR', 'SUCCESS') AS status",
        f"CASE WHEN _error AND k % 10 = 1 THEN {call(None, True)} "
        f"WHEN _error AND k % 50 = 3 THEN {call('Error: bad response', False)} "
        f"WHEN NOT _error AND k % 40 = 0 THEN {call(None, False)} "
        f"WHEN NOT _error AND k % 40 = 20 THEN {call('ok', False)} ELSE {NO_CALLS} END AS tool_calls",
        "8 + CASE k % 25 WHEN 3 THEN -8 WHEN 4 THEN 2 ELSE 0 END AS source_count",
        "10 + CASE k % 20 WHEN 0 THEN 5 WHEN 1 THEN -4 WHEN 2 THEN 1 ELSE 0 END AS entity_count",
        "false AS extraction_failed",
    )


def with_positions(steps: DataFrame) -> DataFrame:
    """Add ``pos`` and ``step``: the place of each event in its run by time, those without a time first."""
    return dense_position(steps, ["run_id"], ["timestamp", "event_id"]).withColumn("step", F.col("pos") + 1)


def with_order(steps: DataFrame) -> DataFrame:
    """Add ``pos`` as a mere order key, by time and then event, without a shuffle.

    Most verdicts only ask which of two steps came first.  A decimal is compared in
    place by hash aggregation, which a (time, event) struct would not be.
    """
    micros = (
        "unix_date(to_date(timestamp)) * 86400000000L + hour(timestamp) * 3600000000L "
        "+ minute(timestamp) * 60000000L + CAST(extract(SECOND FROM timestamp) * 1000000 AS BIGINT)"
    )
    return steps.selectExpr(
        "*",
        f"CAST(CAST({micros} AS DECIMAL(18,0)) * CAST({ORDER_UNIT} AS DECIMAL(20,0)) + event_id "
        "AS DECIMAL(38,0)) AS pos",
        "CAST(NULL AS BIGINT) AS step",
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unranked steps of the events table."""
    return as_steps(read(spark, sf_dir, "events"))


def ordered_event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_order(event_steps(spark, sf_dir))


def ranked_event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(event_steps(spark, sf_dir))


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step per turn; turns are numbered from 0 within a conversation."""
    text = F.col("text")
    length = F.length(text)
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("run_id"),
        F.lit("conversation").alias("workflow"),
        F.col("turn").alias("pos"),
        (F.col("turn") + 1).alias("step"),
        F.col("role").alias("agent"),
        text.alias("raw_output"),
        length.cast("double").alias("latency_ms"),
        F.floor(length / 4).cast("bigint").alias("tokens_total"),
        F.lit("SUCCESS").alias("status"),
    )


def conversation_state(text: Column, role: Column) -> Column:
    """State a turn leaves behind, as JSON text; members that are null are left out."""
    size = F.length(text)
    return F.to_json(
        F.struct(
            role.alias("role"),
            size.alias("n_chars"),
            F.regexp_count(text, F.lit("\n")).alias("n_lines"),
            text.contains(",").alias("has_comma"),
            (size % 2).cast("string").alias("parity"),
            F.when(size % 3 == 0, F.lit("")).otherwise(F.upper(role)).alias("mark"),
            F.when(size % 5 == 0, size % 7).alias("extra"),
        )
    )


def conversation_handoffs(steps: DataFrame) -> DataFrame:
    """Turns from the second on, with the state text handed over and returned.

    The previous turn is found by an equi-join on (run, position), so long
    conversations spread over tasks.
    """
    state = conversation_state(F.col("raw_output"), F.col("agent"))
    current = steps.select("run_id", "pos", "step", "agent", state.alias("returned_text"))
    previous = current.select("run_id", (F.col("pos") + 1).alias("pos"), F.col("returned_text").alias("input_text"))
    return current.join(previous, ["run_id", "pos"])
