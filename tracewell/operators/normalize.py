"""Trace documents to typed runs and steps; value constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.functions import text, values


def tool_calls(calls: Column) -> Column:
    """Typed tool calls: name, textual output, and whether output/error say anything.

    A missing ``output`` is read from ``result``.  The text is kept for string
    outputs only, as the error-text rule looks at strings alone.
    """

    def typed(call: Column) -> Column:
        output = F.coalesce(F.to_json(call["output"]), F.to_json(call["result"]))
        error = F.to_json(call["error"])
        return F.struct(
            call["name"].alias("name"),
            F.when(output.startswith('"'), values.string_value(output)).alias("output_text"),
            (~values.is_empty(output)).alias("has_output"),
            (~values.is_empty(error)).alias("has_error"),
        )

    return F.transform(F.coalesce(calls, F.array()), typed)


def explode_documents(docs: DataFrame) -> DataFrame:
    """One raw row per step with its list position; list order is kept.

    The run_id of the document counts; the copy inside each step is dropped.
    """
    bare = F.transform("steps", lambda s: s.dropFields("run_id", "schema_version"))
    return docs.select(
        "run_id",
        "workflow",
        F.coalesce("first_pos", F.lit(0)).alias("_first"),
        F.posexplode(bare).alias("_pos", "s"),
    ).select("run_id", "workflow", (F.col("_first") + F.col("_pos")).alias("pos"), "s.*")


def normalize_steps(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed steps of all documents."""
    raw = explode_documents(docs)
    prompt, completion, total = (F.col(f"tokens.{c}") for c in ("prompt", "completion", "total"))
    zero = F.lit(0).cast("bigint")
    return raw.select(
        "run_id",
        "workflow",
        "pos",
        F.col("step").cast("bigint").alias("step"),
        "agent",
        F.coalesce("node_type", F.lit("llm")).alias("node_type"),
        values.one_of(F.col("status"), schema.STEP_STATUS, "SUCCESS").alias("status"),
        F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)).alias("latency_ms"),
        F.coalesce(prompt, zero).alias("tokens_prompt"),
        F.coalesce(completion, zero).alias("tokens_completion"),
        values.token_total(prompt, completion, total).alias("tokens_total"),
        F.coalesce("prompt", F.lit("")).alias("diff_summary"),
        "error",
        values.to_utc_timestamp(F.col("timestamp"), now).alias("timestamp"),
        F.lit(schema.SCHEMA_VERSION).alias("schema_version"),
        F.coalesce("input", F.lit("")).alias("raw_input"),
        F.coalesce("output", F.lit("")).alias("raw_output"),
        tool_calls(F.col("tool_calls")).alias("tool_calls"),
        values.state_or_raw(F.col("handoff.input_state"), F.col("input")).alias("input_state"),
        values.parse_state(F.col("handoff.filtered_state")).alias("filtered_state"),
        values.state_or_raw(F.col("handoff.output_state"), F.col("output")).alias("output_state"),
        "parent_step",
        "child_step",
    )


def normalize_runs(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed runs.  Only the first document of a run split over several counts."""
    return docs.where(F.coalesce("first_pos", F.lit(0)) == 0).select(
        "run_id",
        "workflow",
        values.to_utc_timestamp(F.col("timestamp"), now).alias("timestamp"),
        values.one_of(F.col("status"), schema.STEP_STATUS, "SUCCESS").alias("status"),
        F.coalesce("total_latency_ms", F.lit(0.0)).alias("total_latency_ms"),
        F.coalesce("total_tokens", F.lit(0).cast("bigint")).alias("total_tokens"),
        F.lit(schema.SCHEMA_VERSION).alias("schema_version"),
        "trace_path",
        "expected_output",
    )


def topics(docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Topic of each run: the first step state that names one, else the initial state.

    Within a step the input, output and filtered states are looked at in turn.
    """

    def of_step(s: Column) -> Column:
        h = s["handoff"]
        return F.coalesce(
            *(values.state_text(values.parse_state(h[f]), "topic") for f in ("input_state", "output_state", "filtered_state"))
        )

    named = F.filter(F.transform(F.coalesce("steps", F.array()), of_step), lambda t: t.isNotNull())
    initial = values.state_text(values.parse_state(F.col("initial_state")), "topic")
    first = F.coalesce("first_pos", F.lit(0))
    per_doc = docs.select(
        "run_id", first.alias("p"), F.get(named, F.lit(0)).alias("topic"), initial.alias("initial")
    )
    # documents of one run meet here only when a run was split
    return per_doc.groupBy("run_id").agg(
        text.leading(
            F.coalesce(
                F.min_by("topic", F.when(F.col("topic").isNotNull(), F.col("p"))),
                F.min_by("initial", F.when(F.col("initial").isNotNull(), F.col("p"))),
                F.lit(""),
            ),
            max_chars,
        ).alias("topic")
    )


def violations() -> dict[str, Column]:
    """Name → predicate of each broken value constraint of an evidence/extraction row."""
    return {
        "confidence": ~F.col("confidence").between(0, 1) | F.isnan("confidence"),
        "source_count": F.col("source_count") < 0,
        "entity_count": F.col("entity_count") < 0,
        "token_cost": F.col("token_cost") < 0,
        "status": ~F.col("status").isin(*schema.STEP_STATUS),
        "node_type": ~F.col("node_type").isin(*schema.NODE_TYPE),
        "category": ~F.col("category").isin(*schema.FAILURE_CATEGORY),
        "severity": ~F.col("severity").isin(*schema.RULE_SEVERITY),
        "priority_level": ~F.col("priority_level").isin(*schema.PRIORITY_LEVEL),
        "source": ~F.col("source").isin(*schema.EVIDENCE_SOURCE),
    }


def check_constraints(df: DataFrame) -> DataFrame:
    """Add ``violations``: the constrained columns of the frame that break a rule."""
    checks = [
        F.when(broken, F.lit(name)) for name, broken in violations().items() if name in df.columns
    ]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, offending rows with the broken constraints)."""
    checked = check_constraints(df)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def display_steps(steps: DataFrame) -> DataFrame:
    """Display forms of a step's time and latency."""
    return steps.select(
        "run_id",
        "step",
        text.format_ms(F.col("latency_ms")).alias("latency"),
        text.format_utc(F.col("timestamp")).alias("time"),
    )
