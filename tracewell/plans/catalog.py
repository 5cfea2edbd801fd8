"""Named queries over the activity, conversation and document tables.

Each takes (spark, sf_dir) and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.config import Config
from tracewell.functions import text, values
from tracewell.operators import (
    arbiter,
    diff,
    evaluate,
    explain,
    explore,
    extract,
    handoff,
    metrics,
    normalize,
    rules,
)
from tracewell.plans import analysis
from tracewell.plans.checks import CHECKS
from tracewell.plans.stored import STORED
from tracewell.session import materialize, work_dir
from tracewell.sources import activity, store, traces
from tracewell.streaming import capture

# agents as the conversation table names them, in rule order
TALK = Config(required_agents=("system", "user", "assistant"), upstream="user", downstream="assistant")


def _r(column: str, digits: int = 4) -> Column:
    return F.round(column, digits).alias(column)


def _runs(steps: DataFrame) -> DataFrame:
    return metrics.roll_up(steps, "event_id" if "pos" not in steps.columns else "pos")


def _frames(spark: SparkSession, sf_dir: str, positions: bool = False) -> analysis.TraceFrames:
    """Event runs.  Positions cost a shuffle of all events, so they are optional."""
    rank = activity.with_positions if positions else activity.with_order
    events = activity.event_steps(spark, sf_dir)
    steps = rank(events)
    return analysis.TraceFrames(events.select("run_id").distinct(), steps, steps, positions=positions)


def _evidence(frames: analysis.TraceFrames) -> DataFrame:
    return analysis.collect_evidence(frames, analysis.DEFAULT_ANALYZERS)


# ------------------------------------------------------------------- metrics


def runs_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(activity.event_steps(spark, sf_dir))
    return runs.withColumn("timestamp", text.format_time(F.col("timestamp")))


def list_runs_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(activity.event_steps(spark, sf_dir))
    top = explore.list_runs(runs, 25, status="ERROR", workflow="wf_1")
    return top.select("run_id", "workflow", "status", text.format_time(F.col("timestamp")).alias("timestamp"))


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.step_metrics(activity.ranked_event_steps(spark, sf_dir))
    return found.select(
        "run_id", "step", "agent", "latency_ms", "latency_flag", "tokens_prompt", "tokens_completion",
        "tokens_total", "execution_time_ms", "is_anomalous", F.array_join("anomaly_reasons", "; ").alias("reasons"),
    )


def _baseline(steps: DataFrame) -> DataFrame:
    return metrics.baseline(steps, steps.groupBy("run_id").agg(F.min("timestamp").alias("timestamp")))


def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _baseline(activity.event_steps(spark, sf_dir))
    return base.select(
        "active", "n_runs", "n_steps", *(_r(c) for c in ("latency_mean", "latency_std", "token_mean", "token_std"))
    )


def step_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.ranked_event_steps(spark, sf_dir)
    base = _baseline(activity.event_steps(spark, sf_dir))
    found = metrics.anomalous_steps(metrics.step_metrics(steps, base))
    return found.select("run_id", "step", "agent", F.array_join("anomaly_reasons", "; ").alias("reasons"))


def slowest_fastest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions are not part of the result, so an order key stands in for the step."""
    steps = activity.ordered_event_steps(spark, sf_dir).withColumn("step", F.col("pos"))
    measured = metrics.step_metrics(steps)
    runs = steps.select("run_id", "workflow").distinct()
    return metrics.run_metrics(runs, measured)


def agent_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.ordered_event_steps(spark, sf_dir).withColumn("step", F.col("pos"))
    return metrics.agent_latency(metrics.step_metrics(steps))


def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.event_steps(spark, sf_dir)
    runs = steps.groupBy("run_id").agg(F.min("timestamp").alias("timestamp"))
    return metrics.agent_summary(steps, runs).select(
        "agent", _r("avg_latency_ms"), "max_latency_ms", _r("avg_tokens"), "total_tokens", "run_count"
    )


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.cost_estimate(_runs(activity.event_steps(spark, sf_dir)))
    return found.select("runs", "total_tokens", _r("cost_estimate", 6))


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.long_metrics(activity.ranked_event_steps(spark, sf_dir))


def step_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = activity.event_steps(spark, sf_dir)
    shared = metrics.step_share(activity.with_positions(events), unranked=events)
    return shared.select(
        "run_id", "step", "agent", "latency_ms", "max_latency_ms", "run_latency_ms", "run_tokens", "run_steps",
        _r("latency_pct"),
    )


def trace_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.conversation_steps(spark, sf_dir)
    state = F.md5(activity.conversation_state(F.col("raw_output"), F.col("agent")))
    found = explore.timeline(steps, steps, F.length("raw_output"))
    return found.select("run_id", "step", "agent", F.col("agent_state").cast("bigint").alias("agent_state"), "run_steps", _r("latency_pct"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.event_steps(spark, sf_dir)
    newest = metrics.latest_run(steps.groupBy("run_id").agg(F.min("timestamp").alias("timestamp")))
    # positions are only worked out for the one run that is asked for
    chosen = activity.with_positions(metrics.steps_of(steps, newest))
    return metrics.step_metrics(chosen).select("run_id", "step", "agent", "latency_ms", "tokens_total", "latency_flag")


# --------------------------------------------------------------------- rules


def _numbered(spark: SparkSession, sf_dir: str, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a rule finds, with step numbers.  Only runs with a finding are numbered."""
    events = activity.event_steps(spark, sf_dir)
    hit = rule(activity.with_order(events)).select("run_id").distinct()
    return rule(activity.with_positions(metrics.steps_of(events, hit)))


def tool_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _numbered(spark, sf_dir, rules.tool_evidence)
    return found.select("run_id", "rule_id", "category", "severity", "agent", "step", "description", "confidence")


def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _numbered(spark, sf_dir, lambda steps: rules.emit(rules.profile(steps, steps), rules.counts_findings()))
    return found.select("run_id", "rule_id", "category", "agent", "step", "description")


def _workflow(steps: DataFrame, rule: str) -> DataFrame:
    found = rules.emit(rules.profile(steps), rules.workflow_findings()).where(F.col("rule_id") == rule)
    return found.select(
        "run_id", "rule_id", "category", "agent", "step", "description", F.col("emit_seq").cast("bigint").alias("emit_seq")
    )


def skipped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workflow(activity.ordered_event_steps(spark, sf_dir), "skipped_step_v1").drop("step")


def wrong_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir, lambda steps: _workflow(steps, "wrong_order_v1"))


def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = rules.profile(activity.conversation_steps(spark, sf_dir), config=TALK)
    return rules.emit(profile, rules.workflow_findings(TALK)).select("run_id", "rule_id", "agent", "step", "description")


def information_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one step in 97 could not be read, so that skipped comparisons occur as well
    steps = activity.ordered_event_steps(spark, sf_dir).withColumn("extraction_failed", F.col("k") % 97 == 5)
    return rules.information_loss(rules.profile(steps, steps)).drop("schema_version")


def analyzer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand for runs without steps, half of them with an expected output."""
    steps = activity.event_steps(spark, sf_dir)
    profile = steps.groupBy("run_id").agg(F.count("*").alias("n_steps"))
    nations = activity.read(spark, sf_dir, "nation").select(
        F.concat(F.lit("idle_"), F.col("n_nationkey").cast("string")).alias("run_id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("expected_output"),
    )
    runs = profile.select("run_id", F.lit("x").alias("expected_output")).unionByName(nations)
    return rules.analyzer_status(runs, profile)


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last turn of each conversation against a benchmark passage."""
    steps = activity.conversation_steps(spark, sf_dir)
    items = activity.read(spark, sf_dir, "benchmark")
    runs = (
        steps.select("run_id", "conv_id")
        .distinct()
        .withColumn("item_id", F.pmod("conv_id", items.agg(F.count("*")).scalar()))
        .join(items.withColumnRenamed("text", "expected_output"), "item_id")
    )
    finals = rules.final_outputs(steps)
    compared = rules.ground_truth(runs, finals)
    return rules.ground_truth_evidence(compared).select(
        "run_id", "rule_id", "agent", "severity", _r("confidence"), "rule_description"
    )


# ------------------------------------------------------------------- verdicts


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which agent is to blame for each run, by all rules together."""
    return analysis.analyze(_frames(spark, sf_dir), analysis.DEFAULT_ANALYZERS).drop("schema_version")


def loss_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.loss_analysis(_frames(spark, sf_dir))
    return found.select(
        "run_id", "error", "primary_cause", "priority_level", "primary_agent", "summary", "evidence_count"
    )


def ordered_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(_frames(spark, sf_dir, positions=True))
    found = arbiter.ordered_evidence(evidence)
    return found.select("run_id", "evidence_no", "rule_id", "agent", "step", "value")


def fallback_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    explained = explain.explain_fallback(arbiter.resolve(frames.runs, _evidence(frames)))
    return explained.select("run_id", "summary", "suggested_fix")


def _given_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All runs, and evidence of every source with given confidences: one finding per event of some kinds."""
    events = activity.ordered_event_steps(spark, sf_dir)
    kinds = (  # source, rule, category
        ("ground_truth", "gt_mismatch_v1", "verification"), ("rule_engine", "tool_failure_v1", "execution"),
        ("workflow_validator", "wrong_order_v1", "workflow"), ("consistency_validator", None, "reasoning"),
        ("metrics_analyzer", None, "execution"), ("rule_engine", "hallucination_v1", "reasoning"),
    )
    pick = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in kinds)), (F.col("k") % 60 + 1).cast("int"))
    given = {
        "source": pick(0), "rule_id": pick(1), "category": pick(2), "agent": F.col("agent"), "value": F.lit("FAIL"),
        "confidence": F.col("k") / 1000, "emit_seq": F.col("pos"), "analyzer_ord": F.lit(0), "emit_idx": F.lit(0),
        "severity": F.lit("high"), "description": F.lit("given"), "rule_description": F.lit("given"),
    }
    found = events.where(F.col("k") % 60 < len(kinds))
    columns = (given.get(c, F.lit(None)).cast(t).alias(c) for c, t in schema.EVIDENCE_COLUMNS if c != "run_id")
    return events.select("run_id").distinct(), found.select("run_id", *columns)


def grounded_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over given evidence of all sources: P1 to P3, and P5 with and without evidence."""
    judged = explain.explain_fallback(arbiter.resolve(*_given_evidence(spark, sf_dir)))
    return judged.select(
        "run_id", "primary_cause", "priority_level", "grounded", "primary_agent", "deciding_rule", "confidence",
        "first_rule", "evidence_count", "rule_count",
    )


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts with their evidence nested, two findings to a row."""
    found = arbiter.bundles(*_given_evidence(spark, sf_dir), chunk=2)
    sources = F.array_join(F.transform(F.coalesce("evidence", F.array()), lambda e: e["source"]), ",")
    matches = F.array_join(F.transform(F.coalesce("rule_matches", F.array()), lambda e: e["rule_id"]), ",")
    return found.select("run_id", "part", "priority_level", sources.alias("sources"), matches.alias("rules"))


def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace documents written as files, scanned, normalised and judged by the agents' own output."""
    call = lambda c: F.struct(
        c["name"].alias("name"), c["output_text"].alias("output"), F.when(c["has_error"], F.lit("Error: failed")).alias("error")
    )
    steps = activity.ranked_event_steps(spark, sf_dir).select(
        "run_id", "pos", F.col("step").cast("int").alias("step"), "agent", "latency_ms", "status",
        F.to_json(F.struct("source_count", "entity_count")).alias("output"),
        F.transform("tool_calls", call).alias("tool_calls"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    runs = activity.event_steps(spark, sf_dir).groupBy("run_id", "workflow").agg(F.count("*").alias("step_count"))
    docs = traces.nest_documents(runs, steps, [c for c in steps.columns if c not in ("run_id", "pos")])
    path = work_dir(spark, "traces")
    traces.write_traces(docs, path)
    frames = analysis.frames_from_documents(traces.scan_traces(spark, path, one_per_file=False))
    return analysis.analyze(frames, analysis.DEFAULT_ANALYZERS).drop("schema_version")


def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    evidence = materialize(_evidence(frames), "evidence")
    return explain.prompts(arbiter.resolve(frames.runs, evidence), evidence)


def verdict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    judged = explain.explain_fallback(arbiter.resolve(frames.runs, _evidence(frames)))
    return explain.verdict_report(judged, frames.loss)


def coarse_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    judged = arbiter.resolve(frames.runs, _evidence(frames))
    return arbiter.coarse_verdict(judged, frames.loss).select("run_id", "priority_level", "verdict")


def run_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explorer(spark, sf_dir, 50)


def _explorer(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    """Newest runs (all without a limit) with their verdict; only those runs are analysed."""
    steps = activity.event_steps(spark, sf_dir)
    runs = materialize(metrics.newest_runs(_runs(steps), limit), "shown-runs")
    shown = steps if limit is None else metrics.steps_of(steps, runs)
    shown = materialize(activity.with_order(shown), "shown-steps")
    named = F.when(F.col("k") % 4 == 0, F.concat(F.lit("topic "), F.col("k").cast("string")))
    topics = shown.groupBy("run_id").agg(F.min_by(named, F.when(named.isNotNull(), F.col("pos"))).alias("topic"))
    frames = analysis.TraceFrames(runs.select("run_id"), shown, shown, positions=False)
    judged = analysis.analyze(frames, analysis.DEFAULT_ANALYZERS)
    rows = explore.explorer_rows(runs, shown, topics, limit)
    return explore.with_verdict(rows, judged, frames.loss)


def explorer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explore.cards(_explorer(spark, sf_dir, None))
    return found.select(
        "total_runs", "analyzed_runs", _r("avg_latency_ms"), "total_tokens", _r("cost_estimate", 6), "warnings"
    )


# ------------------------------------------------------------------- handoffs


def handoff_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = activity.conversation_handoffs(activity.conversation_steps(spark, sf_dir)).withColumns(
        {
            "input_state": values.parse_state(F.col("input_text")),
            "filtered_state": values.parse_state(F.col("returned_text")),
        }
    )
    found = handoff.handoff_diff(handoff.finalize_handoff(turns))
    lists = [F.array_join(c, ",").alias(c) for c in ("added_keys", "modified_keys", "unchanged_keys", "dropped_keys")]
    return found.select(
        "run_id", "step", *lists, "has_information_loss", "has_mutations", "total_changes", "handoff_summary"
    )


# ------------------------------------------------- documents as traces (JSON)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event runs as trace documents, with a share of malformed fields."""
    k = F.col("k")
    counts = F.to_json(F.struct("source_count", "entity_count"))
    topic = F.concat(F.lit("topic "), k.cast("string"))
    steps = activity.ranked_event_steps(spark, sf_dir).select(
        "run_id",
        "pos",
        F.col("step").cast("int").alias("step"),
        "agent",
        F.lit("llm").alias("node_type"),
        F.to_json(F.struct(topic.alias("topic"), k.alias("k"))).alias("input"),
        F.when(k % 17 == 0, F.lit(" ")).otherwise(counts).alias("output"),
        F.when(k % 3 == 0, F.lit("added=['x']")).alias("prompt"),
        "latency_ms",
        F.struct(
            F.col("tokens_prompt").alias("prompt"),
            F.col("tokens_completion").alias("completion"),
            F.when(k % 5 == 0, F.lit(0)).otherwise(F.col("tokens_total")).alias("total"),
        ).alias("tokens"),
        F.struct(
            F.when(k % 7 == 0, F.lit(""))
            .when(k % 7 == 1, F.lit("{}"))
            .when(k % 7 == 2, F.lit("not json"))
            .otherwise(F.to_json(F.struct(F.lit("").alias("topic"), k.alias("n"), F.lit(True).alias("on"))))
            .alias("input_state"),
            F.when(k % 7 == 3, F.lit("[1]")).otherwise(counts).alias("output_state"),
        ).alias("handoff"),
        F.when(k % 11 == 0, F.lit("weird")).when(k % 11 == 1, F.lit("error")).when(k % 11 != 2, F.col("status")).alias("status"),
        F.when(k % 13 == 0, F.lit("not-a-time"))
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
        .alias("timestamp"),
    )
    runs = activity.event_steps(spark, sf_dir).groupBy("run_id", "workflow").agg(
        F.date_format(F.min("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("tokens_total").alias("total_tokens"),
        F.count("*").alias("step_count"),
    )
    return traces.nest_documents(runs, steps, [c for c in steps.columns if c not in ("run_id", "pos")])


def _reparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written out as JSON text and parsed again."""
    docs = _documents(spark, sf_dir)
    return traces.parse_traces(docs.select(F.to_json(F.struct("*")).alias("trace_json")))


def normalized_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = F.timestamp_seconds(F.lit(0))
    steps = normalize.normalize_steps(_reparsed(spark, sf_dir), now=unread)
    return steps.select(
        "run_id",
        "step",
        "pos",
        "agent",
        "status",
        text.format_utc(F.col("timestamp")).alias("timestamp"),
        "tokens_total",
        "diff_summary",
        F.array_join(F.array_sort(F.map_keys("input_state")), ",").alias("input_keys"),
        F.array_join(F.array_sort(F.map_keys("output_state")), ",").alias("output_keys"),
        F.coalesce(F.try_element_at("input_state", F.lit("k")), F.try_element_at("input_state", F.lit("n"))).alias("k_text"),
        "schema_version",
    )


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of conversations whose states are JSON text of mixed shape."""
    steps = activity.conversation_steps(spark, sf_dir)
    size = F.length("raw_output")
    named = F.to_json(F.struct(F.concat(F.lit("about "), F.repeat(F.col("agent"), 9)).alias("topic"), size.alias("n")))
    state = F.when(size % 3 == 0, named).when(size % 3 == 1, F.lit('{"topic": ""}')).otherwise(F.lit("plain"))
    shaped = steps.select(
        "run_id", "pos", F.struct(F.lit(None).cast("string").alias("input_state"), state.alias("output_state")).alias("handoff")
    )
    runs = steps.groupBy("run_id").agg(F.count("*").alias("n"))
    runs = runs.select("run_id", F.when(F.col("n") > 4, F.lit('{"topic": "opening"}')).alias("initial_state"))
    docs = traces.nest_documents(runs, shaped, ["handoff"])
    return normalize.topics(traces.parse_traces(docs.select(F.to_json(F.struct("*")).alias("trace_json"))))


def trace_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to files, scanned back and counted."""
    path = work_dir(spark, "traces")
    traces.write_traces(_documents(spark, sf_dir), path)
    steps = normalize.explode_documents(traces.scan_traces(spark, path, one_per_file=False))
    return steps.select("run_id", "workflow", "pos", F.col("step").cast("bigint").alias("step"), "agent", "latency_ms", "output")


def extraction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model responses, some of them broken."""
    k = F.col("k")
    response = (
        F.when(k % 19 == 0, F.lit("no json here"))
        .when(k % 19 == 1, F.lit('{"entity_count": 3}'))
        .when(k % 19 == 2, F.lit('{"source_count": -1, "entity_count": 3}'))
        .otherwise(
            F.to_json(F.struct("source_count", "entity_count", F.array("agent").alias("tool_calls"), F.array(k.cast("string")).alias("numbers")))
        )
    )
    steps = activity.event_steps(spark, sf_dir).withColumns(
        {
            "pos": F.col("event_id"),
            "step": F.col("event_id"),
            "raw_output": F.when(k % 17 == 0, F.lit("  ")).otherwise(F.lit("text")),
            "response": response,
            "response_tokens": F.col("tokens_total"),
        }
    )
    return extract.parse_responses(steps).select(
        "run_id", "step", "agent", "source_count", "entity_count", "extraction_failed", "error_message", "token_cost",
        F.array_join("tool_calls", ",").alias("tool_calls"), F.array_join("numbers", ",").alias("numbers"),
    )


def extraction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.event_steps(spark, sf_dir).withColumn("token_cost", F.col("tokens_prompt"))
    return extract.token_cost(steps, "agent")


def latest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.ranked_event_steps(spark, sf_dir)
    return extract.latest_per_agent(steps).select("run_id", "agent", "step", "source_count", "entity_count")


# --------------------------------------------------------------------- texts


def _document_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("run_id"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(1).cast("bigint").alias("step"),
        F.lit("researcher").alias("agent"),
        F.col("text").alias("raw_output"),
        "doc_id",
    )


def structural_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents recast as sectioned text: lines become bullets, the middle one a heading."""
    lines = F.split("raw_output", "\n")
    half = F.ceil(F.size(lines) / 2).cast("int")

    def bullets(part: Column) -> Column:
        return F.concat(F.lit("\n- "), F.array_join(part, "\n- "))

    sectioned = F.concat(
        F.lit("SOURCES:"), bullets(F.slice(lines, F.lit(1), half)),
        F.when(F.col("doc_id") % 3 != 0, F.lit("\nENTITIES:")).otherwise(F.lit("")),
        bullets(F.slice(lines, half + 1, F.size(lines))),
        F.when(F.col("doc_id") % 2 == 0, F.lit("\nKEY FINDINGS:\n- x")).otherwise(F.lit("")),
    )
    steps = _document_steps(spark, sf_dir).withColumn("sections", sectioned)
    return extract.counts_from_sections(steps, "sections").select(
        "run_id", "source_count", "entity_count", "extraction_failed"
    )


def field_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.counts_from_sections(_document_steps(spark, sf_dir))
    return found.select(
        "run_id",
        *(F.array_join(c, "|").alias(c) for c in ("references", "numbers", "dates")),
        F.size("claims").alias("n_claims"),
        F.array_join("claims", "|").alias("claims"),
    )


def checker_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns prefixed with the words a checker may open with."""
    size = F.length("raw_output")
    opening = F.when(size % 3 == 0, F.lit("  Approved. ")).when(size % 3 == 1, F.lit("NOT APPROVED ")).otherwise(F.lit(""))
    steps = activity.conversation_steps(spark, sf_dir).withColumn("raw_output", F.concat(opening, "raw_output"))
    found = extract.checker_approval(steps)
    return found.select("run_id", "step", "verified", F.length("verification_result").alias("n_result"), F.length("revision_notes").alias("n_notes"))


def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = activity.event_steps(spark, sf_dir)
    return steps.select(
        "event_id",
        text.format_ms(F.col("latency_ms")).alias("latency"),
        text.format_time(F.col("timestamp")).alias("time"),
        text.bar_percent(F.col("tokens_total").cast("double"), F.lit(640.0)).alias("pct"),
        text.agent_of_function(F.concat("agent", F.lit("_node"))).alias("agent"),
        F.length(F.concat("run_id", "agent")).alias("n_name"),
    )


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, compared = _diff(spark, sf_dir)
    return compared.select("run_a", "run_b", "agent", "ord", "lat_a", "lat_b", "tok_a", "tok_b", _r("similarity", 6))


def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, compared = _diff(spark, sf_dir)
    return diff.diff_runs(pairs, compared).select("run_a", "run_b", "first_divergence", _r("overall_similarity", 6))


def _diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every conversation against the next one."""
    steps = activity.conversation_steps(spark, sf_dir)
    pairs = steps.select("conv_id").distinct().selectExpr(
        "concat('conv_', conv_id) AS run_a", "concat('conv_', conv_id + 1) AS run_b"
    )
    return pairs, diff.diff_steps(steps, pairs)


# ---------------------------------------------------------------- evaluation


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document labels as categories of labelled runs."""
    return activity.read(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("run_id"),
        F.when(F.col("toxic") == 1, F.lit("reasoning_failure"))
        .when(F.col("quality") == 1, F.lit("pass"))
        .otherwise(F.lit("execution_failure"))
        .alias("category"),
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("researcher")).alias("expected_primary_agent"),
    )


def _label_frames(spark: SparkSession, sf_dir: str) -> analysis.TraceFrames:
    """Labelled documents as one-step runs; lines without a number are its sources."""
    steps = _document_steps(spark, sf_dir).join(_labels(spark, sf_dir).select("run_id"), "run_id", "left_semi")
    body = F.col("raw_output")
    steps = steps.select(
        "run_id", "pos", "step", "agent",
        F.expr(f"IF(length(raw_output) % 7 = 0, {activity.call(None, True)}, {activity.NO_CALLS}) AS tool_calls"),
        F.regexp_count(body, F.lit("[0-9]+")).alias("source_count"),
        F.lit(0).alias("entity_count"),
        F.lit(False).alias("extraction_failed"),
    )
    return analysis.TraceFrames(_labels(spark, sf_dir).select("run_id"), steps, steps, Config(required_agents=("researcher",)))


def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _label_frames(spark, sf_dir)
    per_run = evaluate.fired(_labels(spark, sf_dir), _evidence(frames))
    return evaluate.rule_recall(per_run).select(
        "category", "runs", "runs_with_findings", "runs_with_expected_rule", _r("recall", 6)
    )


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _label_frames(spark, sf_dir)
    return evaluate.confusion(_labels(spark, sf_dir), analysis.analyze(frames, analysis.DEFAULT_ANALYZERS))


def label_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _label_frames(spark, sf_dir)
    per_run = evaluate.fired(_labels(spark, sf_dir), _evidence(frames))
    return evaluate.false_positives(per_run).select("run_id", "findings")


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_distribution(_labels(spark, sf_dir))


# -------------------------------------------------------------------- storage


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = activity.event_steps(spark, sf_dir).select(
        "event_id",
        F.when(k % 9 == 0, F.lit("LATE")).otherwise(F.col("status")).alias("status"),
        F.when(k % 10 == 3, F.lit(1.5)).otherwise(k / 100).alias("confidence"),
        (F.col("source_count") - F.when(k % 25 == 3, 1).otherwise(0)).alias("source_count"),
    )
    _, bad = normalize.quarantine(rows)
    return bad.select("event_id", F.array_join("violations", ",").alias("violations"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "store")
    steps = activity.ranked_event_steps(spark, sf_dir)
    store.write_runs(_runs(activity.event_steps(spark, sf_dir)), steps, root, 0)
    stored = {t: store.read_table(spark, root, t) for t in ("runs", "steps", "metrics")}
    by_prefix = store.count_like(stored["runs"], "run_1%").select(F.lit("runs run_1*").alias("table_name"), "n_rows")
    return store.table_counts(stored).unionByName(by_prefix)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with a part of them written a second time, slower and failed."""
    steps = activity.ranked_event_steps(spark, sf_dir).select("run_id", "step", "agent", "status", "latency_ms")
    steps = materialize(steps, "upsert-steps")
    again = steps.where(F.col("agent") == "writer").withColumns(
        {"status": F.lit("FAILURE"), "latency_ms": F.col("latency_ms") + 1}
    )
    return store.upsert(steps, again, ("run_id", "step"))


def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs stored twice, the second time only for one workflow."""
    root = work_dir(spark, "store")
    runs = _runs(activity.event_steps(spark, sf_dir))
    store.write_batch(runs, root, "runs", 0)
    store.write_batch(runs.where(F.col("workflow") == "wf_2").withColumn("status", F.lit("SKIPPED")), root, "runs", 1)
    return store.read_table(spark, root, "runs").select("run_id", "workflow", "status", "total_tokens")


def metrics_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metrics appended twice; a repeated metric counts once."""
    root = work_dir(spark, "store")
    long = materialize(metrics.long_metrics(activity.ranked_event_steps(spark, sf_dir)), "long-metrics")
    for seq in (0, 1):
        store.write_batch(long, root, "metrics", seq)
    stored = store.read_table(spark, root, "metrics")
    return stored.groupBy("metric_name", "metric_unit").agg(
        F.count("*").alias("n_rows"), F.sum("metric_value").alias("total")
    )


def analysis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "store")
    store.write_batch(store.analysis_rows(_evidence(_frames(spark, sf_dir, positions=True))), root, "analysis", 0)
    stored = store.read_table(spark, root, "analysis")
    return stored.select(
        "run_id", "step", "analyzer", "category", "verdict", "confidence",
        F.get_json_object("details_json", "$.rule_id").alias("rule_id"),
        F.get_json_object("details_json", "$.agent").alias("agent"),
    )


# ------------------------------------------------------------------ streaming


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = activity.read(spark, sf_dir, "events").schema
    raw = capture.read_table_stream(spark, sf_dir, "events", layout)
    # event time in streams is TIMESTAMP; wall-clock times are taken as UTC
    return activity.as_steps(raw).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run totals assembled from the event stream."""
    out = work_dir(spark, "stream-runs")
    key = ("run_id", "event_id")
    capture.collect_steps(_event_stream(spark, sf_dir), key, "event_id", out, work_dir(spark, "progress")).awaitTermination()
    totals = capture.assembled_runs(spark, out, key, "event_id")
    return totals.withColumn("timestamp", text.format_time(F.col("timestamp")))


def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and token reports as two streams, stored and joined again."""
    both = _event_stream(spark, sf_dir)
    steps = both.select("run_id", "event_id", "agent", "timestamp")
    tokens = _event_stream(spark, sf_dir).select(
        "run_id", "event_id", (F.col("timestamp") + F.expr("INTERVAL 2 SECONDS")).alias("token_time"),
        F.col("tokens_prompt").alias("prompt"), F.col("tokens_completion").alias("completion"),
    )
    stored = []
    for name, rows in (("steps", steps), ("tokens", tokens)):
        stored.append(work_dir(spark, f"stream-{name}"))
        capture.append_parquet(rows, stored[-1], work_dir(spark, "progress")).awaitTermination()
    joined = capture.attach_tokens(*(spark.read.parquet(p) for p in stored), ("run_id", "event_id"), "1 MINUTE")
    return joined.select("run_id", "event_id", "agent", "tokens_prompt", "tokens_completion", "tokens_total")


def stream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalous steps flagged as they arrive, against a baseline snapshot."""
    snapshot = _baseline(activity.event_steps(spark, sf_dir)).first()
    flagged = capture.live_flags(_event_stream(spark, sf_dir), snapshot)
    out = work_dir(spark, "stream-flags")
    columns = ("run_id", "event_id", "agent", "latency_ms", "latency_flag", "statistical_flag")
    capture.append_parquet(flagged.select(*columns), out, work_dir(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps stored continuously, with their metrics."""
    root = work_dir(spark, "stream-store")
    steps = _event_stream(spark, sf_dir).withColumn("step", F.col("event_id"))
    capture.upsert_steps(steps, root, work_dir(spark, "progress")).awaitTermination()
    stored = store.read_table(spark, root, "steps")
    return stored.groupBy("agent", "status").agg(
        F.count("*").alias("n_steps"), F.sum("tokens_total").alias("tokens_total"), F.max("step").alias("last_step")
    )


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured step records: successful ones and ones that raised."""
    k = F.col("k")
    failed = F.col("status") == "ERROR"
    event = F.to_json(
        F.struct(
            "run_id", "workflow", F.col("event_id").alias("step"), F.concat("agent", F.lit("_node")).alias("agent"),
            F.lit("done").alias("output"), "latency_ms", "tokens_prompt", "tokens_completion",
            F.when(failed, F.lit("TimeoutError")).alias("error_type"),
            F.when(failed, F.concat(F.lit("after "), k.cast("string"))).alias("error_message"),
            F.to_json(F.struct(F.lit("t").alias("topic"), k.alias("n"))).alias("input_state"),
            F.to_json(F.struct((k + 1).alias("n"), F.col("agent").alias("by"))).alias("returned_state"),
        )
    )
    parsed = capture.parse_step_events(activity.event_steps(spark, sf_dir).select(event.alias("value")))
    return capture.record_steps(parsed).select(
        "run_id", "step", "agent", "raw_output", "status", "error", "tokens_total", "diff_summary"
    )


QUERIES = {
    f.__name__: f
    for f in (
        verdicts, runs_rollup, list_runs_topn, run_explorer, explorer_cards, step_metrics, baseline_stats,
        step_anomalies, slowest_fastest, agent_latency, agent_summary, cost_estimate, metrics_long, step_share,
        trace_timeline, latest_run, tool_rules, evidence_rules, latest_evidence, skipped_steps, wrong_order,
        role_order, information_loss, analyzer_status, ground_truth, loss_verdicts, grounded_verdicts, bundles,
        document_verdicts, ordered_evidence,
        fallback_explanation, prompt_table, verdict_report, coarse_verdicts, handoff_diff, normalized_steps, topic, trace_roundtrip,
        extraction_parse, extraction_cost, structural_counts, field_lists, checker_approval, display_formats,
        run_diff, first_divergence, label_eval, label_confusion, label_false_positives, label_distribution,
        quarantine, table_counts, upsert_latest, upsert_runs, metrics_store, analysis_rows, stream_runs,
        stream_tokens, stream_flags, stream_upsert, step_events,
    )
} | CHECKS | STORED
