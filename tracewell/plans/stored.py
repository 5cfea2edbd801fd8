"""Queries over stored tables: lookups by run, compacted tables, changed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell import schema
from tracewell.functions import text, values
from tracewell.operators import metrics, normalize
from tracewell.session import materialize, work_dir
from tracewell.sources import activity, store, traces
from tracewell.streaming import rollup, tokens


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roll_up(activity.event_steps(spark, sf_dir), "event_id")


def _written(spark: SparkSession, sf_dir: str, documents: bool = False) -> tuple[str, str]:
    """A store of all event runs, compacted, with the writers' steps written again since; and the last run's id."""
    root = work_dir(spark, "store")
    steps = materialize(activity.ranked_event_steps(spark, sf_dir), "store-steps")
    runs = _runs(spark, sf_dir)
    docs = _documents(steps, runs) if documents else None
    store.write_runs(runs, steps, root, 0, docs)
    store.write_runs(runs.where("workflow = 'wf_1'"), steps.where("k % 3 = 0"), root, 1, docs)
    for table in ("runs", "steps", "metrics"):
        store.compact(spark, root, table, keep=0)
    again = steps.where("agent = 'writer'").withColumns({"status": F.lit("FAILURE"), "latency_ms": F.col("latency_ms") + 1})
    store.write_runs(runs.where("workflow = 'wf_2'").withColumn("status", F.lit("SKIPPED")), again, root, 2, docs)
    return root, runs.agg(F.max("run_id")).first()[0] or ""


def _documents(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """JSON documents of the runs, ten steps to one, with what was expected of them; runs of wf_0 have none."""
    shaped = steps.select("run_id", "pos", F.col("step").cast("int").alias("step"), "agent", "latency_ms", F.lower("agent").alias("output"))
    nested = traces.nest_documents(runs.select("run_id", "workflow", "step_count"), shaped, ["step", "agent", "latency_ms", "output"], chunk=10)
    return nested.where("workflow <> 'wf_0'").select(
        "run_id", "first_pos", F.to_json(F.struct("*")).alias("trace_json"), F.concat(F.lit("/traces/"), "run_id", F.lit(".json")).alias("trace_path"),
        F.concat(F.lit("expected of "), "run_id").alias("expected_output"),
    )


def stored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, run_id = _written(spark, sf_dir, documents=True)
    return store.run_of(spark, root, run_id).select(
        "run_id", "workflow", "status", "total_tokens", text.format_time(F.col("timestamp")).alias("timestamp"), "trace_path", "expected_output"
    )


def stored_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, run_id = _written(spark, sf_dir)
    return store.steps_of_run(spark, root, run_id)


def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, run_id = _written(spark, sf_dir)
    return store.metrics_of(spark, root, run_id).select("run_id", "step", "agent", "metric_name", "metric_value", "metric_unit")


def stored_trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all stored documents, parsed again from the runs table."""
    root, _ = _written(spark, sf_dir, documents=True)
    steps = normalize.explode_documents(store.documents_of(spark, root))
    return steps.select("run_id", "workflow", "pos", F.col("step").cast("bigint").alias("step"), "agent", "latency_ms", "output")


def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All current steps of a compacted table with a newer ingest, by agent and status."""
    root, _ = _written(spark, sf_dir)
    return store.read_table(spark, root, "steps").groupBy("agent", "status").agg(
        F.count("*").alias("n_steps"), F.sum("latency_ms").alias("latency_ms"), F.countDistinct("run_id").alias("n_runs")
    )


def migrated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs stored before and after the table got a column more and a wider one."""
    root = work_dir(spark, "store")
    old = [("run_id", "string"), ("workflow", "string"), ("total_tokens", "int")]
    store.put_state(spark, root, "runs", store.State(1, None, -1, store.BUCKETS, schema.ddl(old)))
    runs = _runs(spark, sf_dir)
    store.write_batch(runs.where("workflow <> 'wf_2'"), root, "runs", 0)
    store.migrate(spark, root, "runs", [("run_id", "string"), ("workflow", "string"), ("total_tokens", "bigint"), ("status", "string")])
    big = F.col("total_tokens") + F.lit(1 << 40)
    store.write_batch(runs.where("workflow <> 'wf_0'").withColumn("total_tokens", big), root, "runs", 1)
    return store.read_table(spark, root, "runs")


def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as one label file and scanned again."""
    path = work_dir(spark, "labels")
    rows = activity.read(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("run_id"),
        F.when(F.col("toxic") == 1, "reasoning_failure").when(F.col("quality") == 1, "pass").otherwise("execution_failure").alias("category"),
        (F.col("quality") == 1).alias("frozen"),
    )
    # one object per file and a bounded number of labels in each
    files = rows.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(64))).groupBy("part").agg(F.collect_list(F.struct("run_id", "category", "frozen")).alias("runs"))
    files.select(F.lit("1.0").alias("version"), "runs").write.json(path)
    return traces.scan_labels(spark, path, one_per_file=False).select("run_id", "category", "frozen")


def largest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the largest of the files that the text of each run was written to, and how many there are."""
    path = work_dir(spark, "trace-files")
    said = activity.event_steps(spark, sf_dir).where("k % 20 = 0").select("workflow", F.rpad(F.lit(""), 9, "x").alias("value"))
    said.repartition("workflow").write.partitionBy("workflow").text(path)
    files = traces.trace_files(spark, path, "part-*")
    named = F.regexp_extract("path", "workflow=([^/]*)/", 1)
    sizes = files.groupBy(named.alias("path")).agg(F.sum("file_size").alias("file_size"))
    return traces.largest_file(sizes).select(F.col("path").alias("workflow"), "file_size")


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read as JSON where they are, as plain texts where not, and written as JSON again."""
    k = F.col("k")
    said = (
        F.when(k % 5 == 0, F.concat(F.lit(' {"b": 1, "a": ['), k.cast("string"), F.lit("]} "))).when(k % 5 == 1, F.lit("[1, 2.50, null]"))
        .when(k % 5 == 2, F.lit("{broken")).when(k % 5 == 3, F.lit("7")).otherwise(F.lit('say "x"'))
    )
    steps = activity.event_steps(spark, sf_dir)
    return steps.select("event_id", values.safe_dumps(values.safe_loads(said)).alias("json"))


def _delivered(rows: DataFrame, name: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Stream the rows in five deliveries by their ``file``, one micro-batch to each; several tasks write the files of one."""
    spark, folder = rows.sparkSession, work_dir(rows.sparkSession, f"{name}-files")
    rows = materialize(rows, f"{name}-rows")
    layout = rows.drop("file").schema
    for i in range(5):
        rows.where(F.col("file") == i).drop("file").write.mode("append").parquet(folder)
        # takes all files that came since it ended last
        start(spark.readStream.schema(layout).parquet(folder)).awaitTermination()


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """Events as four deliveries, out of order, one to a batch; a fifth repeats some steps of the others, slower and failed."""
    steps = activity.event_steps(spark, sf_dir).select(
        "run_id", F.col("event_id").alias("step"), "workflow", "agent", "status", "latency_ms", "tokens_prompt", "tokens_completion",
        "tokens_total", F.col("timestamp").cast("timestamp").alias("timestamp"), (F.col("event_id") % 4).alias("file"), "k",
    )
    later = F.col("timestamp") + F.expr("INTERVAL 1 SECOND")
    again = steps.where("k % 25 = 2").withColumns({"latency_ms": F.col("latency_ms") + 1, "status": F.lit("FAILURE"), "timestamp": later, "file": F.lit(4)})
    root, progress = work_dir(spark, "stream-store"), work_dir(spark, "progress")
    _delivered(steps.unionByName(again).drop("k"), "step", lambda stream: rollup.keep_totals(stream, root, progress))
    return root


def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run totals kept by a stream over several files."""
    found = rollup.run_totals(spark, _streamed(spark, sf_dir))
    return found.withColumn("timestamp", text.format_time(F.col("timestamp")))


def incremental_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline merged from the moments of each batch."""
    found = rollup.baseline(spark, _streamed(spark, sf_dir))
    return found.select("active", "n_runs", "n_steps", *(F.round(c, 6).alias(c) for c in ("latency_mean", "latency_std", "token_mean", "token_std")))


def pending_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and token reports as five deliveries, out of order; some reports never come, some come twice."""
    steps = activity.event_steps(spark, sf_dir).select(
        "run_id", F.col("event_id").alias("step"), "agent", F.col("timestamp").cast("timestamp").alias("timestamp"), "k",
        F.lit(None).cast("bigint").alias("tokens_prompt"), F.lit(None).cast("bigint").alias("tokens_completion"),
        F.col("tokens_prompt").alias("p"), F.col("tokens_completion").alias("c"),
    )
    told = steps.where("k % 13 <> 0").withColumns({"tokens_prompt": F.col("p"), "tokens_completion": F.col("c"), "kind": F.lit("report")})
    again = told.where("k % 25 = 2").withColumns({"tokens_completion": F.col("c") + 1, "timestamp": F.col("timestamp") + F.expr("INTERVAL 1 SECOND"), "file": F.lit(4)})
    files = steps.withColumns({"kind": F.lit("step"), "file": F.col("step") % 4})
    files = files.unionByName(told.withColumn("file", F.floor(F.col("step") / 3) % 4)).unionByName(again.withColumn("file", F.lit(4).cast("bigint")))
    root, progress = work_dir(spark, "stream-store"), work_dir(spark, "progress")
    _delivered(files.drop("k", "p", "c"), "token", lambda stream: tokens.attach_continuously(stream, root, progress, "7 DAYS"))
    return tokens.attached_steps(spark, root).select("run_id", "step", "agent", *tokens.TOKENS)


STORED = {
    f.__name__: f
    for f in (
        stored_run, stored_steps, stored_metrics, stored_trace_steps, compacted_store, migrated_runs, label_file, largest_trace, json_values,
        incremental_runs, incremental_baseline, pending_tokens,
    )
}
