"""Run totals and baseline kept up to date with every micro-batch.

Both are stored like any table, so reading them costs in proportion to runs and
ingests, not to steps.  A batch is merged into what was stored before its own ingest
number, so that a retried batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.config import DEFAULT, Config
from tracewell.operators.metrics import steps_of
from tracewell.session import materialize
from tracewell.sources import store

KEY = ("run_id", "step")
MEASURES = ("latency_ms", "tokens_total")


def _newest(batch: DataFrame) -> DataFrame:
    """One row per step: the latest of a batch that repeats one."""
    return store.latest(batch.withColumn("_seq", F.col("timestamp")), KEY, ("_seq",))


def partial_totals(steps: DataFrame) -> DataFrame:
    """What run totals are merged from; failures are known by the last step that had them."""
    status = F.col("status")
    return steps.groupBy("run_id").agg(
        F.min("workflow").alias("workflow"),
        F.min("timestamp").alias("timestamp"),
        F.max(F.when(status == "FAILURE", F.col("step"))).alias("last_failure"),
        F.max(F.when(status == "ERROR", F.col("step"))).alias("last_error"),
        F.max("step").alias("last_step"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("tokens_total").alias("total_tokens"),
        F.count("*").alias("step_count"),
    )


def merged(*parts: DataFrame) -> DataFrame:
    """Partial totals of disjoint sets of steps, merged by run."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    least, most, sums = ("workflow", "timestamp"), ("last_failure", "last_error", "last_step"), ("total_latency_ms", "total_tokens", "step_count")
    return rows.groupBy("run_id").agg(
        *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most), *(F.sum(c).alias(c) for c in sums)
    )


def moments(steps: DataFrame, sign: int) -> DataFrame:
    """One row: number, mean and squared deviations of each measure; ``sign`` -1 takes them back."""
    found = [F.lit(sign).alias("sign")]
    for c in MEASURES:
        found += [
            F.count(c).alias(f"{c}_n"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"),
            F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias(f"{c}_m2"),
        ]
    return steps.agg(*found[1:]).withColumn("sign", found[0])


def merged_baseline(parts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The baseline over all steps, from the moments of every ingest.

    Deviations around the common mean are those inside the parts plus those of the parts'
    means, so no sum of squares can cancel out; parts that are taken back count negative.
    """
    total = lambda c: F.sum(F.col("sign") * F.col(c))
    means = parts.agg(
        total("runs_n").alias("n_runs"),
        *(F.when(total(f"{c}_n") > 0, F.sum(F.col("sign") * F.col(f"{c}_n") * F.col(f"{c}_mean")) / total(f"{c}_n")).alias(f"{c}_all") for c in MEASURES),
    )

    def deviation(c: str) -> Column:
        around = F.col(f"{c}_m2") + F.col(f"{c}_n") * F.pow(F.col(f"{c}_mean") - F.col(f"{c}_all"), 2)
        n, spread = total(f"{c}_n"), F.sum(F.col("sign") * around)
        return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).otherwise(0.0)

    both = parts.join(F.broadcast(means))  # one row
    found = both.agg(
        F.coalesce(F.first("n_runs"), F.lit(0)).alias("n_runs"), F.coalesce(total("latency_ms_n"), F.lit(0)).alias("n_steps"),
        F.first("latency_ms_all").alias("latency_mean"), deviation("latency_ms").alias("latency_std"),
        F.first("tokens_total_all").alias("token_mean"), deviation("tokens_total").alias("token_std"),
    )
    return found.withColumn("active", (F.col("n_runs") >= config.min_runs_for_baseline) & (F.col("n_steps") > 0))


def merge_batch(batch: DataFrame, root: str, source: str, batch_id: int) -> None:
    """Store a batch of steps and merge it into totals and moments.

    Runs whose steps all come after the last one known are merged as sums.  Only where a
    batch goes back behind it, stored steps are looked up; runs in which it replaces some
    are added up again from their steps, and the moments of what was replaced are taken back.
    """
    spark = batch.sparkSession
    number = store.ingest_number(spark, root, "steps", source, batch_id)
    new = materialize(_newest(batch), "roll-up-batch")
    before = lambda table: store.read_table(spark, root, table, before=number)
    known = materialize(before("totals").join(new.select("run_id").distinct(), "run_id", "left_semi"), "roll-up-known")
    behind = new.join(known.select("run_id", "last_step"), "run_id").where("step <= last_step").select(*KEY)
    store.write_batch(new, root, "steps", number, source, batch_id)
    fresh, old = merged(known, partial_totals(new)), None
    if not behind.isEmpty():
        # the same table as the rows themselves: replaced steps, with what was stored of them
        old = materialize(before("steps").join(behind, list(KEY), "left_semi"), "roll-up-replaced")
        changed = old.select("run_id").distinct()
        # workflows don't change and are not stored with steps
        again = store.read_table(spark, root, "steps", before=number + 1)
        again = steps_of(again, changed).join(fresh.select("run_id", "workflow"), "run_id")
        fresh = fresh.join(changed, "run_id", "left_anti").unionByName(partial_totals(again))
    store.write_batch(fresh, root, "totals", number, source, batch_id)
    n_new = new.select("run_id").distinct().join(known.select("run_id"), "run_id", "left_anti").agg(F.count("*").cast("bigint").alias("runs_n"))
    rows = moments(new, 1).join(F.broadcast(n_new))  # one row
    if old is not None:
        rows = rows.unionByName(moments(old, -1).withColumn("runs_n", F.lit(0).cast("bigint")))
    store.write_batch(rows, root, "moments", number, source, batch_id)


def keep_totals(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep steps, run totals and moments under ``root``; steps may come late, out of order and again.

    One stream may write to a root at a time: totals build on those stored before.
    """
    source = store.source_name(checkpoint)
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: merge_batch(batch, root, source, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals of all runs, with the status of the last step that failed."""
    failed, error = F.col("last_failure"), F.col("last_error")
    status = F.when(error.isNotNull() & (failed.isNull() | (error >= failed)), "ERROR").when(failed.isNotNull(), "FAILURE").otherwise("SUCCESS")
    rows = store.read_table(spark, root, "totals")
    return rows.select("run_id", "workflow", "timestamp", status.alias("status"), "total_latency_ms", "total_tokens", "step_count")


def baseline(spark: SparkSession, root: str, config: Config = DEFAULT) -> DataFrame:
    """The baseline over all stored steps, without reading one of them."""
    return merged_baseline(store.read_table(spark, root, "moments"), config)
