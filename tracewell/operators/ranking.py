"""Positions inside runs, without ever giving one task a whole run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.config import STEP_CHUNK
from tracewell.session import materialize


def dense_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Add the 0-based position of each row among the rows of its key.

    ``order`` must tell the rows of a key apart.  Rows are range-partitioned by key and
    order and stored with the number of their partition, so a key with most of the rows
    lies in as many partitions as its share asks for, whatever its values are.  Rows are
    numbered inside (key, partition); the counts of the partitions before, at most as
    many rows as keys plus partitions, give the offsets.
    """
    part = "_part"
    placed = materialize(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "positions")
    counts = placed.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    return (
        placed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, part])
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .drop("_rank", "_offset", part)
    )


def attach_to_steps(
    steps: DataFrame, per_key: DataFrame, keys: Sequence[str] = ("run_id",), chunk: int = STEP_CHUNK
) -> DataFrame:
    """Join per-run (or per-run-and-agent) values back to the steps.

    ``per_key`` must carry ``_last_pos``, the largest step position of the key.
    The join runs on (key, chunk of positions): a value is repeated once per
    ``chunk`` steps of its run, and a long run is joined by many tasks.
    """
    spread = per_key.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last_pos") / chunk)))
    ).drop("_last_pos")
    return (
        steps.withColumn("_chunk", F.floor(F.col("pos") / chunk))
        .join(spread, [*keys, "_chunk"])
        .drop("_chunk")
    )


def sliding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, aggregates: dict[str, Column]
) -> DataFrame:
    """Add aggregates over each row and the ``n`` - 1 rows before it in its key.

    ``order`` must tell the rows of a key apart; null keys are one key.  Rows are
    range-partitioned by key and order, so one key with all rows lies in many
    partitions.  Every partition is handed the last rows before its first one, at most
    ``n`` - 1 per key, by an equi-join on their positions; they may come from several
    partitions.  Windows then run inside (key, partition).
    """
    part, same = "_part", lambda names: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
    named = lambda found: found.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in found.columns if c not in keys))
    placed = materialize(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "windows")
    counts = placed.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    numbered = placed.withColumn("_rank", F.row_number().over(inside)).join(
        named(offsets.withColumnRenamed(part, "_own")), reduce(Column.__and__, [F.col(part) == F.col("_own"), *same(keys)])
    )
    numbered = numbered.select(*df.columns, part, (F.col("_offset") + F.col("_rank") - 1).alias("_place"))
    numbered = materialize(numbered, "windows")
    handed = offsets.where(F.col("_offset") > 0).select(
        *keys, F.col(part).alias("_to"), F.explode(F.sequence(F.greatest(F.col("_offset") - (n - 1), F.lit(0)), F.col("_offset") - 1)).alias("_wanted")
    ) if n > 1 else None
    rows = numbered.withColumn("_halo", F.lit(False))
    if handed is not None:
        halo = numbered.join(named(handed), reduce(Column.__and__, [F.col("_place") == F.col("_wanted"), *same(keys)]))
        rows = rows.unionByName(halo.select(*df.columns, F.col("_to").alias(part), "_place", F.lit(True).alias("_halo")))
    window = Window.partitionBy(*keys, part).orderBy("_place").rowsBetween(1 - n, 0)
    return rows.withColumns({name: a.over(window) for name, a in aggregates.items()}).where(~F.col("_halo")).drop(part, "_place", "_halo")
