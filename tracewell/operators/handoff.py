"""What each agent added to, changed in, or dropped from the shared state.

Both states of a handoff sit in the same row, so the key union is taken with map
and array functions: no explode, no shuffle, any number of steps per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import values


def _quoted(keys: Column) -> Column:
    """['a', 'b']"""
    quoted = F.transform(keys, lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def _changes(before: Column, after: Column) -> Column:
    """(key, kind) of every key with content on either side, in key order."""

    def kind(key: Column) -> Column:
        b, a = F.try_element_at(before, key), F.try_element_at(after, key)
        had, has = ~values.is_empty(b), ~values.is_empty(a)
        return (
            F.when(had & has, F.when(b == a, F.lit("unchanged")).otherwise(F.lit("modified")))
            .when(has, F.lit("added"))
            .when(had, F.lit("dropped"))
        )

    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), kind(k).alias("kind")))


def summary() -> Column:
    """added=['a'], modified=['b'], DROPPED=['c'] – only the parts that apply."""
    parts = [
        F.when(F.size(col) > 0, F.concat(F.lit(f"{label}="), _quoted(F.col(col))))
        for label, col in (("added", "added_keys"), ("modified", "modified_keys"), ("DROPPED", "dropped_keys"))
    ]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", F.lit("no changes")).otherwise(joined)


def handoff_diff(steps: DataFrame, before: str = "input_state", after: str = "output_state") -> DataFrame:
    """Steps with the key lists, flags and summary of their handoff."""

    def keys(kind: str) -> Column:
        return F.transform(F.filter("_changes", lambda c: c["kind"] == kind), lambda c: c["key"])

    return (
        # compared once per step; the four lists only pick from it
        steps.withColumn("_changes", _changes(F.col(before), F.col(after)))
        .withColumns({f"{kind}_keys": keys(kind) for kind in ("added", "modified", "unchanged", "dropped")})
        .drop("_changes")
        .withColumns(
            {
                "has_information_loss": F.size("dropped_keys") > 0,
                "has_mutations": F.size("modified_keys") > 0,
                "total_changes": (F.size("added_keys") + F.size("modified_keys") + F.size("dropped_keys")).cast("bigint"),
                "handoff_summary": summary(),
            }
        )
    )


def finalize_handoff(steps: DataFrame) -> DataFrame:
    """Output state of steps that only recorded what the agent returned."""
    return steps.withColumn(
        "output_state", values.merge_state(F.col("input_state"), F.col("filtered_state"))
    )
