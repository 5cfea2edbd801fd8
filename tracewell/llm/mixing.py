"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, fresh, running_sums, small
from tracewell.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20


def offset(seed: int) -> float:
    """The one random offset of a mix."""
    return random.Random(seed).random()


def source_targets(
    sizes: DataFrame, source: str, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """One row (source, source_size, target) per source from per-document sizes.

    Sources in code point order, null last, have ``weights`` in turn and share the
    sum of all sizes.  No target exceeds ``most`` times its source's size; the excess
    goes to the others by weight.  With sources sorted by the level at which they
    are full, that shared level is the largest of (what is left) / (weights left).
    """
    per_source = (
        sizes.groupBy(source)
        .agg(F.sum("size").alias("source_size"))
        .select(source, "source_size", F.col(source).isNull().alias("_null"), F.lit(1).alias("_one"))
    )
    ranked = running_sums(per_source, [], ["_null", source], {"_rank": "_one"}, "mix-sources")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int")).cast("bigint")
    weighed = ranked.select(
        source, "_null", "source_size", weight.alias("_weight"), (F.col("source_size") * most).alias("_full"),
    ).withColumn("_level", F.col("_full").cast("double") / F.col("_weight").cast("double"))
    summed = materialize(
        running_sums(
            weighed, [], ["_level", "_null", source], {"_full_sum": "_full", "_weight_sum": "_weight"}, "mix-levels"
        ),
        "mix-targets",
    )
    whole = summed.agg(F.sum("source_size").alias("_all"), F.sum("_weight").alias("_weights"))
    left = F.col("_all") - F.col("_full_sum") + F.col("_full")
    weights_left = F.col("_weights") - F.col("_weight_sum") + F.col("_weight")
    level = (
        summed.join(F.broadcast(whole))  # one row
        .agg(F.max(left.cast("double") / weights_left.cast("double")).alias("_share"))
    )
    return summed.join(F.broadcast(level)).select(  # one row
        source,
        "source_size",
        F.least(F.col("_full").cast("double"), F.col("_share") * F.col("_weight").cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = SEED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """How often the mix takes each row: adds mix_size, mix_source_size, mix_target, mix_copies.

    Within a source, documents stand in order of size, then ``key``; each adds
    target / source size expected copies to a running sum that starts at one random
    offset, and is taken once for each whole number the sum passes.  Sampling along
    sizes keeps the words taken near the target.  ``keep`` names the columns of the
    result (default: all).

    * null or empty text: size 0; such rows are sampled like others of their source.
    * null source: a source of its own, last in order; null key: first of its size.
    * repeated rows: each is a row of its own; which of them gets a copy is immaterial.
    * a source without words: target 0, nothing taken.  An empty table stays empty.
    * columns named like the new ones: refused with ValueError.
    """
    new = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    kept = list(docs.columns if keep is None else keep)
    if clash := {c.lower() for c in kept} & set(new):
        raise ValueError(f"columns {sorted(clash)} exist already")
    src, k, size, row = fresh(docs, "_src", "_key", "size", "_row")
    one, place = fresh(docs, "_one", "_place")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    slim = docs.select(
        *kept, F.col(source).alias(src), F.col(key).alias(k), words.alias(size),
        F.monotonically_increasing_id().alias(row), F.lit(1).alias(one),
    )
    placed = running_sums(slim, [src], [size, k, row], {place: one}, "mix-rows", wide=True)
    # words are counted once more for the targets, which is cheaper than to store the rows twice
    targets = source_targets(docs.select(F.col(source).alias(src), words.alias("size")), src, weights, most)
    targets = small(targets, "mix-targets").withColumnsRenamed({"source_size": new[1], "target": new[2], src: f"{src}_t"})
    rate = F.when(F.col(new[1]) > 0, F.col(new[2]) / F.col(new[1]).cast("double")).otherwise(F.lit(0.0))
    start = F.lit(offset(seed))
    upto = F.floor(F.col(place).cast("double") * rate + start)
    before = F.floor((F.col(place) - 1).cast("double") * rate + start)
    return placed.join(targets, F.col(src).eqNullSafe(F.col(f"{src}_t"))).select(
        *kept, F.col(size).alias(new[0]), new[1], new[2], (upto - before).alias(new[3])
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mix`` as often as it is taken, without the added columns."""
    return (
        mixed.where("mix_copies > 0")
        .withColumn("mix_copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies"))))
        .drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    )
