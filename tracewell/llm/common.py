"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
FEW_ROWS = 50_000  # rows of numbers and names that may be broadcast
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def small(df: DataFrame, name: str, rows: int = FEW_ROWS) -> DataFrame:
    """The same rows, stored and counted: marked for broadcast if they are ``rows`` at most, else left to Spark."""
    stored = materialize(df, name)
    return F.broadcast(stored) if stored.count() <= rows else stored


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], name: str, wide: bool = False
) -> DataFrame:
    """Add inclusive running sums of columns along ``order`` inside each key.

    ``sums`` maps a new column to the column it adds up.  Rows are range-partitioned
    by key and order and written with their partition number, so a key with most of
    the rows lies in many partitions.  Sums run inside (key, partition); what lies
    before a partition comes from its per-partition totals, of which there are at
    most as many as keys plus partitions.  ``order`` should identify a row; rows that
    tie get the sums of some order among them.  ``wide`` rows, with whole texts, are worth
    counting the totals for, so that the join that adds them need not move the rows again.
    """
    part, *own = fresh(df, "_part", *(f"_before_{s}" for s in sums))
    placed = materialize(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), name)
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, part).agg(*(F.sum(c).alias(s) for s, c in sums.items()))
    before = totals.select(
        *(F.col(k).alias(f"{k}__k") for k in keys),
        F.col(part).alias(f"{part}__k"),
        *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(b) for s, b in zip(sums, own, strict=True)),
    )
    if wide:
        before = small(before, name)
    here = placed.withColumns({s: F.sum(c).over(inside) for s, c in sums.items()})
    same = F.col(part) == F.col(f"{part}__k")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    joined = here.join(before, same)
    return joined.withColumns({s: F.col(s) + F.col(b) for s, b in zip(sums, own, strict=True)}).drop(
        part, f"{part}__k", *own, *(f"{k}__k" for k in keys)
    )


def refuse_clash(df_columns: Sequence[str], new: Sequence[str]) -> None:
    """New columns must not hide columns that exist; names are compared without case."""
    if clash := {c.lower() for c in df_columns} & {c.lower() for c in new}:
        raise ValueError(f"columns {sorted(clash)} exist already")


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same work on batches, with freed memory handed back when a task ends: its Python worker lives on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    new: StructType,
    start: Callable[[], Callable[[list[bytes | None]], list[list]]],
    binary: bool = False,
    at_once: int = 4 << 20,
) -> DataFrame:
    """Add columns made from the texts of each Arrow batch; no shuffle.

    ``start`` runs once in each task and returns a function from the UTF-8 texts of a
    batch (None for null) to one list of values per new column; if that has an attribute
    ``close``, it is called when the task ends.  ``keep`` are the
    columns that come along; ``binary`` tells that the column holds bytes already.
    At most ``at_once`` bytes of text, or one longer text, are worked on together.  A
    session that has not set the bytes of an Arrow batch itself gets 8 MB ones.
    """
    refuse_clash(keep, new.names)
    conf = df.sparkSession.conf
    if conf.get(BATCH) in ("67108864", "67108864b"):  # Spark's own value
        conf.set(BATCH, "8m")
    slot = fresh(df, "_text")[0]
    # a text that is kept travels once: its bytes become the column again
    own = next((c for c in keep if c == text and not binary and dict(df.dtypes).get(c) == "string"), None)
    raw = F.col(text) if binary else F.col(text).cast("string").cast("binary")
    chosen = df.select(raw.alias(slot), *(c for c in keep if c != own))
    kinds = to_arrow_schema(new)
    names = [*keep, *kinds.names]
    place = None if own is None else list(keep).index(own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = start()
        as_text = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
        try:
            for batch in batches:
                for part in slices(batch, at_once):
                    columns = run(part.column(0).to_pylist())
                    made = [pa.array(values, type=kinds.field(i).type) for i, values in enumerate(columns)]
                    kept = part.columns[1:]
                    if place is not None:
                        kept.insert(place, pc.cast(part.column(0), options=as_text))
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=names)
                    del part, kept, made, columns
                del batch  # before the next one is read
        finally:
            getattr(run, "close", lambda: None)()

    kept = [chosen.schema[c] if c != own else df.schema[c] for c in keep]
    return chosen.mapInArrow(trimmed(work), StructType(kept + new.fields))


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``most`` bytes in the first column, or one row with more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def components(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, root): the smallest node reachable over the links, for every linked node.

    Large-star and small-star in turn: every node hands the smallest of its neighbours
    to the larger ones, then to the smaller ones.  Each is a minimum per node and a join,
    so a node with many links is never gathered; rounds grow with the logarithm of the
    longest path.  Every round is written to the shared folder.
    """
    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = materialize(df.distinct(), name)
        told = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return kept, (told.n, told.h)

    u, v = F.col(a), F.col(b)
    edges, told = stored(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, _ = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = told
        edges, told = stored(small.unionByName(least.select("u", F.col("m").alias("v"))))
        if told == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
