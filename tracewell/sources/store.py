"""Stored tables: runs, steps, metrics, analysis.

Every write is one Parquet folder named by its ingest number, its source and the
source's batch.  It replaces that folder when it is repeated, so a retried batch changes
nothing, and no source can touch what another one wrote, even under the same number.

``compact`` merges ingests into a base, one row per key, laid out in buckets of run ids
and sorted by key inside them.  Reads take the base and the ingests after it, of which
the latest row per key counts; the base is never shuffled for that while the recent
keys are few.  Which base counts, up to which ingest it goes, and the columns of the
table stand in a small state file of its own per version.  A version appears in one step
or not at all, so a compaction that breaks off leaves the table as it was.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.operators.explore import get_steps
from tracewell.operators.metrics import long_metrics, metrics_for_run
from tracewell.sources.traces import parse_traces

# table -> (columns, key).  A table without a key keeps every row.
TABLES = {
    "runs": (schema.RUN_COLUMNS, ("run_id",)),
    "steps": (schema.STEP_COLUMNS, ("run_id", "step")),
    "metrics": (schema.METRIC_COLUMNS, ("run_id", "step", "metric_name")),
    "analysis": (schema.ANALYSIS_COLUMNS, None),
}
# besides these: later parts of the documents of very long runs, and what streams keep up to date
LAYOUTS = {
    **TABLES,
    "documents": (schema.DOCUMENT_COLUMNS, ("run_id", "first_pos")),
    "totals": (schema.TOTAL_COLUMNS, ("run_id",)),
    "moments": (schema.MOMENT_COLUMNS, None),
    "reports": (schema.STEP_COLUMNS, ("run_id", "step")),
}

DIRECT = "direct"
INGEST = "ingest_seq BIGINT, source STRING, batch BIGINT"
ORDER = ("ingest_seq", "source", "batch")
BUCKETS = 16  # of a base written for the first time
STATE = "version BIGINT, base STRING, upto BIGINT, buckets INT, layout STRING"
# types that may take the place of others without loss
WIDER = {"tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint",), "float": ("double",)}


@dataclass(frozen=True)
class State:
    """Version of a table: its base, the last ingest in it, and its columns as DDL."""

    version: int
    base: str | None
    upto: int
    buckets: int
    layout: str

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.rsplit(" ", 1)) for c in self.layout.split(", ")]


def state(spark: SparkSession, root: str, table: str) -> State:
    """The newest version of a table; tables that were never compacted or migrated have version 0."""
    try:
        found = spark.read.schema(STATE).json(f"{root}/state/{table}/v*").orderBy(F.desc("version")).first()
    except AnalysisException:  # no version is stored
        found = None
    if found is None:
        return State(0, None, -1, BUCKETS, schema.ddl(LAYOUTS[table][0]))
    return State(**found.asDict())


def put_state(spark: SparkSession, root: str, table: str, new: State) -> None:
    """Store a version; fails if another writer has stored that version already."""
    values = (new.version, new.base, new.upto, new.buckets, new.layout)
    spark.createDataFrame([values], STATE).coalesce(1).write.json(f"{root}/state/{table}/v{new.version:09d}")


def conform(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The table's columns in order; missing ones are null, types are cast."""
    return df.select(
        *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns)
    )


def migrate(spark: SparkSession, root: str, table: str, columns: Sequence[tuple[str, str]]) -> None:
    """Change a table's columns: add some, or widen the types of some.

    Stored files stay as they are; reads give null for columns a file lacks and widen what
    it has.  Taking a column away or narrowing its type is refused with a ValueError.
    """
    now = state(spark, root, table)
    wanted = {c.lower(): t.lower() for c, t in columns}
    for name, kind in now.columns:
        new = wanted.get(name.lower())
        if new is None:
            raise ValueError(f"column {name} of {table} may not go")
        if new != kind.lower() and new not in WIDER.get(kind.lower(), ()):
            raise ValueError(f"column {name} of {table} may not change from {kind} to {new}")
    put_state(spark, root, table, replace(now, version=now.version + 1, layout=schema.ddl(columns)))


def latest(
    df: DataFrame, key: tuple[str, ...], seq: tuple[str, ...] = ("ingest_seq",), keep_order: bool = False
) -> DataFrame:
    """Newest row per key.

    ``max_by`` keeps one candidate per key and input task, so a key that was
    written a great many times does not meet in one task row by row.  A missing order
    comes before all others; of equal ones a hash of the row decides.  With
    ``keep_order`` the order columns come along.
    """
    rest = [c for c in df.columns if c not in (*key, *seq)]
    newest = F.struct(*seq, F.xxhash64(*rest))
    shown = F.struct(*rest, *(seq if keep_order else ()))
    return df.groupBy(*key).agg(F.max_by(shown, newest).alias("r")).select(*key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``old`` with rows of ``new`` put in by key; unmatched old rows survive."""
    marked = old.withColumn("ingest_seq", F.lit(0)).unionByName(
        new.withColumn("ingest_seq", F.lit(1)), allowMissingColumns=True
    )
    return latest(marked, key).select(*old.columns, *(c for c in new.columns if c not in old.columns))


def folder(root: str, table: str, ingest_seq: int, source: str = DIRECT, batch: int = 0) -> str:
    return f"{root}/{table}/ingest_seq={ingest_seq}/source={source}/batch={batch}"


def write_batch(
    df: DataFrame, root: str, table: str, ingest_seq: int, source: str = DIRECT, batch: int = 0
) -> DataFrame:
    """Store rows as one ingest; returns them as stored."""
    path = folder(root, table, ingest_seq, source, batch)
    rows = conform(df, state(df.sparkSession, root, table).columns)
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def source_name(checkpoint: str) -> str:
    """Name of the stream that keeps its progress in ``checkpoint``."""
    return "stream-" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def found_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, from the names in the folders alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in files.globStatus(path) or []]


def _numbers(paths: Sequence[str]) -> list[int]:
    return [int(p.split("ingest_seq=")[1].split("/")[0]) for p in paths]


def ingest_number(spark: SparkSession, root: str, table: str, source: str, batch: int) -> int:
    """The number a source's batch was stored under before, else one above all numbers in use.

    Only names of folders are looked at, no stored file.
    """
    if own := _numbers(found_paths(spark, f"{root}/{table}/ingest_seq=*/source={source}/batch={batch}")):
        return max(own)
    return max(_numbers(found_paths(spark, f"{root}/{table}/ingest_seq=*")), default=-1) + 1


def bucket(run_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, root: str, table: str, now: State, upto: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the ingests after the base, up to one of them, and rows of the base."""
    columns = f"{now.layout}, {INGEST}"
    if found_paths(spark, f"{root}/{table}"):
        recent = spark.read.schema(columns).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    else:  # nothing is stored yet
        recent = spark.createDataFrame([], columns)
    recent = recent.where(F.col("ingest_seq") > now.upto)
    if upto is not None:
        recent = recent.where(F.col("ingest_seq") <= upto)
    base = None if now.base is None else spark.read.schema(f"{columns}, bucket INT").parquet(f"{root}/{now.base}")
    return recent, base


def _current(recent: DataFrame, base: DataFrame | None, key: tuple[str, ...] | None) -> DataFrame:
    """Latest rows; what a recent ingest wrote takes the place of the base's row."""
    if key is None:
        return recent if base is None else base.select(*recent.columns).unionByName(recent)
    # dealt by run and step before they are sorted for the latest: files of a few MB hold many millions of
    # rows, which a task would sort whole to combine them; one ingest seldom has a key twice
    new = latest(recent.repartition(*key[:2]), key, (*ORDER,), keep_order=True)
    if base is None:
        return new
    return base.select(*new.columns).join(new.select(*key), list(key), "left_anti").unionByName(new)


def read_table(
    spark: SparkSession, root: str, table: str, run_id: str | None = None, before: int | None = None
) -> DataFrame:
    """Current rows of a stored table, or those of one run.

    A lookup of one run reads one bucket of the base, and of the ingests after it only
    what their statistics leave open.  With ``before``, rows are those that were current
    before that ingest number, which must not be in the base yet.
    """
    now = state(spark, root, table)
    if before is not None and before <= now.upto:
        raise ValueError(f"ingest {before} of {table} is compacted already")
    recent, base = _stored(spark, root, table, now, None if before is None else before - 1)
    if run_id is not None:
        recent = recent.where(F.col("run_id") == run_id)
        if base is not None:
            base = base.where((F.col("bucket") == bucket(F.lit(run_id), now.buckets)) & (F.col("run_id") == run_id))
    return _current(recent, base, LAYOUTS[table][1]).select(*(c for c, _ in now.columns))


def compact(spark: SparkSession, root: str, table: str, keep: int = 1) -> State:
    """Merge all ingests but those of the last ``keep`` numbers into a new base; returns the table's state.

    Numbers are kept back for writers still at work: one that takes longer than ``keep``
    newer ingests would be passed over.  The new base is complete before the state names
    it; old bases and merged ingests stay for readers that began before.  Large buckets,
    such as one with a very long run, are written by several tasks.
    """
    now = state(spark, root, table)
    upto = max(_numbers(found_paths(spark, f"{root}/{table}/ingest_seq=*")), default=-1) - keep
    if upto <= now.upto:
        return now
    key = LAYOUTS[table][1]
    if "run_id" not in dict(now.columns):
        raise ValueError(f"{table} has no runs to lay it out by")
    rows = _current(*_stored(spark, root, table, now, upto), key)
    placed = rows.withColumn("bucket", bucket(F.col("run_id"), now.buckets)).hint("rebalance", "bucket")
    path = f"base/{table}/{uuid.uuid4().hex}"
    order = ("bucket", "run_id", *(k for k in key or () if k != "run_id"))
    placed.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{root}/{path}")
    new = replace(now, version=now.version + 1, base=path, upto=upto)
    put_state(spark, root, table, new)
    return new


def write_runs(
    runs: DataFrame, steps: DataFrame, root: str, ingest_seq: int, documents: DataFrame | None = None
) -> None:
    """Runs, steps and long-form metrics of one ingest.

    ``documents`` may bring run_id and first_pos with trace_json, trace_path and
    expected_output.  The document from the first step on is stored with its run; the
    others, which only very long runs have, get a table of their own.  A part that a
    rewritten run no longer has survives, as its steps do.
    """
    if documents is not None:
        brought = [c for c in ("trace_json", "trace_path", "expected_output") if c in documents.columns]
        write_batch(documents.where("first_pos > 0"), root, "documents", ingest_seq)
        runs = runs.drop(*brought).join(documents.where("first_pos = 0").select("run_id", *brought), "run_id", "left")
    write_batch(runs, root, "runs", ingest_seq)
    stored = write_batch(steps, root, "steps", ingest_seq)
    write_batch(long_metrics(stored), root, "metrics", ingest_seq)


def run_of(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The stored run with an id, or no row."""
    return read_table(spark, root, "runs", run_id)


def steps_of_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The stored steps of a run in order, nulls shown as zero or unknown."""
    return get_steps(read_table(spark, root, "steps", run_id), run_id)


def metrics_of(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The stored metrics of a run, by step and name."""
    return metrics_for_run(read_table(spark, root, "metrics", run_id), run_id)


def documents_of(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Trace documents of stored runs, parsed again; runs stored without a readable one give no row."""
    parts = (read_table(spark, root, t, run_id).select("run_id", "trace_json") for t in ("runs", "documents"))
    rows = reduce(DataFrame.unionByName, parts)
    return parse_traces(rows.where("trace_json IS NOT NULL"))


def analysis_rows(evidence: DataFrame) -> DataFrame:
    """Findings in the layout of the analysis table, all detail as JSON."""
    details = F.to_json(
        F.struct("rule_id", "rule_version", "severity", "description", "evidence_detail", "agent")
    )
    return evidence.select(
        "run_id",
        "step",
        F.col("source").alias("analyzer"),
        "category",
        F.col("value").alias("verdict"),
        "confidence",
        details.alias("details_json"),
        F.lit(schema.SCHEMA_VERSION).alias("schema_version"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def count_like(runs: DataFrame, pattern: str) -> DataFrame:
    """Runs whose id matches a LIKE pattern (``_`` stands for any character)."""
    return runs.where(F.col("run_id").like(pattern)).agg(F.count("*").alias("n_rows"))


def copy_current(spark: SparkSession, root: str, new_root: str) -> None:
    """Write the current rows of every stored table to a new place as one ingest."""
    for table in LAYOUTS:
        if found_paths(spark, f"{root}/{table}"):
            write_batch(read_table(spark, root, table), new_root, table, 0)
