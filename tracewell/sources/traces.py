"""Trace documents and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import schema
from tracewell.config import DOCUMENT_CHUNK

CORRUPT = "_corrupt_record"


def scan_traces(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Trace documents under ``path``.

    ``one_per_file`` reads pretty-printed files holding a single object.  Large
    collections should be JSON lines (``False``), which split inside files.
    """
    return _scan(spark, path, one_per_file).where("run_id IS NOT NULL").drop(CORRUPT)


def unreadable_traces(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """(path, text) of the documents under ``path`` that are no JSON or name no run."""
    broken = _scan(spark, path, one_per_file).where("run_id IS NULL")
    return broken.select(F.input_file_name().alias("path"), F.col(CORRUPT).alias("text"))


def _scan(spark: SparkSession, path: str, one_per_file: bool) -> DataFrame:
    return spark.read.schema(f"{schema.TRACE}, {CORRUPT} STRING").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", one_per_file).json(path)


def scan_labels(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Labelled runs of the label files under ``path``; with ``one_per_file`` false, one object per line."""
    return (
        spark.read.schema(schema.LABELS)
        .option("multiLine", one_per_file)
        .json(path)
        .select(F.inline("runs"))
    )


def parse_traces(rows: DataFrame, column: str = "trace_json") -> DataFrame:
    """Documents from a column of JSON text; ``unparsed`` has the rows without a readable one."""
    return rows.select(F.from_json(column, schema.TRACE).alias("t")).where("t.run_id IS NOT NULL").select("t.*")


def unparsed(rows: DataFrame, column: str = "trace_json") -> DataFrame:
    """Rows whose text is no trace document or names no run."""
    return rows.where(F.from_json(column, schema.TRACE)["run_id"].isNull())


def trace_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Path and size of the files under ``path``; contents are not read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("file_size"))


def largest_file(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("file_size"), "path").limit(1)


def nest_documents(runs: DataFrame, steps: DataFrame, step_columns: list[str], chunk: int = DOCUMENT_CHUNK) -> DataFrame:
    """Nest ``steps`` (with ``pos``) under their runs, ``chunk`` steps to a document.

    Runs of ordinary length become one document each.  Longer runs become several,
    told apart by ``first_pos``; readers put the positions back together.  Grouping
    and join both run on (run, first_pos), so one very long run is many small groups.
    """
    nested = (
        steps.withColumn("first_pos", F.floor(F.col("pos") / chunk) * chunk)
        .groupBy("run_id", "first_pos")
        .agg(F.array_sort(F.collect_list(F.struct("pos", *step_columns))).alias("s"))
        .select("run_id", "first_pos", F.transform("s", lambda x: x.dropFields("pos")).alias("steps"))
    )
    if "step_count" not in runs.columns:
        counted = steps.groupBy("run_id").agg((F.max("pos") + 1).alias("step_count"))
        runs = runs.join(counted, "run_id", "left")
    # runs without steps keep one document without a list
    last = F.greatest(F.coalesce(F.col("step_count"), F.lit(0)) - 1, F.lit(0)).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), last, F.lit(chunk).cast("bigint"))
    documents = runs.withColumn("first_pos", F.explode(starts)).drop("step_count")
    return documents.join(nested, ["run_id", "first_pos"], "left")


def write_traces(docs: DataFrame, path: str) -> None:
    """JSON lines, one document per line."""
    docs.write.mode("overwrite").json(path)
