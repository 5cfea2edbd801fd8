"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_scopes: list[str] = []


def build_session(app: str = "tracewell", cores: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    Clusters name it in ``spark.checkpoint.dir``.  Only a local session without
    that setting gets a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="tracewell-")
        context.setCheckpointDir(folder)
        _local_dirs[context.applicationId] = folder
    return _local_dirs[context.applicationId]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, or of the innermost scope's folder in it."""
    return f"{_scopes[-1] if _scopes else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession, name: str = "scope") -> Iterator[str]:
    """Removes, on leaving, every work folder that was made inside.

    Frames made inside read these folders when they are evaluated, so what is to stay must
    be written elsewhere before.  Scopes nest; they belong to the thread that drives Spark.
    """
    path = work_dir(spark, name)
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several parts of a query read, and read it back.

    The file lies in the shared folder, so a lost executor costs no recomputation
    of what led to it.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
