"""Session defaults for local runs, and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ONE_MACHINE = re.compile(r"local(\[[^\]]*\])?")
_local_roots: dict[str, str] = {}
#: Paths and tables that were written since the innermost :func:`passing_tables` began, if one is open.
_passing: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("passing", default=None)


def local_session(cpus: str = "*", app: str = "corpusloom", memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.openCostInBytes", "131072")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a session on one machine may fall back to a fresh temporary folder, one for each application: elsewhere that folder
    would exist on one machine only.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if root is None:
        if not _ONE_MACHINE.fullmatch(spark.sparkContext.master):
            raise ValueError(f"{_CHECKPOINT_KEY} must name a folder shared by all executors")
        application = spark.sparkContext.applicationId
        if application not in _local_roots:
            _local_roots[application] = tempfile.mkdtemp(prefix="corpusloom-")
        root = _local_roots[application]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder; two calls never give the same one."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet table and read it back: cuts lineage and survives the loss of an executor.

    The shuffle files of the write are dropped when it ends; they would stay on disk until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP_KEY)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP_KEY, before)
    table = spark.read.schema(df.schema).parquet(path)
    if _passing.get() is not None:
        _passing.get().append((path, table))
    return table


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the given function is called with.

    Nothing that is computed later may read the deleted ones. An error leaves all of them.
    """
    made: list[tuple[str, DataFrame]] = []
    kept: list[DataFrame] = []
    token = _passing.set(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _passing.reset(token)
    outer = _passing.get()
    for path, table in made:
        if not any(table is k for k in kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        elif outer is not None:
            outer.append((path, table))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, wherever Spark can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, wherever Spark can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
