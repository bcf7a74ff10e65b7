"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in spark.checkpoint.dir; where that is unset and all runs
    on one machine, as in tests, a new temporary folder serves. Elsewhere that
    is an error, as executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pagetide-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage with files that survive a lost executor, and fixes row
    numbers and ids that a recomputation could change. The shuffle files
    behind it are of no more use and go at once. `batch_rows` and `batch_bytes`
    bound the rows that go to a Python worker at a time, for rows that are long.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {}) | ({_BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames; nothing may read them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _release() -> None:
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives unused memory back to the system when its partition ends.

    Workers live on and serve other stages; what one stage has freed would
    otherwise still count for the executor while the next one runs.
    """

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        _release()

    return run


def tidy_group(function: Callable) -> Callable:
    """The same for a function of one group, after each of them."""

    def run(rows):
        out = function(rows)
        _release()
        return out

    return run


def tidy_group_parts(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same for a function of one group that comes in several frames, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # Spark goes by these types
        yield from function(batches)
        _release()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
