"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all tasks run on one machine.
LOCAL_DIR = os.path.join(tempfile.gettempdir(), "checkpoints")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Only a local
    session may go without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or LOCAL_DIR).rstrip("/")


#: Has Spark delete a query's shuffle files when it ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its
    lineage: lost executors cost no recomputation of what came before. The
    shuffle files it was made from are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(written: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and nothing reads any more."""
    path = written.sparkSession._jvm.org.apache.hadoop.fs.Path(written.written_to)
    path.getFileSystem(written.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict[tuple, object] = {}


def held(make, *key):
    """``make(*key)``, kept by a worker from task to task until another operator
    keeps something else: a worker holds one operator's caches at a time."""
    own = (make.__module__, make.__qualname__, *key)
    if own not in _HELD:
        _HELD.clear()
        _HELD[own] = make(*key)
    return _HELD[own]


#: Rows and bytes of a batch on its way to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at once, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.isModifiable("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Splits up to which a table with fewer of them than half the cores is dealt anew.
FEW_SPLITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows``; a table of a few splits is dealt by a key, so that all cores
    have a part of it. Larger ones stay as they are read."""
    n, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if n <= FEW_SPLITS and 2 * n <= cores else rows


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column`` (at least
    one row), so that memory doesn't follow the number of rows in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for k, size in enumerate(sizes):
            if total and total + size > most_bytes:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += size
        yield batch.slice(start)
