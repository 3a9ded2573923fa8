"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where none is set and all runs in one process (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named or have


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; the folder goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def settle(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written as a table in the shared folder.

    A table read again brings no constraints of the plan that made it; those of checkpoints grow with every
    round of an iteration until planning takes longer than the work.
    """
    path = fresh_dir(df.sparkSession, "step")
    _written().append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds the bytes of Arrow batches between the JVM and Python, unless the application has set a bound of its own.

    The bound on rows alone lets a batch of wide rows grow to hundreds of megabytes, in both processes.
    """
    if spark.sparkContext.getConf().get(ARROW_BYTES) is None:
        spark.conf.set(ARROW_BYTES, size)


def give_back() -> None:
    """Returns memory that this process has freed to the system: allocators keep it for arrays to come."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, a function of the batches of a task, after which the worker gives its free memory back.

    Spark's workers stay for the tasks of other steps, beside an executor's heap that is full by then.
    """

    def task(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return task


_local = threading.local()


def _written() -> list[str]:
    """Folders of the tables that this thread has written and not dropped."""
    if not hasattr(_local, "paths"):
        _local.paths = []
    return _local.paths


def place() -> int:
    """A mark for ``drop_since``."""
    return len(_written())


def drop_since(spark: SparkSession, mark: int) -> None:
    """Deletes the tables that ``settle`` has written since the mark; what is read later must not come from them."""
    hadoop, paths = spark.sparkContext._jsc.hadoopConfiguration(), _written()
    while len(paths) > mark:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        place.getFileSystem(hadoop).delete(place, True)
