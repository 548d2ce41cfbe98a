"""What operators need to know about the session they run in."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textnum

BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches be bounded by bytes too, so that long texts do not add up to large ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key, None)
    if have is None or not have.isdigit() or int(have) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Give freed memory back to the system; Python workers live on after a task."""
    textnum.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library, which has its own ways


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map function over batches that releases memory when its task has ended."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


_RELEASE_SECONDS = 0.5
_released_at: dict[str, float] = {}


def _release_now_and_then() -> None:
    now = time.monotonic()
    if now - _released_at.get("at", 0.0) > _RELEASE_SECONDS:
        release_memory()
        _released_at["at"] = time.monotonic()


def released(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group's rows that releases memory when it has ended, but not more than twice a second."""

    def wrapped(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            _release_now_and_then()

    return wrapped


def released_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            _release_now_and_then()

    return wrapped


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and read them from there on.

    The folder is the session's spark.checkpoint.dir.  Only where that is unset
    and all of Spark is in this process, a temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "logweave-checkpoints"))
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the rows do not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def steady(df: DataFrame) -> DataFrame:
    """Rows that each pass reads in the same splits and order: those of a plain scan as they are, others from a checkpoint."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = any(word in plan for word in ("Exchange", "Python", "Pandas", "Arrow", "Sample", "Limit"))
    return checkpoint(df) if moved else df


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def bucket_count(df: DataFrame) -> int:
    """Buckets for a packed exchange: as many as input splits, at least the session's shuffle partitions, and prime."""
    return next_prime(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions(), 12))
