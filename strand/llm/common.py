"""What the training-data operators share: whitespace, materialising, skew-safe joins."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strand.plans.cut import materialize, shared_dir  # noqa: F401  (the subpackage's modules take them from here)

#: Words are maximal runs of anything but these characters (same set as ``bytes.split()``).
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]+"

#: Sides up to this many (narrow) rows may be broadcast; beyond it the shuffled path runs.
BROADCAST_ROWS = 200_000


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """At most ``rows`` rows and ``megabytes`` MB in an Arrow batch of this session from now on: texts of a
    batch are held at once by the JVM, Arrow and Python, on every core of an executor."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", megabytes << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match("[0-9]+$", spark.conf.get(key))
        if not now or not 0 < int(now.group()) <= most:
            spark.conf.set(key, str(most))


def hand_back() -> None:
    """Give freed memory of a Python worker back to the system. Workers outlive their tasks, several wait for the next
    one on each executor, and what one of them has once needed would stay with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy[T](batches: Iterable[T]) -> Iterator[T]:
    """``batches`` of one task, after which its worker's memory is handed back."""
    try:
        yield from batches
    finally:
        hand_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(NON_SPACE)), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``limit`` rows, else ``df`` as it is (joined by shuffling)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (unique ``key``), safe for keys that hold much of all rows.

    Groups of over max(1000, total / 1000) rows are at most 1000, so they are broadcast and their rows
    stay where they are; the rows of all other groups meet them in a shuffle of even keys.
    """
    hot_from = max(1000, total // 1000)
    hot = groups.filter(F.col(size) > hot_from)
    cold = groups.filter(F.col(size) <= hot_from)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    )
