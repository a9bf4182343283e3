"""Readers and small column helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter stays as it is."""
    return F.translate(text, UPPER, LOWER)


def parts_for(amount: float, per_part: float, least: int = 1) -> int:
    """Number of partitions that keeps ``per_part`` of ``amount`` in each."""
    return max(least, math.ceil(amount / per_part))


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, a written table of short rows, marked for broadcast if it has at most ``most`` of them."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside send at most ``rows`` rows at once to a Python worker, which bounds its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def memory_returned() -> None:
    """Free memory of this Python worker, which serves stage after stage, goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # only in GNU's C library
        ctypes.CDLL(None).malloc_trim(0)
