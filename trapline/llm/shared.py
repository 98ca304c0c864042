"""What several of these operators need: table access, written intermediate tables, bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.settings import work_folder

# Words are runs of anything but these ASCII spaces, in every operator that counts words.
SPACES = r"[\x20\x09-\x0D]+"

# Bytes of an Arrow batch that goes to a Python helper.
BATCH_BYTES = 1 << 20
_BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"

# Python helpers look at so many characters at a time, whatever the size of a batch.
SLICE_CHARS = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(text: Column, parts: Sequence[str]) -> Column:
    """The text without any of the parts."""
    return reduce(lambda left, part: F.replace(left, F.lit(part)), parts, text)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read again.

    This cuts the lineage: later steps neither repeat the work nor depend on
    the disks of the executors that did it.
    """
    spark = frame.sparkSession
    path = work_folder(spark, name)
    with _small_batches(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES meanwhile, unless the session says otherwise; rows do not depend on it.

    Spark's default lets every task hold 64 MB of texts outside the heap, and twice that while it fills a batch.
    """
    if _BATCH_OPTION in spark.conf.getAll:
        yield
        return
    spark.conf.set(_BATCH_OPTION, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_OPTION)


def give_back() -> None:
    """Return what this process has freed to the system; workers live on from task to task, and wait with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_CHARS) -> Iterator[list[list]]:
    """Columns of a few rows at a time, with about ``most`` characters in column ``text`` or one longer text."""
    for batch in batches:
        column, start = batch.column(text), 0
        # Text lengths in bytes bound those in characters.
        sizes = [(length or 0) + 1 for length in pa.compute.binary_length(column).to_pylist()]
        while start < len(sizes):
            end, total = start, 0
            while end < len(sizes) and (end == start or total + sizes[end] <= most):
                total += sizes[end]
                end += 1
            yield [c.slice(start, end - start).to_pylist() for c in batch.columns]
            start = end
    give_back()
