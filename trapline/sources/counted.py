"""Stored attempts whose rows are counted by date folder as they arrive, so that a page opens the folders it needs.

Beside the attempts lie their counts, one folder per arrival: rows by date, country, intent and
event.  They are made from the arrival's files after these are complete.  An arrival without counts (its
writer died in between, or it is the shared one of plain appends) is counted when it is needed, so counts
are exact whatever has failed.
"""

from __future__ import annotations

import re
import uuid
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.operators.arguments import check_limit
from trapline.operators.listing import TRANSFERS_SHOWN, files_accessed, filter_attempts, newest_first, page_info
from trapline.schemas import ARRIVAL_COLUMN, DATE_COLUMN
from trapline.sources import tables

COUNTED = [DATE_COLUMN, "country_code", "intent", "event_id"]
SCHEMA = f"{DATE_COLUMN} DATE, country_code STRING, intent STRING, event_id STRING, n BIGINT"


def _folder(folder: str) -> str:
    return f"{folder.rstrip('/')}/attempts_counts"


def _arrivals(spark: SparkSession, folder: str) -> set[str]:
    """The arrivals in a folder that were written to their end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return set()
    found = set()
    for status in system.listStatus(path):
        named = re.fullmatch(f"{ARRIVAL_COLUMN}=(.+)", status.getPath().getName())
        if named and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.add(named[1])
    return found


def _count(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*COUNTED).agg(F.count(F.lit(1)).alias("n"))


def store_counts(spark: SparkSession, folder: str, arrival: str) -> None:
    """Count one arrival from its files; counting it again gives the same."""
    rows = tables.load_table(spark, folder, "attempts", arrivals=[arrival])
    _count(rows).write.mode("overwrite").parquet(f"{_folder(folder)}/{ARRIVAL_COLUMN}={arrival}")


def append_counted(attempts: DataFrame, folder: str, gather: bool = False) -> None:
    """Append attempts as an arrival of their own, with counts."""
    arrival = f"{tables.BATCH_ARRIVAL}-{uuid.uuid4().hex}"
    tables.write_arrival(attempts, folder, "attempts", arrival, "overwrite", gather)
    store_counts(attempts.sparkSession, folder, arrival)


def stream_counted(attempts: DataFrame, folder: str, checkpoint: str):
    """A started-ready writer of a stream of attempts, with counts; a repeated batch replaces both."""

    def count(batch: DataFrame, arrival: str) -> None:
        store_counts(batch.sparkSession, folder, arrival)

    return tables.stream_table(attempts, folder, "attempts", checkpoint, count)


def folder_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(event_date, country_code, intent, event_id, n) of all stored attempts; sums over several arrivals are left to the reader."""
    there = _arrivals(spark, f"{folder.rstrip('/')}/attempts")
    known = sorted((_arrivals(spark, _folder(folder)) & there) - {tables.BATCH_ARRIVAL})
    paths = [f"{_folder(folder)}/{ARRIVAL_COLUMN}={arrival}" for arrival in known]
    counts = spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
    counts = counts.select(*COUNTED, "n")
    missing = sorted(there - set(known))
    if not missing:
        return counts
    return counts.unionByName(_count(tables.load_table(spark, folder, "attempts", arrivals=missing)))


class Span(NamedTuple):
    """The date folders from ``oldest`` to ``newest`` (and rows without date) hold a page; ``newer`` matching rows come before them."""

    oldest: date | None
    newest: date | None
    undated: bool
    newer: int

    def condition(self) -> Column:
        dated = F.col(DATE_COLUMN).between(F.lit(self.oldest), F.lit(self.newest)) if self.oldest else F.lit(False)
        return dated | F.col(DATE_COLUMN).isNull() if self.undated else dated


def span_of(counts: DataFrame, first: int, limit: int, **filters) -> Span | None:
    """The folders that hold matching rows ``first`` to ``first + limit``, newest first; None if there are none.

    The running sum is over one row per date, and one row comes to the driver.
    """
    by_date = filter_attempts(counts, **filters).groupBy(DATE_COLUMN).agg(F.sum("n").alias("n"))
    before = Window.orderBy(F.col(DATE_COLUMN).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = by_date.withColumn("newer", F.coalesce(F.sum("n").over(before), F.lit(0)))
    needed = placed.filter((F.col("newer") < first + limit) & (F.col("newer") + F.col("n") > first))
    undated = F.coalesce(F.bool_or(F.col(DATE_COLUMN).isNull()), F.lit(False))
    span = needed.agg(F.min(DATE_COLUMN), F.max(DATE_COLUMN), undated, F.min("newer")).first()
    return None if span[3] is None else Span(*span)


def _newest_of(spark: SparkSession, folder: str, first: int, limit: int, **filters) -> tuple[DataFrame, int]:
    """Stored attempts of the folders that the rows from ``first`` on are in, and how many rows to skip there."""
    attempts = tables.load_table(spark, folder, "attempts")
    span = span_of(folder_counts(spark, folder), first, limit, **filters)
    condition, skipped = (F.lit(False), first) if span is None else (span.condition(), span.newer)
    return attempts.filter(condition).drop(DATE_COLUMN), first - skipped


def stored_page(spark: SparkSession, folder: str, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    """One page of matching attempts, newest first, from the date folders it is in.

    Filters are by country, intent and event, which are counted.  At any depth no more is sorted than the
    folders of the page, and of these only its first rows; rows that arrive later shift pages, as everywhere.
    """
    check_limit(limit, 200)
    if page < 1:
        raise ValueError("page must be at least 1")
    attempts, skip = _newest_of(spark, folder, (page - 1) * limit, limit, **filters)
    return newest_first(filter_attempts(attempts, **filters)).offset(skip).limit(limit)


def stored_page_info(spark: SparkSession, folder: str, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    """Like ``page_info``, from the counts alone."""
    return page_info(folder_counts(spark, folder), page, limit, weight="n", **filters)


def stored_transfers(spark: SparkSession, folder: str, limit: int = TRANSFERS_SHOWN) -> DataFrame:
    """Like ``files_accessed``, from the newest folders that hold so many transfers."""
    check_limit(limit, 200)
    return files_accessed(_newest_of(spark, folder, 0, limit, intent=["malware_deployment"])[0], limit)
