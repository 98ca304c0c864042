"""Stored tables: typed scans and appends, from batch jobs and streams alike.

A table's folder holds one folder per arrival, and in it date folders where the
table has them.  Batch appends share one arrival; each batch of a stream has its
own, which a repeated batch overwrites as a whole.  So rows are there exactly
once, and one plain scan shows what batch jobs and streams have written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.schemas import ARRIVAL_COLUMN, DATE_COLUMN, PARTITIONED_BY_DATE_OF, TABLES

# The arrival that all batch appends share.
BATCH_ARRIVAL = "batch"


def _path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def load_table(spark: SparkSession, folder: str, name: str, arrivals: list[str] | None = None) -> DataFrame:
    """One stored table with its declared schema, whoever wrote it, or some arrivals of it.

    Tables in date folders show the folder date as ``event_date``; a filter on
    it skips whole folders.
    """
    schema = f"{TABLES[name]}, {ARRIVAL_COLUMN} STRING"
    if name in PARTITIONED_BY_DATE_OF:
        schema = f"{schema}, {DATE_COLUMN} DATE"
    path = _path(folder, name)
    paths = [path] if arrivals is None else [f"{path}/{ARRIVAL_COLUMN}={arrival}" for arrival in arrivals]
    return spark.read.schema(schema).option("basePath", path).parquet(*paths).drop(ARRIVAL_COLUMN)


def append_table(frame: DataFrame, folder: str, name: str, gather: bool = False) -> None:
    """Append rows to a stored table, in date folders where the table has them.

    Each task writes its own file per date.  A log file covers few dates, so no
    shuffle is spent on that as a rule.  ``gather`` shuffles the rows by date
    first, for input whose tasks each see many dates; large dates are split and
    small ones joined, to files of the advisory partition size.
    """
    write_arrival(frame, folder, name, BATCH_ARRIVAL, "append", gather)


def write_arrival(frame: DataFrame, folder: str, name: str, arrival: str, mode: str, gather: bool = False) -> None:
    """Write rows as one arrival, adding to it (``append``) or replacing it (``overwrite``)."""
    column = PARTITIONED_BY_DATE_OF.get(name)
    if column is not None:
        frame = frame.withColumn(DATE_COLUMN, F.col(column).cast("date"))
        if gather:
            frame = frame.hint("rebalance", DATE_COLUMN)
    # The whole arrival is replaced, whatever the session says about overwriting single date folders.
    writer = frame.write.mode(mode).option("partitionOverwriteMode", "static")
    if column is not None:
        writer = writer.partitionBy(DATE_COLUMN)
    writer.parquet(f"{_path(folder, name)}/{ARRIVAL_COLUMN}={arrival}")


def write_attempts(attempts: DataFrame, folder: str) -> None:
    append_table(attempts, folder, "attempts")


def write_captured(files: DataFrame, folder: str) -> None:
    append_table(files, folder, "captured_files")


def stream_table(
    frame: DataFrame, folder: str, name: str, checkpoint: str, after: Callable[[DataFrame, str], None] | None = None
):
    """A started-ready writer that appends a stream to a stored table exactly once.

    Arrivals are named after the checkpoint and the batch, so several streams can
    fill one table, together with batch appends.  A new checkpoint is a new stream.
    ``after`` is called with each batch and its arrival once that is stored.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def store(batch: DataFrame, batch_id: int) -> None:
        arrival = f"{stream}-{batch_id}"
        write_arrival(batch, folder, name, arrival, "overwrite")
        if after is not None:
            after(batch, arrival)

    return frame.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
