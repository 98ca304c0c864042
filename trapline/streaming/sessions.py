"""Exact session tracking over a stream.

Each batch stores its session parts, one small row per session and minute of
the batch; the parts of all batches make up the sessions.  Nothing is held in
memory between batches, sessions never expire, and a repeated batch overwrites
its own folder.  From time to time the parts are merged to a state of one part per
session, after which a refresh reads that state and the batches since.

An event counts for its session if the connect arrived before it: in an earlier
batch, or earlier in the log of the same batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.operators.sessions import SLICE_WIDTH, combine_parts, merge_parts, session_parts


def track_sessions(events: DataFrame, folder: str, checkpoint: str, slice_width: int = SLICE_WIDTH):
    """Writer that stores the session parts of each batch of normalised events."""

    def store(batch: DataFrame, batch_id: int) -> None:
        parts = session_parts(batch, slice_width, batch_id).drop("batch")
        parts.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(folder)
    return parts.withColumn("batch", parts["batch"].cast("bigint"))


def stored_parts(
    spark: SparkSession, folder: str, state: str | None = None, through: int | None = None
) -> DataFrame:
    """The parts of all batches, or those up to ``through``; with a ``state`` of ``compact_parts``, that and the batches since.

    The parts of a state carry the number of the last batch in it, which is read from the folder's name.
    """
    parts = _parts(spark, folder)
    if through is not None:
        parts = parts.filter(F.col("batch") <= through)
    if state is None:
        return parts
    merged = _parts(spark, state)
    last = merged.agg(F.max("batch")).first()[0]
    if through is not None and last > through:
        raise ValueError(f"the state holds batches up to {last}")
    return merged.unionByName(parts.filter(F.col("batch") > last))


def tracked_sessions(spark: SparkSession, folder: str, state: str | None = None) -> DataFrame:
    """The sessions seen so far."""
    return combine_parts(stored_parts(spark, folder, state))


def compact_parts(
    spark: SparkSession, folder: str, into: str, state: str | None = None, through: int | None = None
) -> None:
    """Write the parts of all batches, or of those up to ``through``, to the new folder ``into``, one per session.

    ``state`` is the result of an earlier call; only the batches since are read with it.  Batches in
    a state may be deleted from ``folder``.
    """
    parts = stored_parts(spark, folder, state, through)
    last = parts.agg(F.max("batch")).first()[0]
    if last is None:
        raise ValueError("there are no parts to merge")
    merge_parts(parts).drop("batch").write.parquet(f"{into.rstrip('/')}/batch={last}")
