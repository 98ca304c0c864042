"""Work list of addresses whose reputation is still to be fetched.

The list is a stored state: every address seen so far that has no score, when it was last
asked for and how often.  Each batch writes the state anew from that of the batch before, its own
addresses and the scores of the moment, so an address that got no answer is on the list
again after a while though it does not attack again.  A repeated batch writes the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions.times import clock
from trapline.operators.addresses import unscored_ips

SCAN_SECONDS = 60
STATE = "src_ip string, asked_at timestamp_ntz, tries int, due boolean"


def pending(
    before: DataFrame, attempts: DataFrame, scores: DataFrame, as_of: datetime | str | Column, seconds: int = SCAN_SECONDS
) -> DataFrame:
    """The state after a scan: src_ip, asked_at, tries, and whether the address is ``due``, to be asked now.

    Addresses of ``before`` (src_ip, asked_at, tries) and ``attempts`` without a score; due are those never asked,
    or asked ``seconds`` ago or earlier.
    """
    now = clock(as_of)
    new = attempts.select("src_ip", F.lit(None).cast("timestamp_ntz").alias("asked_at"), F.lit(0).alias("tries")).distinct()
    known = before.select("src_ip", "asked_at", "tries").unionByName(new)
    known = known.groupBy("src_ip").agg(F.max("asked_at").alias("asked_at"), F.max("tries").alias("tries"))
    scored = scores.select(F.col("ip").alias("src_ip")).distinct()
    due = F.coalesce(F.col("asked_at") <= now - F.expr(f"INTERVAL '{int(seconds)}' SECOND"), F.lit(True))
    return (
        known.join(scored, "src_ip", "left_anti")
        .withColumn("due", due)
        .withColumns({"asked_at": F.when(due, now).otherwise(F.col("asked_at")), "tries": F.col("tries") + due.cast("int")})
    )


def scan_pending(
    attempts: DataFrame,
    scores: Callable[[], DataFrame],
    folder: str,
    checkpoint: str,
    as_of: Callable[[int], datetime | str | Column] | None = None,
    seconds: int = SCAN_SECONDS,
):
    """Writer of the state after each batch, in a folder of its own.

    ``scores`` reads the score table anew for each batch, so answers that came
    in meanwhile are respected.  Fetching the scores is the caller's part;
    ``merge_scores`` takes the answers in.  ``as_of`` gives the time of a batch by its number.
    """
    folder = folder.rstrip("/")

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = attempts.sparkSession
        before = state_after(spark, folder, batch_id - 1) if batch_id else spark.createDataFrame([], STATE)
        now = F.localtimestamp() if as_of is None else as_of(batch_id)
        pending(before, batch, scores(), now, seconds).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return attempts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def state_after(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """All addresses without a score after a batch: src_ip, asked_at, tries, due."""
    return spark.read.schema(STATE).parquet(f"{folder.rstrip('/')}/batch={batch_id}")


def work_list(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The addresses to ask for after a batch: src_ip, tries."""
    return state_after(spark, folder, batch_id).filter("due").select("src_ip", "tries")


def scan_unscored(attempts: DataFrame, scores: Callable[[], DataFrame], folder: str, checkpoint: str):
    """Writer that stores the unscored addresses of each batch alone, for callers that keep a list of their own."""

    def store(batch: DataFrame, batch_id: int) -> None:
        unscored_ips(batch, scores()).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")

    return attempts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
