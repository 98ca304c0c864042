"""Upkeep of stored tables: private sources that got in before they were filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.addresses import is_private


def all_ips(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct addresses of both tables."""
    return attempts.select("src_ip").union(sessions.select("src_ip")).distinct()


def private_ips(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Private addresses of both tables with their attempts; 0 for those seen in sessions only.

    One grouping of the union instead of a join.
    """
    private = is_private(F.col("src_ip"))
    seen = (
        attempts.filter(private)
        .select("src_ip", F.lit(1).alias("n"))
        .union(sessions.filter(private).select("src_ip", F.lit(0).alias("n")))
    )
    return seen.groupBy("src_ip").agg(F.sum("n").alias("attempts"))


def _private_files(attempts: DataFrame) -> DataFrame:
    """Keys of private attempts; the session is part of the key because raw-log ids are hashes."""
    return attempts.filter(is_private(F.col("src_ip"))).select(F.col("id").alias("attempt_id"), "session_id")


def purge_private(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """attempts, sessions and captured_files without private sources.

    Being private depends on the address alone, so attempts and sessions are
    plain filters.  Write the result to a new folder, then switch to it.
    """
    attempts, sessions, files = (tables[name] for name in ("attempts", "sessions", "captured_files"))
    public = ~is_private(F.col("src_ip"))
    return {
        "attempts": attempts.filter(public),
        "sessions": sessions.filter(public),
        "captured_files": files.join(_private_files(attempts), ["attempt_id", "session_id"], "left_anti").select(
            *files.columns
        ),
    }


def purge_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows of each table a purge deletes.  Nothing is written."""
    attempts, sessions, files = (tables[name] for name in ("attempts", "sessions", "captured_files"))
    private = is_private(F.col("src_ip"))
    deleted = {
        "attempts": attempts.filter(private),
        "sessions": sessions.filter(private),
        "files": files.join(_private_files(attempts), ["attempt_id", "session_id"], "left_semi"),
    }
    counts = None
    for name, rows in deleted.items():
        count = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        counts = count if counts is None else counts.union(count)
    return counts.agg(
        *[
            F.sum(F.when(F.col("name") == name, F.col("n")).otherwise(0)).alias(f"{name}_deleted")
            for name in deleted
        ]
    )
