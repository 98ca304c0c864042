"""Sessions: one row per connection, with counters that start at its first connect.

Order matters: an event counts for its session only if the connect arrived
earlier.  What arrives together, all lines of a batch, has the order of the log.  A session is not gathered in one task for that.  Its events are cut
into slices of log order; each slice is reduced to one small row that holds the
counts of the whole slice and the counts after the slice's own first connect.
The slice that holds the session's first connect contributes the latter, all
later slices the former.  So a session with a third of all events is spread over
as many tasks as it has slices, and the second step sees one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.functions.times import seconds_between
from trapline.operators.geo import enrich_geo

# A minute of log time, where ``seq`` is in microseconds.
SLICE_WIDTH = 60_000_000

_COUNTERS = {"login": "login_attempts", "command": "commands_run", "transfer": "files_downloaded"}


def session_parts(events: DataFrame, slice_width: int = SLICE_WIDTH, batch: int = 0) -> DataFrame:
    """One row per session and slice of ``seq``.

    ``batch`` numbers the arrivals of a stream: parts of a later batch come after all of the earlier ones.
    """
    kind = F.col("kind")
    narrow = events.select(
        "session_id",
        F.floor(F.col("seq") / slice_width).alias("slice"),
        "seq",
        "id",
        "kind",
        F.when(kind == "connect", F.struct("seq", "id", "timestamp", "src_ip", "protocol")).alias("opened"),
        F.when(kind == "closed", F.struct("seq", "id", "timestamp")).alias("closed"),
    )
    before = (
        W.partitionBy("session_id", "slice").orderBy("seq", "id").rowsBetween(W.unboundedPreceding, -1)
    )
    known = F.coalesce(F.max(F.col("opened").isNotNull()).over(before), F.lit(False))
    marked = narrow.withColumn("known", known)
    counts = []
    for name, counter in _COUNTERS.items():
        counts.append(F.count_if(kind == name).alias(f"all_{counter}"))
        counts.append(F.count_if((kind == name) & F.col("known")).alias(f"known_{counter}"))
    return (
        marked.groupBy("session_id", "slice")
        .agg(
            F.min("seq").alias("first_seq"),
            F.min("opened").alias("opened"),
            F.max("closed").alias("all_closed"),
            F.max(F.when(F.col("known"), F.col("closed"))).alias("known_closed"),
            *counts,
        )
        .withColumn("batch", F.lit(batch).cast("bigint"))
        .drop("slice")
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """All parts of each session as one part.

    Parts are in the order of their batch, and within a batch in that of the log.  Merging is associative, so parts that
    follow one another in this order, such as those of all batches up to one, may be replaced by their merger,
    however late the events of later batches are.
    """
    placed = parts.withColumn("place", F.struct("batch", "first_seq")).withColumn(
        "start", F.min(F.when(F.col("opened").isNotNull(), F.col("place"))).over(W.partitionBy("session_id"))
    )

    def known(name: str) -> Column:
        return F.when(F.col("place") > F.col("start"), F.col(f"all_{name}")).when(
            F.col("place") == F.col("start"), F.col(f"known_{name}")
        )

    def latest(value: Column) -> Column:
        return F.max(F.when(value.isNotNull(), F.struct("place", value.alias("at"))))

    counts = []
    for name in _COUNTERS.values():
        counts.append(F.sum(f"all_{name}").alias(f"all_{name}"))
        counts.append(F.coalesce(F.sum(known(name)), F.lit(0)).alias(f"known_{name}"))
    return (
        placed.groupBy("session_id")
        .agg(
            F.min("place").alias("place"),
            F.min(F.when(F.col("place") == F.col("start"), F.col("opened"))).alias("opened"),
            latest(F.col("all_closed")).alias("all_last"),
            latest(known("closed")).alias("known_last"),
            *counts,
        )
        .withColumns({"all_closed": F.col("all_last.at"), "known_closed": F.col("known_last.at")})
        .withColumns({"first_seq": F.col("place.first_seq"), "batch": F.col("place.batch")})
        .select(*parts.columns)
    )


def combine_parts(parts: DataFrame) -> DataFrame:
    """Parts to sessions; sessions without a connect are left out."""
    start, end = F.col("opened.timestamp"), F.col("known_closed.timestamp")
    return (
        merge_parts(parts)
        .filter(F.col("opened").isNotNull())
        .select(
            "session_id",
            "opened.src_ip",
            start.alias("start_time"),
            end.alias("end_time"),
            "opened.protocol",
            *[F.col(f"known_{name}").alias(name) for name in _COUNTERS.values()],
            seconds_between(start, end).alias("duration_secs"),
        )
    )


def locate_sessions(sessions: DataFrame, geo_ranges: DataFrame) -> DataFrame:
    """Add the place of each session's address; one lookup per session, not per event."""
    return enrich_geo(sessions, geo_ranges).drop("city", "asn", "as_org")


def build_sessions(events: DataFrame, geo_ranges: DataFrame | None = None, slice_width: int = SLICE_WIDTH) -> DataFrame:
    """Sessions of normalised events.  A repeated connect is ignored, the last close wins."""
    sessions = combine_parts(session_parts(events, slice_width))
    return sessions if geo_ranges is None else locate_sessions(sessions, geo_ranges)
