"""Attempts per hour or day, without gaps, in any time offset."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.times import clock, day_label, hour_label
from trapline.operators.arguments import check_choice, check_range
from trapline.schemas import DATE_COLUMN

# The offered time frames (label, days, granularity).
TIMEFRAMES = [("6h", 0.25, "hour"), ("24h", 1.0, "hour"), ("7d", 7.0, "day"), ("30d", 30.0, "day")]

_STEPS = {"hour": timedelta(hours=1), "day": timedelta(days=1)}
_LABELS = {"hour": hour_label, "day": day_label}


def timeline(
    attempts: DataFrame, as_of: datetime | str, granularity: str = "hour", days: float = 7, tz_offset: int = 0
) -> DataFrame:
    """Attempts of the last ``days`` per local hour or day, zero where there are none.

    ``tz_offset`` is in minutes.  The first bucket holds only what lies after
    the start.  The bounds are literals on the timestamp, and on the folder date
    where the table shows it, so other days are not opened; the calendar has at
    most 2,161 rows.
    """
    check_choice("granularity", granularity, _STEPS)
    check_range("days", days, 0.1, 90)
    check_range("tz_offset", tz_offset, -720, 840)
    now = datetime.fromisoformat(str(as_of))
    since = now - timedelta(days=days)
    offset, step = timedelta(minutes=tz_offset), _STEPS[granularity]
    first = (since + offset).replace(minute=0, second=0, microsecond=0)
    if granularity == "day":
        first = first.replace(hour=0)
    buckets = (now + offset - first) // step + 1
    end = first + buckets * step - offset  # of the last bucket, in UTC

    label = _LABELS[granularity]
    local = F.col("timestamp") + F.expr(f"INTERVAL '{tz_offset}' MINUTE")
    ts = F.col("timestamp")
    within = (ts >= clock(since)) & (ts < clock(end))
    if DATE_COLUMN in attempts.columns:
        within &= F.col(DATE_COLUMN).between(F.lit(since.date()), F.lit(end.date()))
    counts = (
        attempts.filter(within)
        .groupBy(label(local).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    starts = F.sequence(clock(first), clock(first + (buckets - 1) * step), F.expr(f"INTERVAL '1' {granularity}"))
    calendar = attempts.sparkSession.range(1).select(F.explode(starts).alias("start")).select(
        label(F.col("start")).alias("bucket")
    )
    return (
        calendar.join(F.broadcast(counts), "bucket", "left")  # at most one row per bucket
        .select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
        .orderBy("bucket")
    )
