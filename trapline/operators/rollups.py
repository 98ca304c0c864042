"""Daily summary of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.display import filled
from trapline.functions.times import day_label

_TOPS = {
    "top_country": "country_code",
    "top_username": "username",
    "top_password": "password",
    "top_command": "command",
}


def daily_stats(attempts: DataFrame) -> DataFrame:
    """Per date: totals, distinct counts and the most frequent values; ties go to the smallest.

    Each attempt is turned into one (date, column, value) triple per summarised
    column, and equal triples are counted before the shuffle.  One pass then
    serves every total, distinct count and top value, and no date is gathered in
    one task.
    """

    entries = [F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in summarised().items()]
    counted = (
        attempts.select(day_label(F.col("timestamp")).alias("date"), F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("date", "name", "value")
        .agg(F.count("*").alias("n"))
    )
    return daily_of(counted)


def summarised() -> dict[str, Column]:
    """The summarised columns by name."""
    tops = {top: filled(F.col(column)) if column == "command" else F.col(column) for top, column in _TOPS.items()}
    return {"src_ip": F.col("src_ip")} | tops


def daily_of(counted: DataFrame) -> DataFrame:
    """The summary of (date, name, value, n)."""
    per_column = counted.groupBy("date", "name").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("values"),
        F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("top"),
    )

    def of(name: str, column: str):
        return F.max(F.when(F.col("name") == name, F.col(column)))

    return (
        per_column.groupBy("date")
        .agg(
            of("src_ip", "rows").alias("total_attempts"),
            of("src_ip", "values").alias("unique_ips"),
            F.coalesce(of("top_country", "values"), F.lit(0)).cast("bigint").alias("unique_countries"),
            *[of(name, "top.value").alias(name) for name in _TOPS],
        )
        .orderBy("date")
    )
