"""Running rankings, overview, timeline and accounting, from stored counts.

Each batch stores what it counts, one row per group, key and label, combined before the
shuffle, in a folder named after the batch; a repeated batch overwrites its own.  Counts are
sums, so those of neighbouring batches are merged, FAN folders into one, and those into
larger ones: a reader opens some FAN folders for each level however many batches
there were.  Nothing is held in memory between batches and no event comes too late.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions.times import day_label, hour_label
from trapline.operators import rankings, rollups
from trapline.sources.loglines import with_event

# So many folders are merged into one of the next level.
FAN = 8
SCHEMA = "keys array<string>, label string, n bigint, name string"


class Group(NamedTuple):
    """Rows that meet the condition are counted by their keys; the smallest label is kept."""

    keys: list[Column]
    condition: Column | None = None
    label: Column | None = None


def _attempt_groups() -> dict[str, Group]:
    return {
        "countries": Group([F.col("country_code"), F.col("country_name")]),
        "intents": Group([F.col("intent")]),
        "commands": Group([F.col("command")], F.col("command") != "", F.col("intent")),
        "credentials": Group([F.col("username"), F.col("password")], F.col("username").isNotNull()),
        "ports": Group([F.col("dst_port")], F.col("dst_port").isNotNull()),
        "address_days": Group([F.col("src_ip"), F.col("country_code"), rankings.attack_day()]),
    }


def _daily_groups() -> dict[str, Group]:
    date = day_label(F.col("timestamp"))
    return {name: Group([date, value], value.isNotNull()) for name, value in rollups.summarised().items()}


def _timeline_groups() -> dict[str, Group]:
    fed = F.col("kind") != "closed"
    return {"hour": Group([hour_label(F.col("timestamp"))], fed), "day": Group([day_label(F.col("timestamp"))], fed)}


def _line_groups() -> dict[str, Group]:
    return {"total": Group([]), "ingested": Group([], F.col("event").isNotNull())}


def tally(rows: DataFrame, groups: dict[str, Group]) -> DataFrame:
    """(name, keys, label, n): all groups counted in one pass with one shuffle."""
    entries = []
    for name, (keys, condition, label) in groups.items():
        listed = F.array(*(key.cast("string") for key in keys)).cast("array<string>")
        shown = F.lit(name) if condition is None else F.when(condition, F.lit(name))
        entries.append(
            F.struct(
                shown.alias("name"),
                listed.alias("keys"),
                (F.lit(None) if label is None else label).cast("string").alias("label"),
            )
        )
    counted = rows.select(F.inline(F.array(*entries))).filter("name IS NOT NULL")
    return counted.groupBy("name", "keys").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))


# The store


def _spans(spark: SparkSession, folder: str) -> set[tuple[int, int]]:
    """First and last batch of every folder that was written to its end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return set()
    done = set()
    for status in system.listStatus(path):
        named = re.fullmatch(r"span=(\d+)-(\d+)", status.getPath().getName())
        if named and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.add((int(named[1]), int(named[2])))
    return done


def cover(spans: set[tuple[int, int]], first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """The fewest spans that hold every batch from ``first`` to ``last`` once: at each batch the longest one that begins there."""
    ends: dict[int, int] = {}
    for start, end in spans:
        if last is None or end <= last:
            ends[start] = max(end, ends.get(start, end))
    chosen, at = [], first
    limit = max((end for _, end in spans), default=-1) if last is None else last
    while at <= limit:
        # A batch without a folder was of a run that began later.
        if at in ends:
            chosen.append((at, ends[at]))
            at = ends[at]
        at += 1
    return chosen


def _read(spark: SparkSession, folder: str, spans: list[tuple[int, int]]) -> DataFrame:
    paths = [f"{folder}/span={first}-{last}" for first, last in spans]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    frames = spark.read.schema(SCHEMA).option("basePath", folder).option("recursiveFileLookup", "false")
    return frames.parquet(*paths).select("name", "keys", "label", "n")


def merge(counts: DataFrame) -> DataFrame:
    return counts.groupBy("name", "keys").agg(F.min("label").alias("label"), F.sum("n").alias("n"))


def _write(counts: DataFrame, folder: str, first: int, last: int) -> None:
    writer = counts.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("name").parquet(f"{folder}/span={first}-{last}")


def store_counts(rows: DataFrame, groups: Callable[[], dict[str, Group]], folder: str, checkpoint: str, fan: int = FAN):
    """Writer that stores the counts of each batch, and merges the folders of ``fan`` batches, ``fan`` times ``fan``, and so on."""
    folder = folder.rstrip("/")

    def store(batch: DataFrame, batch_id: int) -> None:
        _write(tally(batch, groups()), folder, batch_id, batch_id)
        length = fan
        while (batch_id + 1) % length == 0:
            first = batch_id + 1 - length
            # Shorter spans only, so that a repeated batch does not read what it replaces.
            spans = {(a, b) for a, b in _spans(rows.sparkSession, folder) if b - a + 1 < length}
            parts = cover({(a, b) for a, b in spans if a >= first}, first, batch_id)
            _write(merge(_read(rows.sparkSession, folder, parts)), folder, first, batch_id)
            length *= fan

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def stored_counts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(keys, label, n) of one group over all batches so far; only that group's folders are opened."""
    folder = folder.rstrip("/")
    found = _read(spark, folder, cover(_spans(spark, folder))).filter(F.col("name") == name)
    return merge(found).select("keys", "label", "n")


# What is counted, and how it is read


def track_attempts(attempts: DataFrame, folder: str, checkpoint: str, fan: int = FAN):
    """Writer of the counts of located attempts that the rankings and the overview are made of."""
    return store_counts(attempts, _attempt_groups, folder, checkpoint, fan)


def track_days(attempts: DataFrame, folder: str, checkpoint: str, fan: int = FAN):
    """Writer of the counts that the daily summary is made of, so that late attempts change it without a look at others."""
    return store_counts(attempts, _daily_groups, folder, checkpoint, fan)


def track_timeline(events: DataFrame, folder: str, checkpoint: str, fan: int = FAN):
    """Writer of the feed events per hour and day, session starts included."""
    return store_counts(events, _timeline_groups, folder, checkpoint, fan)


def track_lines(lines: DataFrame, folder: str, checkpoint: str, fan: int = FAN):
    """Writer of the accounting of log lines."""
    return store_counts(with_event(lines), _line_groups, folder, checkpoint, fan)


def _keyed(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    keys = [F.col("keys")[i].alias(column) for i, column in enumerate(columns)]
    return stored_counts(spark, folder, name).select(*keys, "label", F.col("n").alias("count"))


def running_countries(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts per country so far; ``rankings.countries_of`` ranks them."""
    return _keyed(spark, folder, "countries", "country_code", "country_name").drop("label")


def running_intents(spark: SparkSession, folder: str) -> DataFrame:
    return rankings.intents_of(_keyed(spark, folder, "intents", "intent").drop("label"))


def running_commands(spark: SparkSession, folder: str, limit: int = 20) -> DataFrame:
    counted = _keyed(spark, folder, "commands", "command").withColumnRenamed("label", "intent")
    return rankings.commands_of(counted.select("command", "count", "intent"), limit)


def running_credentials(spark: SparkSession, folder: str, limit: int = 20) -> DataFrame:
    return rankings.credentials_of(_keyed(spark, folder, "credentials", "username", "password"), limit)


def running_ports(spark: SparkSession, folder: str, limit: int = 10) -> DataFrame:
    counted = _keyed(spark, folder, "ports", "dst_port").withColumn("dst_port", F.col("dst_port").cast("int"))
    return rankings.ports_of(counted, limit)


def running_overview(spark: SparkSession, folder: str, as_of: Column | str) -> DataFrame:
    counted = _keyed(spark, folder, "address_days", "src_ip", "country_code", "day")
    return rankings.overview_of(
        counted.select("src_ip", "country_code", F.col("day").cast("date").alias("day"), F.col("count").alias("n")), as_of
    )


def running_timeline(spark: SparkSession, folder: str, granularity: str = "hour") -> DataFrame:
    """Feed events per UTC hour or day so far, however late they came."""
    return _keyed(spark, folder, granularity, "bucket").drop("label")


def running_days(spark: SparkSession, folder: str) -> DataFrame:
    """The daily summary of all attempts so far."""
    folder = folder.rstrip("/")
    found = merge(_read(spark, folder, cover(_spans(spark, folder))))
    keys = [F.col("keys")[i].alias(column) for i, column in enumerate(("date", "value"))]
    return rollups.daily_of(found.select("name", *keys, "n"))


def running_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row: non-blank lines, ingested lines, lines in error so far."""

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).cast("bigint").alias(name)

    folder = folder.rstrip("/")
    found = _read(spark, folder, cover(_spans(spark, folder))).agg(of("total"), of("ingested"))
    return found.select("total", "ingested", (F.col("total") - F.col("ingested")).alias("errors"))
