"""The sensor's JSON-lines log: reading, line parsing and accounting."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions.times import clock, epoch_micros, parse_timestamp
from trapline.operators.ingest import STORED_KINDS, event_columns, event_kind

# The keys read from a log object.
FIELDS = [
    "eventid", "session", "src_ip", "timestamp", "src_port", "dst_port", "protocol", "username",
    "password", "input", "url", "destfile", "shasum", "outfile", "filename",
]
_OBJECT = "array<struct<" + ", ".join(f"`{name}`: string" for name in FIELDS) + ">>"
# The characters a line is stripped of.
_BLANK = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)


# Copies of a line that are expanded together.
PIECE = 100_000


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a log file, or of a folder of log files, from the beginning."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read_log_stream(
    spark: SparkSession, folder: str, max_files_per_trigger: int | None = None, max_file_age: str = "36500d"
) -> DataFrame:
    """New log files of a folder as they appear.

    The query's checkpoint remembers what was read, so rotation needs no
    handling.  A folder that does not exist yet must be created by the sensor's
    shipper before the query starts.  Files are read however late they are
    shipped; ``max_file_age`` makes the query forget, and skip, files that are older
    than that against the newest one, which keeps the checkpoint small.
    """
    reader = spark.readStream.format("text").option("maxFileAge", max_file_age)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select("value", F.col("_metadata.file_path").alias("file"))


def _null_value(event: Column, key: str) -> Column:
    """True where the key is there with a null value."""
    return event[key].isNull() & F.array_contains("present", key)


def _failed(event: Column) -> Column:
    """Well-formed lines that cannot be processed."""
    stored = F.coalesce(event_kind(event["eventid"]).isin(*STORED_KINDS), F.lit(False))
    return F.col("present").isNotNull() & (
        _null_value(event, "timestamp")
        | _null_value(event, "src_ip")
        | (stored & (_null_value(event, "session") | _null_value(event, "protocol")))
    )


def with_event(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their ``event``, null for malformed and failed lines.

    The line is parsed inside brackets: text after the object then makes it
    malformed.  ``present`` lists the keys of lines that contain ``null``, the
    only ones where a missing key and a null value can differ.

    The one-element explode keeps the parse in a step of its own.  Filters on
    its result are not moved below it, so each line is parsed exactly once.
    """
    line = F.btrim(F.col("value"), F.lit(_BLANK))
    braces = F.startswith(F.col("line"), F.lit("{")) & F.endswith(F.col("line"), F.lit("}"))
    objects = F.from_json(
        F.concat(F.lit("["), F.col("line"), F.lit("]")),
        _OBJECT,
        {"mode": "PERMISSIVE", "allowSingleQuotes": "false"},
    )

    def usable(parsed: Column) -> Column:
        return F.when((F.size(parsed) == 1) & ~_failed(parsed.getItem(0)), parsed.getItem(0))

    return (
        lines.withColumn("line", line)
        .filter(F.col("line") != "")
        .withColumn("present", F.when(F.contains("line", F.lit("null")), F.json_object_keys("line")))
        .withColumn("event", F.explode_outer(F.transform(F.array(F.when(braces, objects)), usable)))
    )


def parse_lines(lines: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Log lines to events with defaults; blank, malformed and failed lines are dropped.

    ``as_of`` stands for the processing time, used where the timestamp text
    cannot be read.  ``id`` is a hash of file and position where the lines have one, so that repeated
    lines have ids of their own, else of file and line, where
    ``number_copies`` makes them distinct; either survives retries.  ``seq``, the log
    order, is the time in microseconds.
    """
    event = F.col("event")
    timestamp = F.coalesce(parse_timestamp(event["timestamp"]), clock(as_of)).alias("timestamp")
    listed = F.col("present").isNotNull()
    columns = event_columns(lambda key: event[key], lambda key: listed & F.array_contains("present", key))
    copies = [name for name in ("copies",) if name in lines.columns]
    return (
        with_event(lines)
        .filter(event.isNotNull())
        .select(F.xxhash64("file", "position" if "position" in lines.columns else "line").alias("id"), timestamp, *columns, *copies)
        .withColumn("seq", epoch_micros(F.col("timestamp")))
    )


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per distinct line of a file, with its number of ``copies``.

    Counting is combined before the shuffle, so a line that makes up a large
    part of the log costs no more than any other.
    """
    return lines.groupBy("file", "value").agg(F.count("*").alias("copies"))


def number_copies(events: DataFrame) -> DataFrame:
    """Expand ``copies`` back to single events whose ids are all distinct.

    A line of more than PIECE copies is cut into pieces that are dealt to all tasks, so no task expands
    more than a piece at once.
    """
    first = F.lit(1).cast("bigint")
    few = events.filter(F.col("copies") <= PIECE).withColumn("copy", F.explode(F.sequence(first, F.col("copies"))))
    starts = F.sequence(first, F.col("copies"), F.lit(PIECE).cast("bigint"))
    many = events.filter(F.col("copies") > PIECE).withColumn("start", F.explode(starts))
    ends = F.least(F.col("start") + (PIECE - 1), F.col("copies"))
    pieces = many.repartition(F.xxhash64("id", "start")).withColumn("copy", F.explode(F.sequence("start", ends)))
    return few.unionByName(pieces.drop("start")).withColumn(
        "id", F.when(F.col("copy") == 1, F.col("id")).otherwise(F.xxhash64("id", "copy"))
    )


def ingest_report(lines: DataFrame) -> DataFrame:
    """One row: non-blank lines, ingested lines, lines in error.

    Ignored events and private sources count as ingested.
    """
    return (
        with_event(lines)
        .agg(F.count("*").alias("total"), F.count("event").alias("ingested"))
        .select("total", "ingested", (F.col("total") - F.col("ingested")).alias("errors"))
    )
