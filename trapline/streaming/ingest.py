"""Streaming ingest: new log files to located events, stored attempts, captured files and feed payloads.

The whole chain is stateless, so it keeps no state between batches and a lost
executor only repeats its tasks.  The checkpoint remembers which files were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.operators.geo import enrich_geo
from trapline.operators.ingest import build_attempts, captured_files, live_feed, normalise
from trapline.sources.loglines import parse_lines
from trapline.sources.tables import stream_table


def events_of(lines: DataFrame, as_of: Column | str | None = None) -> DataFrame:
    """Normalised events of new log lines; unreadable timestamps become the processing time."""
    return normalise(parse_lines(lines, F.localtimestamp() if as_of is None else as_of))


def store_attempts(events: DataFrame, geo_ranges: DataFrame, folder: str, checkpoint: str):
    """Writer that appends located attempts to the stored table."""
    attempts = build_attempts(enrich_geo(events, geo_ranges))
    return stream_table(attempts, folder, "attempts", checkpoint)


def store_captured(events: DataFrame, folder: str, checkpoint: str):
    """Writer that appends captured files to the stored table."""
    return stream_table(captured_files(events), folder, "captured_files", checkpoint)


def feed(events: DataFrame, geo_ranges: DataFrame, checkpoint: str):
    """Writer of one payload per handled event, as ``value``.

    Set the sink on it: ``kafka`` with a topic for a live feed, or files.
    """
    payloads = live_feed(enrich_geo(events, geo_ranges)).select(F.col("payload").alias("value"))
    return payloads.writeStream.option("checkpointLocation", checkpoint)
