"""Page-level queries: an operator, the display columns it is shown with, and its order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.display import (
    DASH,
    byte_size,
    details,
    detection_band,
    filled,
    intent_label,
    json_list,
    pin_band,
    pin_label,
    place,
    score_band,
    short_event,
)
from trapline.operators.addresses import filter_by_band, sort_by_attacks, unique_ips
from trapline.operators.captured import list_files
from trapline.operators.geo import geo_pins
from trapline.operators.listing import attempts_page
from trapline.operators.rankings import (
    country_rankings,
    intent_breakdown,
    top_commands,
    top_credentials,
    with_rank,
    with_share_of_leader,
)
from trapline.operators.timeline import TIMEFRAMES, timeline

# Fixed value: how many rows the short rankings show.
SHORT_RANKING = 10


def ip_table(
    attempts: DataFrame, scores: DataFrame, band: str = "all", most_first: bool = True, limit: int = 50
) -> DataFrame:
    """The busiest addresses of one reputation band, with place and band; the sort is applied after the cut."""
    ips = sort_by_attacks(filter_by_band(unique_ips(attempts, scores, limit), band), most_first)
    return ips.select(
        "src_ip",
        place(F.col("city"), F.col("country_name"), F.col("country_code")).alias("place"),
        "count",
        "abuse_score",
        score_band(F.col("abuse_score")).alias("band"),
        F.coalesce(F.col("total_reports").cast("string"), F.lit(DASH)).alias("reports"),
        F.coalesce(filled(F.col("isp")), F.lit(DASH)).alias("isp"),
        "latest_timestamp",
    )


def attempts_table(attempts: DataFrame, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    """One page of attempts with place, short event, details and intent label."""
    return attempts_page(attempts, page, limit, **filters).select(
        "id",
        "timestamp",
        "src_ip",
        "dst_port",
        place(F.col("city"), F.col("country_name"), F.col("country_code")).alias("place"),
        short_event(F.col("event_id")).alias("event"),
        details(F.col("command"), F.col("username"), F.col("password")).alias("details"),
        intent_label(F.col("intent")).alias("intent"),
    )


def pin_map(attempts: DataFrame, limit: int = 500, **options) -> DataFrame:
    """Map pins with colour band, tooltip and popup texts."""
    city, code = F.col("city"), F.col("country_code")
    return geo_pins(attempts, limit, **options).select(
        "latitude",
        "longitude",
        "count",
        pin_band(F.col("count")).alias("band"),
        pin_label(city, code).alias("label"),
        pin_label(city, F.col("country_name")).alias("title"),
        "latest_src_ip",
        "latest_timestamp",
        short_event(F.col("latest_event_id")).alias("event"),
        "id",
    )


def timeframes(attempts: DataFrame, as_of: datetime | str, tz_offset: int = 0) -> DataFrame:
    """The timelines of all offered time frames, one after the other."""
    frames = None
    for label, days, granularity in TIMEFRAMES:
        frame = timeline(attempts, as_of, granularity, days, tz_offset).withColumn("timeframe", F.lit(label))
        frames = frame if frames is None else frames.union(frame)
    return frames.select("timeframe", "bucket", "count")


def malware_list(files: DataFrame) -> DataFrame:
    """Captured files, newest first, with verdict, size text and signature matches."""
    matches = json_list(F.col("yara_matches"))
    score = F.concat_ws("/", F.col("vt_positives").cast("string"), F.col("vt_total").cast("string"))
    return list_files(files).select(
        "id",
        F.coalesce(filled(F.col("filename")), F.lit("unknown")).alias("filename"),
        "sha256",
        "session_id",
        "timestamp",
        F.when(F.col("vt_total").isNull(), DASH).otherwise(score).alias("score"),
        detection_band(F.col("vt_positives"), F.col("vt_total")).alias("band"),
        F.coalesce(filled(F.col("file_type")), F.lit(DASH)).alias("type"),
        byte_size(F.col("file_size")).alias("size"),
        F.array_join(matches, ", ").alias("matches"),
        F.size(matches).cast("bigint").alias("match_count"),
    )


def intent_page(attempts: DataFrame) -> DataFrame:
    """The intent breakdown with labels; ``reference`` is null where no description exists."""
    return intent_breakdown(attempts).select(
        intent_label(F.col("intent")).alias("label"),
        F.coalesce(filled(F.col("mitre_id")), F.lit(DASH)).alias("technique"),
        "count",
        "percentage",
        F.concat_ws(" — ", F.col("mitre_id"), F.col("description")).alias("reference"),
    ).withColumn("reference", filled(F.col("reference")))


def country_page(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """The country ranking with positions."""
    return with_rank(country_rankings(attempts, limit), F.desc("count"), F.asc("country_code"), F.asc("country_name"))


def country_bars(attempts: DataFrame) -> DataFrame:
    """The first ten countries by code."""
    return (
        country_rankings(attempts)
        .orderBy(F.desc("count"), "country_code")
        .limit(SHORT_RANKING)
        .select(F.col("country_code").alias("name"), F.col("count").alias("value"))
    )


def command_page(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """The command ranking with each count as a share of the first."""
    return with_share_of_leader(top_commands(attempts, limit)).withColumn("label", intent_label(F.col("intent")))


def credentials_panel(attempts: DataFrame) -> DataFrame:
    """The first ten of the credentials ranking."""
    return top_credentials(attempts).orderBy(F.desc("count"), "username", "password").limit(SHORT_RANKING)
