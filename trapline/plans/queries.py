"""Named queries over the test tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.functions.addresses import is_private, is_valid_ip, mask_ip, with_ip_number
from trapline.functions.classify import with_verdict
from trapline.functions.display import (
    byte_size,
    details,
    detection_band,
    intent_label,
    json_list,
    pin_band,
    place,
    score_band,
    short_event,
)
from trapline.functions.times import utc_minus_8_midnight
from trapline.operators import (
    addresses,
    captured,
    geo,
    ingest,
    listing,
    maintain,
    rankings,
    rollups,
    sessions,
    timeline,
)
from trapline.plans import pages, streams
from trapline.sources import counted, loglines, telemetry
from trapline.sources.telemetry import AS_OF

Query = Callable[[SparkSession, str], DataFrame]

# Arguments used by the queries below and by their SQL counterparts.
ONE_IP = "20.9.9.7"
NEVER_SEEN_IP = "203.0.113.250"
ONE_HASH = "h57"
ONE_ID = 5
PAGE = 3
PAGE_SIZE = 40
COUNTRIES = ["N1", "N6", "N13"]
INTENTS = ["brute_force", "malware_deployment"]
EVENTS = ["cowrie.login.failed", "cowrie.session.file_download"]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _attempts(spark, folder):
    return telemetry.attempts(spark, folder)


def _dated_attempts(spark, folder):
    return telemetry.attempts(spark, folder, dated=True)


def _scores(spark, folder):
    return telemetry.ip_scores(spark, folder)


# Ingest


@query
def attempts_normalised(spark, folder):
    return telemetry.build_table(spark, folder, "attempts")


@query
def event_routing(spark, folder):
    events = telemetry.events(spark, folder, keep_private=True)
    return events.groupBy("kind", "event_id").agg(F.count("*").alias("events"))


@query
def private_source_filter(spark, folder):
    return telemetry.events(spark, folder).select("id", "session_id", "src_ip", "kind")


@query
def key_defaults(spark, folder):
    return ingest.with_defaults(telemetry.raw_events(spark, folder)).drop("seq")


@query
def login_attempts(spark, folder):
    return ingest.login_attempts(telemetry.events(spark, folder))


@query
def command_attempts(spark, folder):
    return ingest.command_attempts(telemetry.events(spark, folder))


@query
def transfer_attempts(spark, folder):
    return ingest.transfer_attempts(telemetry.events(spark, folder))


@query
def captured_files(spark, folder):
    return captured.list_files(telemetry.build_table(spark, folder, "captured_files"))


@query
def classify_commands(spark, folder):
    """Every whole document text, and every typed command, through the rules."""
    texts = telemetry.read_table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item"), "text"
    )
    typed = (
        telemetry.raw_events(spark, folder)
        .filter(F.col("input").isNotNull())
        .select(F.concat(F.lit("cmd-"), F.col("seq").cast("string")).alias("item"), F.col("input").alias("text"))
    )
    return with_verdict(texts.union(typed), F.col("text")).select("item", "found.intent", "found.mitre_id")


@query
def ingest_report(spark, folder):
    return loglines.ingest_report(telemetry.damaged_lines(spark, folder).withColumnRenamed("line", "value"))


@query
def json_roundtrip(spark, folder):
    """Events to JSON lines, some damaged, back to attempts; ids differ, all else must agree."""
    lines = telemetry.damaged_lines(spark, folder).select(F.col("line").alias("value"), F.lit("log").alias("file"))
    parsed = loglines.parse_lines(lines, AS_OF)
    return ingest.build_attempts(ingest.normalise(parsed)).drop("id")


@query
def json_roundtrip_sessions(spark, folder):
    lines = telemetry.log_lines(spark, folder).select(F.col("line").alias("value"), F.lit("log").alias("file"))
    events = ingest.normalise(loglines.parse_lines(lines, AS_OF))
    return sessions.build_sessions(events, telemetry.geo_ranges(spark, folder))


@query
def repeated_lines(spark, folder):
    """Distinct ids for byte-identical lines: page visits of one kind repeat a lot."""
    lines = telemetry.read_table(spark, folder, "events").select(
        F.to_json(
            F.struct(
                F.lit("cowrie.command.input").alias("eventid"),
                F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("session"),
                F.lit("8.8.4.4").alias("src_ip"),
                F.lit("2024-01-15T00:00:00Z").alias("timestamp"),
                F.col("event_type").alias("input"),
            )
        ).alias("value"),
        F.lit("log").alias("file"),
    )
    once = loglines.distinct_lines(lines)
    events = loglines.number_copies(loglines.parse_lines(once, AS_OF))
    return (
        events.groupBy(F.col("session_id").alias("session"), "input")
        .agg(F.count("*").alias("events"), F.count_distinct("id").alias("ids"))
    )


@query
def live_feed(spark, folder):
    located = geo.enrich_geo(telemetry.events(spark, folder), telemetry.geo_ranges(spark, folder))
    return ingest.live_feed(located)


# Overview and rankings


@query
def overview(spark, folder):
    return rankings.overview(_attempts(spark, folder), AS_OF)


@query
def country_rankings(spark, folder):
    return rankings.country_rankings(_attempts(spark, folder))


@query
def intent_breakdown(spark, folder):
    return rankings.intent_breakdown(_attempts(spark, folder))


@query
def top_commands(spark, folder):
    return rankings.top_commands(_attempts(spark, folder))


@query
def top_credentials(spark, folder):
    return rankings.top_credentials(_attempts(spark, folder))


@query
def top_ports(spark, folder):
    return rankings.top_ports(_attempts(spark, folder), 2)


@query
def filter_options_country(spark, folder):
    return rankings.filter_options(_attempts(spark, folder), "country")


@query
def filter_options_event(spark, folder):
    return rankings.filter_options(_attempts(spark, folder), "event")


@query
def filter_options_intent(spark, folder):
    return rankings.filter_options(_attempts(spark, folder), "intent")


@query
def option_search(spark, folder):
    return listing.search_options(_attempts(spark, folder), "country", "On_1")


@query
def option_search_intent(spark, folder):
    return listing.search_options(_attempts(spark, folder), "intent", "e F")


@query
def option_search_event(spark, folder):
    return listing.search_options(_attempts(spark, folder), "event", "FILE")


@query
def daily_stats(spark, folder):
    return rollups.daily_stats(_attempts(spark, folder))


# Timelines


@query
def timeline_hour(spark, folder):
    return timeline.timeline(_dated_attempts(spark, folder), AS_OF, "hour", 2.3, 0)


@query
def timeline_day_tz(spark, folder):
    return timeline.timeline(_dated_attempts(spark, folder), AS_OF, "day", 30, -330)


@query
def timeline_before_the_end(spark, folder):
    """A clock in the middle of the data: later attempts must not show."""
    return timeline.timeline(_dated_attempts(spark, folder), "2024-01-15 13:20:00", "hour", 1.5, 345)


@query
def timeframe_presets(spark, folder):
    return pages.timeframes(_dated_attempts(spark, folder), AS_OF)


@query
def utc_minus_8_day(spark, folder):
    """Attempts per UTC-8 midnight."""
    midnight = utc_minus_8_midnight(F.col("timestamp")).alias("midnight")
    return _attempts(spark, folder).groupBy(midnight).agg(F.count("*").alias("attempts"))


# Addresses


@query
def unique_ips(spark, folder):
    return addresses.unique_ips(_attempts(spark, folder), _scores(spark, folder))


@query
def ip_summary(spark, folder):
    """One known address."""
    return addresses.ip_summary(_attempts(spark, folder), _scores(spark, folder), ONE_IP)


@query
def ip_summary_unknown(spark, folder):
    return addresses.ip_summary(_attempts(spark, folder), _scores(spark, folder), NEVER_SEEN_IP)


@query
def ip_band_filter(spark, folder):
    return addresses.filter_by_band(addresses.unique_ips(_attempts(spark, folder), _scores(spark, folder), 200), "high")


@query
def missing_scores(spark, folder):
    return addresses.missing_score_count(addresses.unique_ips(_attempts(spark, folder), _scores(spark, folder), 200))


@query
def missing_score_list(spark, folder):
    ips = addresses.unique_ips(_attempts(spark, folder), _scores(spark, folder), 200)
    return addresses.missing_scores(ips).select("src_ip", "count")


@query
def unscored_ips(spark, folder):
    return addresses.unscored_ips(_attempts(spark, folder), _scores(spark, folder))


@query
def fresh_scores(spark, folder):
    return addresses.fresh_scores(_scores(spark, folder), AS_OF)


@query
def merge_scores(spark, folder):
    return addresses.merge_scores(_scores(spark, folder), telemetry.score_updates(spark, folder))


@query
def places_v6(spark, folder):
    """Places of IPv4 and IPv6 sources by networks, the longest prefix first."""
    return geo.enrich_networks(telemetry.mixed_sources(spark, folder), telemetry.networks(spark, folder)).drop("src_ip")


@query
def address_tests(spark, folder):
    """All address functions on every source address."""
    ip = F.col("src_ip")
    seen = telemetry.raw_events(spark, folder).select("src_ip").distinct()
    return with_ip_number(seen, ip, "number").select(
        "src_ip",
        is_private(ip).alias("private"),
        is_valid_ip(ip).alias("valid"),
        "number",
        mask_ip(ip).alias("masked"),
    )


# Map


@query
def geo_pins(spark, folder):
    return geo.geo_pins(_attempts(spark, folder))


@query
def geo_pins_dedupe(spark, folder):
    return geo.geo_pins(_attempts(spark, folder), dedupe=True)


@query
def geo_pins_ties(spark, folder):
    """Times cut to whole days, so that most addresses have several latest attempts."""
    whole_days = _attempts(spark, folder).withColumn("timestamp", F.col("timestamp").cast("date").cast("timestamp_ntz"))
    return geo.geo_pins(whole_days, 60)


@query
def geo_pins_resolved(spark, folder):
    return geo.geo_pins(_attempts(spark, folder), drop_unresolved=True)


# Lists


@query
def attempts_page(spark, folder):
    return counted.stored_page(spark, telemetry.attempts_store(spark, folder), PAGE, PAGE_SIZE)


@query
def attempts_filtered(spark, folder):
    store = telemetry.attempts_store(spark, folder)
    return counted.stored_page(spark, store, 1, 200, country=COUNTRIES, intent=INTENTS, event_id=EVENTS)


@query
def attempts_page_info(spark, folder):
    store = telemetry.attempts_store(spark, folder)
    return counted.stored_page_info(spark, store, PAGE, PAGE_SIZE, country=COUNTRIES, intent=INTENTS)


@query
def attempts_of_ip(spark, folder):
    return listing.filter_attempts(_attempts(spark, folder), ip=ONE_IP)


@query
def recent_attempts(spark, folder):
    return counted.stored_page(spark, telemetry.attempts_store(spark, folder))


@query
def attempt_by_id(spark, folder):
    return listing.get_attempt(_attempts(spark, folder), ONE_ID)


@query
def files_accessed(spark, folder):
    return counted.stored_transfers(spark, telemetry.attempts_store(spark, folder))


@query
def files_accessed_total(spark, folder):
    return listing.files_accessed_total(_attempts(spark, folder))


# Captured files


@query
def file_by_sha(spark, folder):
    return captured.get_file(telemetry.captured(spark, folder), ONE_HASH)


@query
def malware_enriched(spark, folder):
    return captured.enrich_files(telemetry.captured(spark, folder), telemetry.reports(spark, folder))


# Sessions


@query
def session_rollup(spark, folder):
    return telemetry.build_table(spark, folder, "sessions")


# Visitors


@query
def page_views(spark, folder):
    return telemetry.build_table(spark, folder, "page_views")


@query
def viewer_stats(spark, folder):
    from trapline.operators.visitors import viewer_stats as stats

    return stats(telemetry.page_views(spark, folder), AS_OF)


# Upkeep


@query
def all_ips(spark, folder):
    tables = telemetry.unpurged(spark, folder)
    return maintain.all_ips(tables["attempts"], tables["sessions"])


@query
def private_ips(spark, folder):
    tables = telemetry.unpurged(spark, folder)
    return maintain.private_ips(tables["attempts"], tables["sessions"])


@query
def purge_report(spark, folder):
    return maintain.purge_report(telemetry.unpurged(spark, folder))


@query
def purge_kept_attempts(spark, folder):
    return maintain.purge_private(telemetry.unpurged(spark, folder))["attempts"]


@query
def purge_kept_sessions(spark, folder):
    return maintain.purge_private(telemetry.unpurged(spark, folder))["sessions"]


@query
def purge_kept_files(spark, folder):
    return maintain.purge_private(telemetry.unpurged(spark, folder))["captured_files"]


# Display functions over whole tables


@query
def display_columns(spark, folder):
    return _attempts(spark, folder).select(
        "id",
        place(F.col("city"), F.col("country_name"), F.col("country_code")).alias("place"),
        details(F.col("command"), F.col("username"), F.col("password")).alias("details"),
        short_event(F.col("event_id")).alias("event"),
        intent_label(F.col("intent")).alias("label"),
        mask_ip(F.col("src_ip")).alias("masked"),
    )


@query
def score_bands(spark, folder):
    return _scores(spark, folder).select("ip", "abuse_score", score_band(F.col("abuse_score")).alias("band"))


@query
def pin_severity(spark, folder):
    counts = _attempts(spark, folder).groupBy("session_id").agg(F.count("*").alias("count"))
    return counts.withColumn("band", pin_band(F.col("count")))


@query
def detection_bands(spark, folder):
    files = captured.enrich_files(telemetry.captured(spark, folder), telemetry.reports(spark, folder))
    return files.select("id", detection_band(F.col("vt_positives"), F.col("vt_total")).alias("band"))


@query
def byte_sizes(spark, folder):
    """Sizes from bytes to many megabytes."""
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_linenumber")).alias("bytes")
    rows = telemetry.read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", size)
    return rows.withColumn("text", byte_size(F.col("bytes")))


@query
def signature_lists(spark, folder):
    matches = json_list(F.col("yara_matches"))
    return telemetry.captured(spark, folder).select(
        "id", F.array_join(matches, "|").alias("matches"), F.size(matches).cast("bigint").alias("match_count")
    )


# Pages


@query
def ip_table(spark, folder):
    return pages.ip_table(_attempts(spark, folder), _scores(spark, folder), "medium", most_first=False, limit=200)


@query
def attempts_table(spark, folder):
    return pages.attempts_table(_attempts(spark, folder), PAGE, PAGE_SIZE, intent=INTENTS)


@query
def pin_map(spark, folder):
    return pages.pin_map(_attempts(spark, folder))


@query
def malware_list(spark, folder):
    files = captured.enrich_files(telemetry.captured(spark, folder), telemetry.reports(spark, folder))
    return pages.malware_list(files)


@query
def intent_page(spark, folder):
    return pages.intent_page(_attempts(spark, folder))


@query
def country_page(spark, folder):
    return pages.country_page(_attempts(spark, folder))


@query
def country_bars(spark, folder):
    return pages.country_bars(_attempts(spark, folder))


@query
def command_share_of_leader(spark, folder):
    return pages.command_page(_attempts(spark, folder))


@query
def credentials_panel(spark, folder):
    return pages.credentials_panel(_attempts(spark, folder))


# Stored tables and streams

QUERIES.update(streams.QUERIES)
