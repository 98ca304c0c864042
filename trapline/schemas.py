"""Declared schemas of the stored tables."""

from __future__ import annotations

ATTEMPTS = """
    id BIGINT, session_id STRING, event_id STRING, timestamp TIMESTAMP_NTZ, src_ip STRING,
    src_port INT, dst_port INT, protocol STRING,
    country_code STRING, country_name STRING, city STRING, latitude DOUBLE, longitude DOUBLE,
    asn BIGINT, as_org STRING,
    username STRING, password STRING, command STRING, success BOOLEAN,
    intent STRING, mitre_id STRING
"""

SESSIONS = """
    session_id STRING, src_ip STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, protocol STRING,
    login_attempts BIGINT, commands_run BIGINT, files_downloaded BIGINT, duration_secs DOUBLE,
    country_code STRING, country_name STRING, latitude DOUBLE, longitude DOUBLE
"""

CAPTURED_FILES = """
    id BIGINT, attempt_id BIGINT, session_id STRING, timestamp TIMESTAMP_NTZ, filename STRING, url STRING,
    sha256 STRING, file_size BIGINT, file_type STRING, local_path STRING,
    vt_positives INT, vt_total INT, vt_link STRING, yara_matches STRING, malware_family STRING
"""

IP_SCORES = """
    ip STRING, abuse_score INT, isp STRING, usage_type STRING, total_reports INT, fetched_at TIMESTAMP_NTZ
"""

PAGE_VIEWS = "id BIGINT, visitor_ip STRING, user_agent STRING, visited_at TIMESTAMP_NTZ"

DAILY_STATS = """
    date STRING, total_attempts BIGINT, unique_ips BIGINT, unique_countries BIGINT,
    top_country STRING, top_username STRING, top_password STRING, top_command STRING
"""

GEO_RANGES = """
    start_ip BIGINT, end_ip BIGINT, country_code STRING, country_name STRING, city STRING,
    subdivision STRING, latitude DOUBLE, longitude DOUBLE, asn BIGINT, as_org STRING
"""

REPORTS = """
    sha256 STRING, last_analysis_stats STRING, size BIGINT, type_description STRING, magic STRING
"""

RAW_EVENTS = """
    seq BIGINT, ts TIMESTAMP_NTZ, session STRING, src_ip STRING, eventid STRING, protocol STRING,
    src_port INT, dst_port INT, username STRING, password STRING, input STRING, url STRING,
    shasum STRING, outfile STRING, id BIGINT
"""

TABLES = {
    "raw_events": RAW_EVENTS,
    "attempts": ATTEMPTS,
    "sessions": SESSIONS,
    "captured_files": CAPTURED_FILES,
    "ip_scores": IP_SCORES,
    "page_views": PAGE_VIEWS,
    "daily_stats": DAILY_STATS,
    "geo_ranges": GEO_RANGES,
    "reports": REPORTS,
}

# Tables that are stored in date folders, with the column the date comes from.
PARTITIONED_BY_DATE_OF = {"attempts": "timestamp", "captured_files": "timestamp", "page_views": "visited_at"}
DATE_COLUMN = "event_date"
# The folder of one append, below the table's.
ARRIVAL_COLUMN = "arrival"
