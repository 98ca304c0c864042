"""The named queries as plain SQL over the same tables, for comparison."""

from __future__ import annotations

import re

from trapline.functions.classify import COMMAND_RULES, INTENTS as INTENT_ROWS
from trapline.plans.queries import (
    COUNTRIES,
    EVENTS,
    INTENTS,
    NEVER_SEEN_IP,
    ONE_HASH,
    ONE_ID,
    ONE_IP,
    PAGE,
    PAGE_SIZE,
)
from trapline.plans.streams import DEEP_EVENTS, DEEP_PAGE, DEEP_SIZE
from trapline.sources import telemetry

CLOCK = f"TIMESTAMP '{telemetry.AS_OF}'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(_quoted(v) for v in values)


def _source(sql: str, table: str) -> str:
    return sql.replace("{clock}", CLOCK).format(**{table: table})


def _percent(count: str, total: str) -> str:
    return f"CAST(printf('%.1f', {count}::DOUBLE / {total}::DOUBLE * 100) AS DOUBLE)"


def _classified(text: str, item: int) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({text}, {_quoted(rule[0])}, 'i') THEN {_quoted(rule[item])}" for rule in COMMAND_RULES
    )
    return f"CASE {whens} ELSE {_quoted(('unknown', 'T1059')[item - 1])} END"


def _label(intent: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({intent}, '_'), "
        f"lambda w: upper(w[1:1]) || w[2:]), ' ')"
    )


_PLACE = "coalesce(nullif(city, ''), nullif(country_name, ''), nullif(country_code, ''), '?')"
_DETAILS = "coalesce(nullif(command, ''), nullif(username, '') || ':' || coalesce(password, 'null'), '—')"
_SHORT = "regexp_replace(event_id, 'cowrie\\.', '')"
_MASKED = "regexp_replace(src_ip, '^([^.]*\\.[^.]*\\.[^.]*)\\.[^.]*$', '\\1.***')"
_BAND = (
    "CASE WHEN abuse_score IS NULL THEN 'unknown' WHEN abuse_score >= 75 THEN 'critical' "
    "WHEN abuse_score >= 50 THEN 'high' WHEN abuse_score >= 25 THEN 'medium' ELSE 'low' END"
)
_PIN = "CASE WHEN count > 20 THEN 'red' WHEN count > 10 THEN 'orange' WHEN count > 5 THEN 'yellow' ELSE 'blue' END"
_DETECTION = (
    "CASE WHEN vt_positives IS NULL OR vt_total IS NULL OR vt_total = 0 THEN 'unknown' "
    "WHEN vt_positives / vt_total > 0.5 THEN 'high' WHEN vt_positives / vt_total > 0.2 THEN 'medium' "
    "WHEN vt_positives > 0 THEN 'low' ELSE 'clean' END"
)


def _size(column: str) -> str:
    # The tables hold whole numbers far below 2^53, so the halves are exact.
    return (
        f"CASE WHEN {column} IS NULL THEN '—' WHEN {column} < 1024 THEN {column} || ' B' "
        f"WHEN {column} < 1048576 THEN CAST(({column} * 20 + 1024) // 2048 // 10 AS VARCHAR) || '.' || "
        f"CAST(({column} * 20 + 1024) // 2048 % 10 AS VARCHAR) || ' KB' "
        f"ELSE CAST(({column} * 20 + 1048576) // 2097152 // 10 AS VARCHAR) || '.' || "
        f"CAST(({column} * 20 + 1048576) // 2097152 % 10 AS VARCHAR) || ' MB' END"
    )


def _number(ip: str) -> str:
    parts = [f"CAST(split_part({ip}, '.', {n}) AS BIGINT)" for n in (1, 2, 3, 4)]
    return f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"


def _private(number: str) -> str:
    """The private IPv4 networks as number ranges, written out."""
    ranges = [
        "0.0.0.0-0.255.255.255", "10.0.0.0-10.255.255.255", "127.0.0.0-127.255.255.255",
        "169.254.0.0-169.254.255.255", "172.16.0.0-172.31.255.255", "192.0.0.0-192.0.0.255",
        "192.0.2.0-192.0.2.255", "192.168.0.0-192.168.255.255", "198.18.0.0-198.19.255.255",
        "198.51.100.0-198.51.100.255", "203.0.113.0-203.0.113.255", "240.0.0.0-255.255.255.255",
    ]

    def value(ip: str) -> int:
        a, b, c, d = map(int, ip.split("."))
        return a * 16777216 + b * 65536 + c * 256 + d

    tests = [f"{number} BETWEEN {value(r.split('-')[0])} AND {value(r.split('-')[1])}" for r in ranges]
    return f"(({' OR '.join(tests)}) AND {number} NOT IN ({value('192.0.0.9')}, {value('192.0.0.10')}))"


_ATTEMPT_COLUMNS = f"""
 session_id, event_id, timestamp, src_ip, src_port, dst_port, protocol,
 {{places}}
 CASE WHEN kind = 'login' THEN username END AS username, CASE WHEN kind = 'login' THEN password END AS password,
 CASE kind WHEN 'command' THEN input
  WHEN 'transfer' THEN CASE WHEN url <> '' THEN 'download: ' || url ELSE 'upload: ' || filename END END AS command,
 event_id = 'cowrie.login.success' AS success,
 CASE kind WHEN 'login' THEN 'brute_force' WHEN 'command' THEN {_classified("input", 1)} ELSE 'malware_deployment' END AS intent,
 CASE kind WHEN 'login' THEN 'T1110' WHEN 'command' THEN {_classified("input", 2)} ELSE 'T1105' END AS mitre_id
"""
_PLACES = "country_code, country_name, city, latitude, longitude, asn, as_org,"

# Named building blocks; each may use the others by name.
BLOCKS = {
    "raw_events": _source(telemetry.RAW_EVENTS, "events"),
    "geo_ranges": _source(telemetry.GEO_RANGES, "nation"),
    "reports": _source(telemetry.REPORTS, "part"),
    "ip_scores": _source(telemetry.IP_SCORES, "customer"),
    "score_updates": _source(telemetry.SCORE_UPDATES, "supplier"),
    "requests": _source(telemetry.REQUESTS, "events"),
    "every_event": f"""
SELECT seq AS id, session AS session_id, eventid AS event_id, ts AS timestamp, src_ip, src_port,
 coalesce(dst_port, 22) AS dst_port, coalesce(protocol, 'ssh') AS protocol, coalesce(username, '') AS username,
 coalesce(password, '') AS password, coalesce(input, '') AS input, coalesce(url, '') AS url,
 coalesce(shasum, '') AS shasum, coalesce(outfile, '') AS filename, coalesce(outfile, '') AS outfile,
 CASE WHEN eventid LIKE '%login%' THEN 'login' WHEN eventid LIKE '%command%' THEN 'command'
  WHEN eventid LIKE '%load' THEN 'transfer' WHEN eventid LIKE '%closed' THEN 'closed' ELSE 'connect' END AS kind,
 {_number("src_ip")} AS number, {_private(_number("src_ip"))} AS private
FROM raw_events""",
    "public_events": "SELECT * FROM every_event WHERE NOT private",
    "placed_events": """
SELECT e.*, coalesce(g.country_code, '') AS country_code, coalesce(g.country_name, '') AS country_name,
 coalesce(nullif(g.city, ''), g.subdivision, '') AS city, coalesce(g.latitude, 0.0) AS latitude,
 coalesce(g.longitude, 0.0) AS longitude, g.asn, coalesce(g.as_org, '') AS as_org
FROM every_event e LEFT JOIN geo_ranges g ON e.number BETWEEN g.start_ip AND g.end_ip
 AND NOT regexp_matches(e.src_ip, '^(10\\.|172\\.16\\.|192\\.168\\.|127\\.|0\\.)')""",
    "every_attempt": f"SELECT id, {_ATTEMPT_COLUMNS.format(places=_PLACES)} FROM placed_events "
    "WHERE kind IN ('login', 'command', 'transfer')",
    "attempts": f"SELECT id, {_ATTEMPT_COLUMNS.format(places=_PLACES)} FROM placed_events "
    "WHERE kind IN ('login', 'command', 'transfer') AND NOT private",
    "bare_attempts": f"SELECT id, {_ATTEMPT_COLUMNS.format(places='')} FROM public_events "
    "WHERE kind IN ('login', 'command', 'transfer')",
}


def _sessions(events: str) -> str:
    return f"""
SELECT o.session_id, o.src_ip, o.timestamp AS start_time, arg_max(e.timestamp, e.id) FILTER (e.kind = 'closed') AS end_time,
 o.protocol, count(*) FILTER (e.kind = 'login') AS login_attempts, count(*) FILTER (e.kind = 'command') AS commands_run,
 count(*) FILTER (e.kind = 'transfer') AS files_downloaded,
 (epoch_us(arg_max(e.timestamp, e.id) FILTER (e.kind = 'closed')) - epoch_us(o.timestamp)) / 1000000.0::DOUBLE AS duration_secs,
 o.country_code, o.country_name, o.latitude, o.longitude
FROM {events} o
 JOIN (SELECT session_id, min(id) AS id FROM {events} WHERE kind = 'connect' GROUP BY session_id) f ON o.id = f.id
 LEFT JOIN {events} e ON e.session_id = o.session_id AND e.id > o.id
GROUP BY o.session_id, o.src_ip, o.timestamp, o.protocol, o.country_code, o.country_name, o.latitude, o.longitude"""


def _files(events: str) -> str:
    return f"""
SELECT id, id AS attempt_id, session_id, timestamp, coalesce(split_part(filename, '/', -1), '') AS filename, url,
 shasum AS sha256, CAST(NULL AS BIGINT) AS file_size, CAST(NULL AS VARCHAR) AS file_type, outfile AS local_path,
 CAST(NULL AS INT) AS vt_positives, CAST(NULL AS INT) AS vt_total, CAST(NULL AS VARCHAR) AS vt_link,
 CASE id % 4 WHEN 0 THEN '["dropper","packed"]' WHEN 1 THEN '[]' WHEN 2 THEN 'not json' END AS yara_matches,
 CAST(NULL AS VARCHAR) AS malware_family
FROM {events} WHERE kind = 'transfer' AND shasum <> ''"""


BLOCKS["public_placed"] = "SELECT * FROM placed_events WHERE NOT private"
BLOCKS["sessions"] = _sessions("public_placed")
BLOCKS["every_session"] = _sessions("placed_events")
BLOCKS["captured"] = _files("public_events")
BLOCKS["every_captured"] = _files("every_event")
BLOCKS["enriched"] = """
SELECT c.id, attempt_id, session_id, timestamp, filename, url, c.sha256,
 CASE WHEN r.sha256 IS NULL OR coalesce(file_size, 0) <> 0 THEN file_size ELSE r.size END AS file_size,
 CASE WHEN r.sha256 IS NULL OR coalesce(file_type, '') <> '' THEN file_type
  ELSE coalesce(nullif(type_description, ''), nullif(magic, ''), '') END AS file_type,
 local_path,
 CAST(json_extract(r.last_analysis_stats, '$.malicious') AS INT) AS vt_positives,
 CAST(json_extract(r.last_analysis_stats, '$.malicious') AS INT)
  + CAST(json_extract(r.last_analysis_stats, '$.undetected') AS INT) AS vt_total,
 'https://www.virustotal.com/gui/file/' || r.sha256 AS vt_link, yara_matches, malware_family
FROM captured c LEFT JOIN reports r ON c.sha256 = r.sha256"""
BLOCKS["page_views"] = """
WITH picked AS (
 SELECT *, coalesce(client_host, 'unknown') AS peer,
  coalesce(nullif(x_real_ip, ''), nullif(trim(split_part(x_forwarded_for, ',', 1)), ''), client_host, 'unknown') AS candidate
 FROM requests)
SELECT id, CASE WHEN regexp_matches(candidate, '^(\\d+)\\.(\\d+)\\.(\\d+)\\.(\\d+)$') THEN candidate ELSE peer END AS visitor_ip,
 user_agent, visited_at
FROM picked"""
BLOCKS["countries"] = f"""
SELECT country_code, coalesce(nullif(country_name, ''), country_code) AS country_name, count(*) AS count,
 {_percent("count(*)", "(SELECT count(*) FROM attempts)")} AS percentage
FROM attempts GROUP BY country_code, country_name ORDER BY count(*) DESC, country_code, country_name LIMIT 20"""
BLOCKS["intents"] = f"""
SELECT a.intent, a.count, {_percent("a.count", "(SELECT count(*) FROM bare_attempts)")} AS percentage, d.mitre_id, d.description
FROM (SELECT intent, count(*) AS count FROM bare_attempts GROUP BY intent) a
 LEFT JOIN (VALUES {", ".join(f"({_list(row)})" for row in INTENT_ROWS)}) d(intent, mitre_id, description) ON a.intent = d.intent"""
BLOCKS["commands"] = """
SELECT command, count(*) AS count, min(intent) AS intent FROM bare_attempts WHERE command <> ''
GROUP BY command ORDER BY count(*) DESC, command LIMIT 20"""
BLOCKS["credentials"] = """
SELECT username, coalesce(password, '') AS password, count(*) AS count FROM bare_attempts WHERE username IS NOT NULL
GROUP BY username, bare_attempts.password ORDER BY count(*) DESC, username, bare_attempts.password NULLS FIRST LIMIT 20"""


def _ips(limit: int) -> str:
    return f"""
SELECT t.*, s.abuse_score, s.isp, s.usage_type, s.total_reports FROM (
 SELECT src_ip, count(*) AS count, max(country_code) AS country_code, max(country_name) AS country_name, max(city) AS city,
  max(timestamp) AS latest_timestamp
 FROM attempts GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT {limit}) t
LEFT JOIN ip_scores s ON t.src_ip = s.ip"""


BLOCKS["ips_50"] = _ips(50)
BLOCKS["ips_200"] = _ips(200)


def _pins(attempts: str, limit: int, dedupe: bool = False) -> str:
    keep = "QUALIFY row_number() OVER (PARTITION BY a.src_ip ORDER BY a.id DESC) = 1" if dedupe else ""
    return f"""
SELECT latitude, longitude, count, country_code, country_name, city, latest_timestamp, event_id AS latest_event_id,
 src_ip AS latest_src_ip, id
FROM (
 SELECT a.*, b.count, b.latest_timestamp FROM {attempts} a
 JOIN (SELECT src_ip, count(*) AS count, max(timestamp) AS latest_timestamp FROM {attempts}
  WHERE latitude IS NOT NULL GROUP BY src_ip) b ON a.src_ip = b.src_ip AND a.timestamp = b.latest_timestamp
 {keep})
ORDER BY count DESC, latest_src_ip, id LIMIT {limit}"""


BLOCKS["pins"] = _pins("attempts", 500)
BLOCKS["whole_days"] = "SELECT * REPLACE (date_trunc('day', timestamp)::TIMESTAMP AS timestamp) FROM attempts"
BLOCKS["resolved"] = "SELECT * FROM attempts WHERE country_code <> ''"


def _timeline(clock: str, granularity: str, days: float, offset: int) -> str:
    label = "%Y-%m-%d %H:00" if granularity == "hour" else "%Y-%m-%d"
    now = f"(TIMESTAMP '{clock}')"
    since = f"({now} - to_microseconds({round(days * 86400000000)}))"
    shift = f"to_minutes({offset})"
    return f"""
SELECT strftime(c.start, '{label}') AS bucket, count(a.id) AS count
FROM (SELECT unnest(generate_series(date_trunc('{granularity}', {since} + {shift})::TIMESTAMP, {now} + {shift}, INTERVAL 1 {granularity})) AS start) c
 LEFT JOIN (SELECT id, strftime(timestamp + {shift}, '{label}') AS bucket FROM bare_attempts WHERE timestamp >= {since}) a
  ON a.bucket = strftime(c.start, '{label}')
GROUP BY c.start"""


def _tops(name: str, column: str, condition: str) -> str:
    return f"""{name} AS (
 SELECT strftime(timestamp, '%Y-%m-%d') AS date, {column} AS value FROM attempts WHERE {condition} GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY strftime(timestamp, '%Y-%m-%d') ORDER BY count(*) DESC, {column}) = 1)"""


# Events whose log line is readable: the damaged lines are chosen by their number.
_READABLE = "id % 50 NOT IN (7, 8, 9, 10)"

_FEED = f"""
CASE kind
 WHEN 'connect' THEN json_object('type', 'session_start', 'session_id', session_id, 'src_ip', src_ip,
  'country', country_name, 'protocol', protocol)
 WHEN 'login' THEN json_object('type', 'login_attempt', 'session_id', session_id, 'src_ip', src_ip,
  'username', username, 'password', password, 'success', event_id = 'cowrie.login.success',
  'country', country_name, 'latitude', latitude, 'longitude', longitude)
 WHEN 'command' THEN json_object('type', 'command', 'session_id', session_id, 'src_ip', src_ip,
  'command', input, 'intent', {_classified("input", 1)}, 'mitre_id', {_classified("input", 2)},
  'country', country_name, 'latitude', latitude, 'longitude', longitude)
 ELSE json_object('type', 'file_download', 'session_id', session_id, 'src_ip', src_ip, 'url', url,
  'sha256', shasum, 'country', country_name) END::VARCHAR"""

_NEWEST = "ORDER BY timestamp DESC, id DESC"
_PRIVATE_IP = _private(_number("src_ip"))

QUERIES = {
    "attempts_normalised": "SELECT * FROM attempts",
    "event_routing": "SELECT kind, event_id, count(*) AS events FROM every_event GROUP BY ALL",
    "private_source_filter": "SELECT id, session_id, src_ip, kind FROM public_events",
    "key_defaults": "SELECT * EXCLUDE (kind, number, private) FROM every_event",
    "login_attempts": "SELECT * FROM bare_attempts WHERE event_id LIKE '%login%'",
    "command_attempts": "SELECT * FROM bare_attempts WHERE event_id LIKE '%command%'",
    "transfer_attempts": "SELECT * FROM bare_attempts WHERE event_id LIKE '%load'",
    "captured_files": "SELECT * FROM captured",
    "classify_commands": f"""
SELECT item, {_classified("text", 1)} AS intent, {_classified("text", 2)} AS mitre_id FROM (
 SELECT 'doc-' || doc_id AS item, text FROM documents
 UNION ALL SELECT 'cmd-' || seq, input FROM raw_events WHERE input IS NOT NULL)""",
    "ingest_report": f"""
SELECT count(*) FILTER (seq % 50 <> 7) AS total, count(*) FILTER (seq % 50 NOT IN (7, 8, 9, 10)) AS ingested,
 count(*) FILTER (seq % 50 IN (8, 9, 10)) AS errors FROM raw_events""",
    "json_roundtrip": f"SELECT * EXCLUDE (id) FROM bare_attempts WHERE {_READABLE}",
    "json_roundtrip_sessions": "SELECT * FROM sessions",
    "repeated_lines": """
SELECT 's' || (user_id % 7) AS session, event_type AS input, count(*) AS events, count(*) AS ids FROM events GROUP BY ALL""",
    "live_feed": f"SELECT id, timestamp, {_FEED} AS payload FROM public_placed WHERE kind <> 'closed'",
    "overview": f"""
SELECT count(*) AS total_attempts, count(DISTINCT src_ip) AS unique_ips, count(DISTINCT country_code) AS unique_countries,
 count(*) FILTER (timestamp >= date_trunc('day', {CLOCK} - INTERVAL 8 HOUR) + INTERVAL 8 HOUR) AS attacks_today,
 CAST(0 AS BIGINT) AS active_sessions FROM attempts""",
    "country_rankings": "SELECT * FROM countries",
    "intent_breakdown": "SELECT * FROM intents",
    "top_commands": "SELECT * FROM commands",
    "top_credentials": "SELECT * FROM credentials",
    "top_ports": f"""
WITH top AS (SELECT dst_port AS port, count(*) AS count FROM bare_attempts GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 2)
SELECT port, count, {_percent("count", "(SELECT sum(count) FROM top)")} AS percentage FROM top""",
    "filter_options_country": """
SELECT DISTINCT country_code AS code, country_name AS name FROM attempts WHERE country_code <> ''""",
    "filter_options_event": "SELECT DISTINCT event_id AS value FROM bare_attempts",
    "filter_options_intent": "SELECT DISTINCT intent AS value FROM bare_attempts WHERE intent <> ''",
    "option_search": """
SELECT DISTINCT country_code AS code, country_name AS name FROM attempts
WHERE country_code <> '' AND (country_name ILIKE '%on\\_1%' ESCAPE '\\' OR country_code ILIKE '%on\\_1%' ESCAPE '\\')""",
    "option_search_intent": f"""
SELECT DISTINCT intent AS value FROM bare_attempts
WHERE contains(lower(intent), 'e f') OR contains(lower({_label("intent")}), 'e f')""",
    "option_search_event": "SELECT DISTINCT event_id AS value FROM bare_attempts WHERE event_id ILIKE '%file%'",
    "daily_stats": f"""
WITH days AS (
 SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS total_attempts, count(DISTINCT src_ip) AS unique_ips,
  count(DISTINCT country_code) AS unique_countries FROM attempts GROUP BY 1),
 {_tops("c", "country_code", "country_code IS NOT NULL")}, {_tops("u", "username", "username IS NOT NULL")},
 {_tops("p", "password", "password IS NOT NULL")}, {_tops("m", "command", "command <> ''")}
SELECT days.*, c.value AS top_country, u.value AS top_username, p.value AS top_password, m.value AS top_command
FROM days LEFT JOIN c USING (date) LEFT JOIN u USING (date) LEFT JOIN p USING (date) LEFT JOIN m USING (date)""",
    "timeline_hour": _timeline(telemetry.AS_OF, "hour", 2.3, 0),
    "timeline_day_tz": _timeline(telemetry.AS_OF, "day", 30, -330),
    "timeline_before_the_end": _timeline("2024-01-15 13:20:00", "hour", 1.5, 345),
    "timeframe_presets": " UNION ALL ".join(
        f"SELECT '{name}' AS timeframe, * FROM ({_timeline(telemetry.AS_OF, granularity, days, 0)})"
        for name, days, granularity in [("6h", 0.25, "hour"), ("24h", 1, "hour"), ("7d", 7, "day"), ("30d", 30, "day")]
    ),
    "utc_minus_8_day": """
SELECT date_trunc('day', timestamp - INTERVAL 8 HOUR)::TIMESTAMP + INTERVAL 8 HOUR AS midnight, count(*) AS attempts
FROM bare_attempts GROUP BY 1""",
    "unique_ips": "SELECT * FROM ips_50",
    "ip_summary": f"""
SELECT '{ONE_IP}' AS src_ip, a.*, s.abuse_score, s.isp, s.usage_type, s.total_reports FROM (
 SELECT count(*) AS count, max(country_code) AS country_code, max(country_name) AS country_name, max(city) AS city,
  max(timestamp) AS latest_timestamp FROM attempts WHERE src_ip = '{ONE_IP}') a
LEFT JOIN ip_scores s ON s.ip = '{ONE_IP}'""",
    "ip_summary_unknown": f"""
SELECT '{NEVER_SEEN_IP}' AS src_ip, CAST(0 AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS country_code,
 CAST(NULL AS VARCHAR) AS country_name, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS TIMESTAMP) AS latest_timestamp,
 CAST(NULL AS INT) AS abuse_score, CAST(NULL AS VARCHAR) AS isp, CAST(NULL AS VARCHAR) AS usage_type,
 CAST(NULL AS INT) AS total_reports
WHERE NOT EXISTS (SELECT 1 FROM attempts WHERE src_ip = '{NEVER_SEEN_IP}')""",
    "ip_band_filter": "SELECT * FROM ips_200 WHERE abuse_score >= 50 AND abuse_score < 75",
    "missing_scores": "SELECT count(*) FILTER (abuse_score IS NULL) AS missing, count(*) AS total FROM ips_200",
    "missing_score_list": "SELECT src_ip, count FROM ips_200 WHERE abuse_score IS NULL",
    "unscored_ips": "SELECT DISTINCT src_ip FROM bare_attempts WHERE src_ip NOT IN (SELECT ip FROM ip_scores)",
    "fresh_scores": f"SELECT * FROM ip_scores WHERE {CLOCK} - fetched_at < INTERVAL 7 DAY",
    "merge_scores": """
SELECT * EXCLUDE (is_update) FROM (
 SELECT *, 0 AS is_update FROM ip_scores UNION ALL SELECT *, 1 AS is_update FROM score_updates)
QUALIFY row_number() OVER (PARTITION BY ip ORDER BY fetched_at DESC, is_update DESC, abuse_score DESC, isp DESC) = 1""",
    "address_tests": f"""
SELECT DISTINCT src_ip, private, true AS valid, number, {_MASKED} AS masked FROM every_event""",
    "geo_pins": "SELECT * FROM pins",
    "geo_pins_dedupe": _pins("attempts", 500, dedupe=True),
    "geo_pins_ties": _pins("whole_days", 60),
    "geo_pins_resolved": _pins("resolved", 500),
    "attempts_page": f"SELECT * FROM attempts {_NEWEST} LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE}",
    "attempts_filtered": f"""
SELECT * FROM attempts WHERE country_code IN ({_list(COUNTRIES)}) AND intent IN ({_list(INTENTS)})
 AND event_id IN ({_list(EVENTS)}) {_NEWEST} LIMIT 200""",
    "attempts_page_info": f"""
SELECT count(*) AS total, CAST({PAGE} AS BIGINT) AS page,
 greatest(1, (count(*) + {PAGE_SIZE - 1}) // {PAGE_SIZE}) AS pages
FROM attempts WHERE country_code IN ({_list(COUNTRIES)}) AND intent IN ({_list(INTENTS)})""",
    "attempts_of_ip": f"SELECT * FROM attempts WHERE src_ip = '{ONE_IP}'",
    "stored_pages": f"""
SELECT * EXCLUDE (place), CAST(CASE WHEN place <= {DEEP_SIZE} THEN 1 ELSE {DEEP_PAGE} END AS INTEGER) AS page
FROM (SELECT *, row_number() OVER ({_NEWEST}) AS place FROM attempts WHERE event_id IN ({_list(DEEP_EVENTS)}))
WHERE place <= {DEEP_SIZE} OR (place > {(DEEP_PAGE - 1) * DEEP_SIZE} AND place <= {DEEP_PAGE * DEEP_SIZE})""",
    "recent_attempts": f"SELECT * FROM attempts {_NEWEST} LIMIT 50",
    "attempt_by_id": f"SELECT * FROM attempts WHERE id = {ONE_ID}",
    "files_accessed": f"""
SELECT id, coalesce(nullif(command, ''), event_id) AS label, timestamp, src_ip, country_code
FROM attempts WHERE intent = 'malware_deployment' {_NEWEST} LIMIT 100""",
    "files_accessed_total": "SELECT count(*) AS total FROM bare_attempts WHERE intent = 'malware_deployment'",
    "file_by_sha": f"SELECT * FROM captured WHERE sha256 = '{ONE_HASH}' ORDER BY id LIMIT 1",
    "malware_enriched": "SELECT * FROM enriched",
    "session_rollup": "SELECT * FROM sessions",
    "page_views": "SELECT * FROM page_views",
    "viewer_stats": f"""
SELECT count(*) AS total_views, count(DISTINCT visitor_ip) AS unique_visitors,
 count(*) FILTER (visited_at >= date_trunc('day', {CLOCK} - INTERVAL 8 HOUR) + INTERVAL 8 HOUR) AS views_today,
 count(DISTINCT visitor_ip) FILTER (visited_at >= {CLOCK} - INTERVAL 24 HOUR) AS unique_last_24h FROM page_views""",
    "all_ips": "SELECT src_ip FROM every_attempt UNION SELECT src_ip FROM every_session",
    "private_ips": f"""
SELECT i.src_ip, count(a.id) AS attempts
FROM (SELECT src_ip FROM every_attempt UNION SELECT src_ip FROM every_session) i
 LEFT JOIN every_attempt a ON a.src_ip = i.src_ip
WHERE {_private(_number("i.src_ip"))} GROUP BY i.src_ip""",
    "purge_report": f"""
SELECT (SELECT count(*) FROM every_attempt WHERE {_PRIVATE_IP}) AS attempts_deleted,
 (SELECT count(*) FROM every_session WHERE {_PRIVATE_IP}) AS sessions_deleted,
 (SELECT count(*) FROM every_captured WHERE attempt_id IN (SELECT id FROM every_attempt WHERE {_PRIVATE_IP})) AS files_deleted""",
    "purge_kept_attempts": f"SELECT * FROM every_attempt WHERE NOT {_PRIVATE_IP}",
    "purge_kept_sessions": f"SELECT * FROM every_session WHERE NOT {_PRIVATE_IP}",
    "purge_kept_files": f"""
SELECT * FROM every_captured WHERE attempt_id NOT IN (SELECT id FROM every_attempt WHERE {_PRIVATE_IP})""",
    "display_columns": f"""
SELECT id, {_PLACE} AS place, {_DETAILS} AS details, {_SHORT} AS event, {_label("intent")} AS label, {_MASKED} AS masked
FROM attempts""",
    "score_bands": f"SELECT ip, abuse_score, {_BAND} AS band FROM ip_scores",
    "pin_severity": f"""
SELECT session_id, count, {_PIN} AS band FROM (SELECT session_id, count(*) AS count FROM bare_attempts GROUP BY session_id)""",
    "detection_bands": f"SELECT id, {_DETECTION} AS band FROM enriched",
    "byte_sizes": f"""
SELECT *, {_size("bytes")} AS text FROM (
 SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity * l_linenumber) AS BIGINT) AS bytes FROM lineitem)""",
    "signature_lists": """
SELECT id, CASE WHEN id % 4 = 0 THEN 'dropper|packed' ELSE '' END AS matches,
 CAST(CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS match_count FROM captured""",
    "ip_table": f"""
SELECT src_ip, {_PLACE} AS place, count, abuse_score, {_BAND} AS band, coalesce(CAST(total_reports AS VARCHAR), '—') AS reports,
 coalesce(nullif(isp, ''), '—') AS isp, latest_timestamp
FROM ips_200 WHERE abuse_score >= 25 AND abuse_score < 50""",
    "attempts_table": f"""
SELECT id, timestamp, src_ip, dst_port, {_PLACE} AS place, {_SHORT} AS event, {_DETAILS} AS details,
 {_label("intent")} AS intent
FROM (SELECT * FROM attempts WHERE intent IN ({_list(INTENTS)}) {_NEWEST} LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE})""",
    "pin_map": f"""
SELECT latitude, longitude, count, {_PIN} AS band,
 coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(country_code, '')), ''), 'Unknown') AS label,
 coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(country_name, '')), ''), 'Unknown') AS title,
 latest_src_ip, latest_timestamp, regexp_replace(latest_event_id, 'cowrie\\.', '') AS event, id
FROM pins""",
    "malware_list": f"""
SELECT id, coalesce(nullif(filename, ''), 'unknown') AS filename, sha256, session_id, timestamp,
 CASE WHEN vt_total IS NULL THEN '—' ELSE vt_positives || '/' || vt_total END AS score, {_DETECTION} AS band,
 coalesce(nullif(file_type, ''), '—') AS type, {_size("file_size")} AS size,
 CASE WHEN id % 4 = 0 THEN 'dropper, packed' ELSE '' END AS matches,
 CAST(CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS match_count
FROM enriched""",
    "intent_page": f"""
SELECT {_label("intent")} AS label, coalesce(mitre_id, '—') AS technique, count, percentage,
 mitre_id || ' — ' || description AS reference FROM intents""",
    "country_page": """
SELECT *, CAST(row_number() OVER (ORDER BY count DESC, country_code, country_name) AS INT) AS rank FROM countries""",
    "country_bars": "SELECT country_code AS name, count AS value FROM countries ORDER BY count DESC, country_code LIMIT 10",
    "command_share_of_leader": f"""
SELECT command, count, intent, count::DOUBLE / (SELECT max(count) FROM commands)::DOUBLE * 100.0::DOUBLE AS share,
 {_label("intent")} AS label FROM commands""",
    "credentials_panel": "SELECT * FROM credentials ORDER BY count DESC, username, password LIMIT 10",
    # Written and streamed: the results must be those of the batch queries.
    "log_read": "SELECT eventid AS event_id, count(*) AS lines FROM raw_events GROUP BY eventid",
    "stored_attempts": """
SELECT * FROM attempts WHERE country_code IN ('N1', 'N6') AND timestamp >= TIMESTAMP '2024-01-15 00:00:00'
 AND timestamp < TIMESTAMP '2024-01-16 00:00:00'""",
    "stored_captured": "SELECT * FROM captured",
    "stored_page_views": "SELECT * FROM page_views",
    "stream_attempts": "SELECT * EXCLUDE (id) FROM attempts",
    "stream_captured": "SELECT session_id, timestamp, filename, url, sha256, local_path FROM captured",
    "stream_feed": f"SELECT {_FEED} AS payload FROM public_placed WHERE kind <> 'closed'",
    "stream_sessions": "SELECT * FROM sessions",
    "stream_sessions_compacted": "SELECT * EXCLUDE (country_code, country_name, latitude, longitude) FROM sessions",
    "stream_timeline": """
SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS bucket, count(*) AS count FROM public_events WHERE kind <> 'closed' GROUP BY 1""",
    "stream_countries": "SELECT country_code, country_name, count(*) AS count FROM attempts GROUP BY ALL",
    "stream_unscored": "SELECT DISTINCT src_ip FROM bare_attempts WHERE src_ip NOT IN (SELECT ip FROM ip_scores)",
}
QUERIES["stream_overview"] = QUERIES["overview"]
QUERIES["stream_intents"] = QUERIES["intent_breakdown"]
QUERIES["stream_commands"] = QUERIES["top_commands"]
QUERIES["stream_credentials"] = QUERIES["top_credentials"]
QUERIES["stream_ports"] = QUERIES["top_ports"]
# A /47 holds two neighbours of the second octet, a /16 one.
QUERIES["places_v6"] = """
WITH octets AS (
 SELECT seq, split_part(src_ip, '.', 1)::BIGINT AS a, split_part(src_ip, '.', 2)::BIGINT AS b, seq % 4 IN (1, 2) AS wide6 FROM raw_events)
SELECT seq, coalesce('N' || n_nationkey, '') AS country_code, coalesce(n_name, '') AS country_name,
 CASE WHEN n_nationkey IS NULL THEN '' WHEN wide6 AND (a * 256 + b) // 2 = ((11 + 7 * n_nationkey) * 256 + n_nationkey) // 2 THEN 'narrow'
  WHEN NOT wide6 AND b = n_nationkey THEN 'narrow' ELSE 'wide' END AS city,
 coalesce(n_nationkey::DOUBLE, 0.0::DOUBLE) AS latitude, coalesce(0.0::DOUBLE - n_nationkey, 0.0::DOUBLE) AS longitude, n_nationkey::BIGINT AS asn,
 coalesce('AS-' || n_name, '') AS as_org
FROM octets LEFT JOIN nation ON 11 + 7 * n_nationkey = a"""
QUERIES["stream_report"] = QUERIES["ingest_report"]
QUERIES["stream_daily_stats"] = QUERIES["daily_stats"]
QUERIES["upsert_scores"] = QUERIES["merge_scores"]
QUERIES["purge_stored"] = f"""
SELECT session_id, timestamp, event_id AS detail FROM every_attempt WHERE NOT {_PRIVATE_IP} UNION ALL
SELECT session_id, timestamp, sha256 FROM every_captured WHERE attempt_id NOT IN (SELECT id FROM every_attempt WHERE {_PRIVATE_IP})"""
QUERIES["stream_timeline_late"] = QUERIES["stream_timeline"].replace("%d %H:00", "%d")
QUERIES["tail_growing_log"] = """
SELECT src_ip, event_id, CAST(timestamp AS DATE) AS day, count(*) AS attempts, count(*) AS ids FROM attempts GROUP BY ALL"""
QUERIES["tail_repeated_lines"] = """
SELECT event_id, 2 * count(*) AS attempts, 2 * count(*) AS ids FROM attempts GROUP BY ALL"""
# Asked when first seen, and again as soon as 60 seconds have passed: in every other batch.
QUERIES["stream_unscored_retry"] = """
WITH parts AS (SELECT seq, ntile(4) OVER (ORDER BY seq) - 1 AS part FROM raw_events),
seen AS (SELECT src_ip, min(part) AS first FROM bare_attempts a JOIN parts p ON p.seq = a.id GROUP BY src_ip)
SELECT src_ip, CAST(1 + (3 - first) // 2 AS INT) AS tries, (3 - first) % 2 = 0 AS due FROM seen
WHERE src_ip NOT IN (SELECT ip FROM ip_scores)"""
QUERIES["log_ingest"] = QUERIES["stream_attempts"]
QUERIES["stream_late_file"] = """
SELECT session_id, timestamp, event_id AS detail FROM attempts UNION ALL SELECT session_id, timestamp, sha256 FROM captured"""
QUERIES["store_mixed"] = f"""
SELECT unnest(['batch first', 'stream first']) AS way, * FROM ({QUERIES["stream_late_file"].strip()})"""


def _used_by(text: str, found: list[str]) -> list[str]:
    for name in BLOCKS:
        if name not in found and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
            _used_by(BLOCKS[name], found)
            found.append(name)
    return found


def full_sql(name: str) -> str:
    """One statement: the query with the building blocks it needs."""
    text = QUERIES[name].strip()
    blocks = ", ".join(f"{block} AS ({BLOCKS[block].strip()})" for block in _used_by(text, []))
    if not blocks:
        return text
    if text.startswith("WITH "):
        return f"WITH {blocks}, {text[5:]}"
    return f"WITH {blocks} {text}"
