"""Raw events to attempts, captured files and live-feed payloads.

Every step is a projection or a filter, so a whole ingest is one pass over the
log with no shuffle, in batch and in streaming alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.addresses import is_private
from trapline.functions.classify import LOGIN, TRANSFER, verdict, with_verdict
from trapline.functions.display import filled

# Event names and the kind each is handled as.
EVENT_KINDS = {
    "cowrie.session.connect": "connect",
    "cowrie.login.failed": "login",
    "cowrie.login.success": "login",
    "cowrie.command.input": "command",
    "cowrie.session.file_download": "transfer",
    "cowrie.session.file_upload": "transfer",
    "cowrie.session.closed": "closed",
}
LOGIN_SUCCESS = "cowrie.login.success"
ATTEMPT_KINDS = ["login", "command", "transfer"]
STORED_KINDS = ["connect", *ATTEMPT_KINDS]

# What stands in for a missing key.
DEFAULT_DST_PORT = 22
DEFAULT_PROTOCOL = "ssh"

GEO_COLUMNS = ["country_code", "country_name", "city", "latitude", "longitude", "asn", "as_org"]


def event_kind(event_id: Column) -> Column:
    """connect, login, command, transfer or closed; null for any other event."""
    kinds = F.create_map(*[F.lit(text) for pair in EVENT_KINDS.items() for text in pair])
    return F.try_element_at(kinds, event_id)


def event_columns(value: Callable[[str], Column], null: Callable[[str], Column] | None = None) -> list[Column]:
    """The columns of an event, with defaults for missing keys.

    ``value`` gives the column of a key.  A null in it means that the key is
    missing, unless ``null`` says that the key is there with a null value.
    """

    def missing(key: str) -> Column:
        return value(key).isNull() if null is None else value(key).isNull() & ~null(key)

    def filled_in(key: str, default: Column) -> Column:
        return F.coalesce(value(key), default if null is None else F.when(~null(key), default))

    empty = F.lit("")
    text = {
        "session_id": F.coalesce(value("session"), empty),
        "event_id": F.coalesce(value("eventid"), empty),
        "src_ip": F.coalesce(value("src_ip"), empty),
        "src_port": value("src_port").try_cast("int"),
        "dst_port": F.coalesce(
            value("dst_port").try_cast("int"), F.when(missing("dst_port"), F.lit(DEFAULT_DST_PORT))
        ),
        "protocol": filled_in("protocol", F.lit(DEFAULT_PROTOCOL)),
        "username": filled_in("username", empty),
        "password": filled_in("password", empty),
        "input": filled_in("input", empty),
        "url": filled_in("url", filled_in("destfile", empty)),
        "shasum": filled_in("shasum", empty),
        "filename": filled_in("outfile", filled_in("filename", empty)),
        "outfile": filled_in("outfile", empty),
    }
    return [column.alias(name) for name, column in text.items()]


def with_defaults(raw: DataFrame) -> DataFrame:
    """Raw event rows with defaults for missing keys; a null means that the key is missing."""

    def value(key: str) -> Column:
        return F.col(key) if key in raw.columns else F.lit(None).cast("string")

    return raw.select("id", "seq", F.col("ts").alias("timestamp"), *event_columns(value))


def drop_private(events: DataFrame) -> DataFrame:
    """Events from public, invalid or empty addresses."""
    return events.filter(~is_private(F.col("src_ip")))


def route(events: DataFrame) -> DataFrame:
    """Handled events with their ``kind``; any other event is dropped."""
    return events.withColumn("kind", event_kind(F.col("event_id"))).filter(F.col("kind").isNotNull())


def normalise(events: DataFrame, keep_private: bool = False) -> DataFrame:
    """Routing and the private-source filter."""
    handled = route(events)
    return handled if keep_private else drop_private(handled)


def transfer_text() -> Column:
    """``download: <url>``, or ``upload: <file>`` without a url."""
    return F.coalesce(
        F.concat(F.lit("download: "), filled(F.col("url"))),
        F.concat(F.lit("upload: "), F.coalesce("filename", F.lit("None"))),
    )


def _typed() -> Column:
    """The typed command, null for events of any other kind."""
    return F.when(F.col("kind") == "command", F.col("input"))


def build_attempts(events: DataFrame) -> DataFrame:
    """Login, command and transfer events as attempts, in one pass.

    Location columns are passed through when the events have them.
    """
    kind = F.col("kind")
    found = F.when(kind == "login", verdict(*LOGIN)).when(kind == "transfer", verdict(*TRANSFER))
    geo = [name for name in GEO_COLUMNS if name in events.columns]
    return (
        with_verdict(events.filter(kind.isin(*ATTEMPT_KINDS)), _typed(), "typed")
        .withColumn("found", found.otherwise(F.col("typed")))
        .select(
            "id",
            "session_id",
            "event_id",
            "timestamp",
            "src_ip",
            "src_port",
            "dst_port",
            "protocol",
            *geo,
            F.when(kind == "login", F.col("username")).alias("username"),
            F.when(kind == "login", F.col("password")).alias("password"),
            F.when(kind == "command", F.col("input"))
            .when(kind == "transfer", transfer_text())
            .alias("command"),
            (F.col("event_id") == LOGIN_SUCCESS).alias("success"),
            F.col("found.intent").alias("intent"),
            F.col("found.mitre_id").alias("mitre_id"),
        )
    )


def login_attempts(events: DataFrame) -> DataFrame:
    return build_attempts(events.filter(F.col("kind") == "login"))


def command_attempts(events: DataFrame) -> DataFrame:
    return build_attempts(events.filter(F.col("kind") == "command"))


def transfer_attempts(events: DataFrame) -> DataFrame:
    return build_attempts(events.filter(F.col("kind") == "transfer"))


def captured_files(events: DataFrame) -> DataFrame:
    """Transfers that carry a hash, keyed to their attempt."""
    return events.filter((F.col("kind") == "transfer") & (F.col("shasum") != "")).select(
        "id",
        F.col("id").alias("attempt_id"),
        "session_id",
        "timestamp",
        F.coalesce(F.substring_index("filename", "/", -1), F.lit("")).alias("filename"),
        "url",
        F.col("shasum").alias("sha256"),
        F.lit(None).cast("bigint").alias("file_size"),
        F.lit(None).cast("string").alias("file_type"),
        F.col("outfile").alias("local_path"),
        F.lit(None).cast("int").alias("vt_positives"),
        F.lit(None).cast("int").alias("vt_total"),
        F.lit(None).cast("string").alias("vt_link"),
        F.lit(None).cast("string").alias("yara_matches"),
        F.lit(None).cast("string").alias("malware_family"),
    )


def live_feed(events: DataFrame) -> DataFrame:
    """One JSON payload per located, handled event; closing events give none."""

    def payload(feed_type: str, *columns) -> Column:
        fields = [F.lit(feed_type).alias("type"), "session_id", "src_ip", *columns]
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    country = F.col("country_name").alias("country")
    position = ["latitude", "longitude"]
    success = (F.col("event_id") == LOGIN_SUCCESS).alias("success")
    kind = F.col("kind")
    text = (
        F.when(kind == "connect", payload("session_start", country, "protocol"))
        .when(kind == "login", payload("login_attempt", "username", "password", success, country, *position))
        .when(
            kind == "command",
            payload(
                "command", F.col("input").alias("command"), "found.intent", "found.mitre_id", country, *position
            ),
        )
        .when(kind == "transfer", payload("file_download", "url", F.col("shasum").alias("sha256"), country))
    )
    feed = with_verdict(events.filter(kind != "closed"), _typed())
    return feed.select("id", "timestamp", text.alias("payload"))
