"""Time expressions on zone-less UTC timestamps.

Everything here is exact for any session time zone: nothing passes through the
zoned timestamp type, except where the streaming helpers say so.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feed's own format and its close relatives; Spark casts these directly.
_PLAIN = (
    r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?)?\z"
)
# Any other accepted ISO spelling: compact date or time, comma fraction, hour only.
_ZONE = r"(?<=.{11})(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)\z"
_ISO = (
    r"^\d{4}(-?)\d{2}\1\d{2}"
    r"(?:.\d{2}(?:(:?)\d{2}(?:\2\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?\z"
)
# Where the separators of the plain spelling go.
_SEPARATORS = [
    (r"^(\d{4})-?(?=\d{2})", "-"),
    (r"^(.{7})-?(?=\d{2})", "-"),
    (r"^(.{10}).(?=\d{2})", " "),
    (r"^(.{13}):?(?=\d{2})", ":"),
    (r"^(.{16}):?(?=\d{2})", ":"),
]


def clock(as_of: datetime | str | Column) -> Column:
    """A zone-less timestamp: a literal, or a column such as ``localtimestamp()`` as it is."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def parse_timestamp(text: Column) -> Column:
    """Zone-less timestamp of ISO text, null if it is not one.  An offset is dropped, not applied."""

    spelled = F.regexp_replace(text, _ZONE, "")
    for pattern, separator in _SEPARATORS:
        spelled = F.regexp_replace(spelled, pattern, "$1" + separator)
    return F.when(text.rlike(_PLAIN), text.try_cast("timestamp_ntz")).when(
        text.rlike(_ISO), F.replace(spelled, F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 as a long."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    micros = (F.date_part(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60000000 + micros


def seconds_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1000000.0)


def start_of_day(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def day_label(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 10)


def hour_label(ts: Column) -> Column:
    return F.concat(F.substring(ts.cast("string"), 1, 13), F.lit(":00"))


def utc_minus_8_midnight(ts: Column) -> Column:
    """The last midnight at fixed UTC-8, given and returned in UTC."""
    shift = F.expr("INTERVAL '8' HOUR")
    return start_of_day(ts - shift) + shift


def to_instant(ts: Column) -> Column:
    """Zoned timestamp of a UTC zone-less one; watermarks need the zoned type."""
    return F.timestamp_micros(epoch_micros(ts))


def to_utc(instant: Column) -> Column:
    """Zone-less UTC timestamp of a zoned one."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
