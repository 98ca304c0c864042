"""Display columns: labels, bands and short texts shown next to the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trapline.functions.numbers import fixed_tenth

# Lower bounds of the reputation bands, and the pin and detection limits.
SCORE_BANDS = [("critical", 75), ("high", 50), ("medium", 25), ("low", None)]
PIN_BANDS = [("red", 20), ("orange", 10), ("yellow", 5)]
DETECTION_BANDS = [("high", 0.5), ("medium", 0.2), ("low", 0.0)]
EVENT_PREFIX = "cowrie."
DASH = "—"


def filled(text: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(text, F.lit(""))


def intent_label(intent: Column) -> Column:
    """Underscores to spaces, first letter of each word upper case, the rest as it is."""
    words = F.split(intent, "_")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def score_band(score: Column) -> Column:
    """critical, high, medium or low; unknown without a score."""
    chain = F.when(score.isNull(), "unknown")
    for name, lowest in SCORE_BANDS:
        chain = chain.otherwise(name) if lowest is None else chain.when(score >= lowest, name)
    return chain


def pin_band(count: Column) -> Column:
    """Colour band of a map pin by its attempt count."""
    chain = F.when(count > PIN_BANDS[0][1], PIN_BANDS[0][0])
    for name, limit in PIN_BANDS[1:]:
        chain = chain.when(count > limit, name)
    return chain.otherwise("blue")


def detection_band(positives: Column, total: Column) -> Column:
    """Band by the share of positive verdicts; unknown without a report."""
    share = F.try_divide(positives.cast("double"), total.cast("double"))
    chain = F.when(positives.isNull() | total.isNull() | (total == 0), "unknown")
    for name, limit in DETECTION_BANDS:
        chain = chain.when(share > limit, name)
    return chain.otherwise("clean")


def byte_size(size: Column) -> Column:
    """``n B``, ``x.x KB`` or ``x.x MB``; a dash for null."""
    kib, mib = 1024, 1024 * 1024
    return (
        F.when(size.isNull(), DASH)
        .when(size < kib, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mib, F.concat(fixed_tenth(size, kib), F.lit(" KB")))
        .otherwise(F.concat(fixed_tenth(size, mib), F.lit(" MB")))
    )


def short_event(event_id: Column) -> Column:
    """The event name without its first sensor prefix."""
    at = F.locate(EVENT_PREFIX, event_id)
    return F.when(
        at > 0,
        F.concat(
            F.substring(event_id, F.lit(1), at - 1),
            F.substring(event_id, at + len(EVENT_PREFIX), F.length(event_id)),
        ),
    ).otherwise(event_id)


def place(city: Column, country_name: Column, country_code: Column) -> Column:
    return F.coalesce(filled(city), filled(country_name), filled(country_code), F.lit("?"))


def details(command: Column, username: Column, password: Column) -> Column:
    """The command, else ``user:password``, else a dash."""
    pair = F.concat(filled(username), F.lit(":"), F.coalesce(password, F.lit("null")))
    return F.coalesce(filled(command), pair, F.lit(DASH))


def pin_label(city: Column, country: Column) -> Column:
    """``city, country`` from the parts that are there."""
    return F.coalesce(filled(F.concat_ws(", ", filled(city), filled(country))), F.lit("Unknown"))


def json_list(text: Column) -> Column:
    """A JSON array of strings as a list; null, empty or malformed text gives an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
