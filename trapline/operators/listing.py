"""Lists of attempts: filters, pages and single rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.display import filled, intent_label
from trapline.functions.times import clock
from trapline.operators.arguments import check_choice, check_limit
from trapline.operators.rankings import filter_options
from trapline.schemas import DATE_COLUMN

# Fixed value: how many transfers the transfers view shows.
TRANSFERS_SHOWN = 100

# The row number that Spark can still skip to.
MAX_OFFSET = (1 << 31) - 1


def filter_attempts(
    attempts: DataFrame,
    country: list[str] | None = None,
    intent: list[str] | None = None,
    event_id: list[str] | None = None,
    ip: str | None = None,
) -> DataFrame:
    """All given conditions together; an empty or absent one does not filter.  They reach the scan."""
    for column, values in (("country_code", country), ("intent", intent), ("event_id", event_id)):
        if values:
            attempts = attempts.filter(F.col(column).isin(*values))
    return attempts.filter(F.col("src_ip") == ip) if ip else attempts


def newest_first(attempts: DataFrame) -> DataFrame:
    return attempts.orderBy(F.desc("timestamp"), F.desc("id"))


def attempts_page(attempts: DataFrame, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    """One page of matching attempts, newest first."""
    check_limit(limit, 200)
    if page < 1:
        raise ValueError("page must be at least 1")
    if (page - 1) * limit > MAX_OFFSET:
        raise ValueError(f"pages reach up to row {MAX_OFFSET}; narrow the filters")
    return newest_first(filter_attempts(attempts, **filters)).offset((page - 1) * limit).limit(limit)


def attempts_after(attempts: DataFrame, last: tuple[datetime | str, int], limit: int = 50, **filters) -> DataFrame:
    """The page that follows the row of this timestamp and id, newest first.

    The rows before it are neither sorted nor counted, so a page costs the same at any depth; later days
    are not opened where the table shows its folder date.
    """
    check_limit(limit, 200)
    stamp = datetime.fromisoformat(str(last[0]))
    ts = F.col("timestamp")
    older = (ts < clock(stamp)) | ((ts == clock(stamp)) & (F.col("id") < last[1]))
    if DATE_COLUMN in attempts.columns:
        older &= F.col(DATE_COLUMN) <= F.lit(stamp.date())
    return newest_first(filter_attempts(attempts, **filters).filter(older)).limit(limit)


def page_info(attempts: DataFrame, page: int = 1, limit: int = 50, weight: str | None = None, **filters) -> DataFrame:
    """One row: matching attempts, page number, number of pages (at least one); a row stands for ``weight`` attempts, if given."""
    check_limit(limit, 200)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("bigint")
    return (
        filter_attempts(attempts, **filters)
        .agg((F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count("*")).alias("total"))
        .select("total", F.lit(page).cast("bigint").alias("page"), pages.alias("pages"))
    )


def recent_attempts(attempts: DataFrame, limit: int = 50) -> DataFrame:
    check_limit(limit, 200)
    return newest_first(attempts).limit(limit)


def get_attempt(attempts: DataFrame, attempt_id: int, day: date | None = None) -> DataFrame:
    """The attempt with this id; no row means not found.  With its ``day``, only that date folder is read."""
    found = attempts.filter(F.col("id") == attempt_id)
    return found if day is None else found.filter(F.col(DATE_COLUMN) == F.lit(day))


def search_options(attempts: DataFrame, kind: str, text: str) -> DataFrame:
    """Filter options that contain the text, in any case.

    Countries match by name or code, intents also by their label.
    """
    check_choice("kind", kind, ("country", "event", "intent"))
    columns = {
        "country": [F.col("name"), F.col("code")],
        "event": [F.col("value")],
        "intent": [F.col("value"), intent_label(F.col("value"))],
    }[kind]
    found = F.lit(False)
    for column in columns:
        found = found | F.contains(F.lower(column), F.lit(text.lower()))
    return filter_options(attempts, kind).filter(found)


def files_accessed(attempts: DataFrame, limit: int = TRANSFERS_SHOWN) -> DataFrame:
    """The newest transfers with the text shown for each."""
    check_limit(limit, 200)
    shown = F.coalesce(filled(F.col("command")), F.col("event_id")).alias("label")
    transfers = filter_attempts(attempts, intent=["malware_deployment"])
    return newest_first(transfers).limit(limit).select("id", shown, "timestamp", "src_ip", "country_code")


def files_accessed_total(attempts: DataFrame) -> DataFrame:
    return filter_attempts(attempts, intent=["malware_deployment"]).agg(F.count("*").alias("total"))
