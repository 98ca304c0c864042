"""Overview counts and rankings of attempts.

Each ranking groups once, with counts combined before the shuffle, and takes
its top rows without a full sort.  Ties are broken by the key, ascending.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trapline.functions.classify import intent_dim
from trapline.functions.display import filled
from trapline.functions.numbers import percent
from trapline.functions.times import clock
from trapline.operators.arguments import check_choice, check_limit


def attack_day() -> Column:
    """The UTC-8 day of an attempt."""
    return (F.col("timestamp") - F.expr("INTERVAL '8' HOUR")).cast("date")


def address_days(attempts: DataFrame) -> DataFrame:
    """Attempts per address, country and UTC-8 day: the short list the overview is made of."""
    return attempts.groupBy("src_ip", "country_code", attack_day().alias("day")).agg(F.count("*").alias("n"))


def overview_of(counted: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """The overview row of ``address_days``."""
    today = (clock(as_of) - F.expr("INTERVAL '8' HOUR")).cast("date")
    zero = F.lit(0)
    return counted.agg(
        F.coalesce(F.sum("n"), zero).cast("bigint").alias("total_attempts"),
        F.count_distinct("src_ip").alias("unique_ips"),
        F.count_distinct("country_code").alias("unique_countries"),
        F.coalesce(F.sum(F.when(F.col("day") >= today, F.col("n"))), zero).cast("bigint").alias("attacks_today"),
        zero.cast("bigint").alias("active_sessions"),
    )


def overview(attempts: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """One row: attempts, addresses, countries, attempts since UTC-8 midnight.

    The empty country of unlocated addresses counts as a country.  The attempts
    are first reduced to a short list, combined before the shuffle, so the two
    distinct counts never see single attempts.
    """
    return overview_of(address_days(attempts), as_of)


def _with_total(grouped: DataFrame) -> DataFrame:
    """Add the sum of all counts to every group.  For groupings with a few hundred groups at most."""
    return grouped.withColumn("total", F.sum("count").over(W.partitionBy()))


def country_rankings(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """Countries by attempts, with their share of all attempts."""
    return countries_of(attempts.groupBy("country_code", "country_name").agg(F.count("*").alias("count")), limit)


def countries_of(counted: DataFrame, limit: int = 20) -> DataFrame:
    """The ranking of (country_code, country_name, count)."""
    check_limit(limit, 100)
    return (
        _with_total(counted)
        .filter(F.col("country_code").isNotNull())
        .orderBy(F.desc("count"), "country_code", "country_name")
        .limit(limit)
        .select(
            "country_code",
            F.coalesce(filled(F.col("country_name")), F.col("country_code")).alias("country_name"),
            "count",
            percent(F.col("count"), F.col("total")).alias("percentage"),
        )
    )


def intent_breakdown(attempts: DataFrame) -> DataFrame:
    """Attempts per intent, with share, technique and description; unknown intents have neither."""
    return intents_of(attempts.groupBy("intent").agg(F.count("*").alias("count")))


def intents_of(counted: DataFrame) -> DataFrame:
    """The breakdown of (intent, count)."""
    dim = F.broadcast(intent_dim(counted.sparkSession))  # ten rows
    return (
        _with_total(counted)
        .filter(F.col("intent").isNotNull())
        .join(dim, "intent", "left")
        .select(
            "intent",
            "count",
            percent(F.col("count"), F.col("total")).alias("percentage"),
            "mitre_id",
            "description",
        )
        .orderBy(F.desc("count"), "intent")
    )


def top_commands(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """Non-empty commands by use.  A text with several intents shows the smallest."""
    typed = attempts.filter(F.col("command") != "").groupBy("command")
    return commands_of(typed.agg(F.count("*").alias("count"), F.min("intent").alias("intent")), limit)


def commands_of(counted: DataFrame, limit: int = 20) -> DataFrame:
    """The ranking of (command, count, intent)."""
    check_limit(limit, 100)
    return counted.orderBy(F.desc("count"), "command").limit(limit)


def top_credentials(attempts: DataFrame, limit: int = 20) -> DataFrame:
    """Username and password pairs by use; nulls are grouped first and shown as empty after."""
    named = attempts.filter(F.col("username").isNotNull()).groupBy("username", "password")
    return credentials_of(named.agg(F.count("*").alias("count")), limit)


def credentials_of(counted: DataFrame, limit: int = 20) -> DataFrame:
    """The ranking of (username, password, count)."""
    check_limit(limit, 100)
    return (
        counted.orderBy(F.desc("count"), "username", F.asc_nulls_first("password"))
        .limit(limit)
        .select("username", F.coalesce("password", F.lit("")).alias("password"), "count")
    )


def top_ports(attempts: DataFrame, limit: int = 10) -> DataFrame:
    """Target ports by attempts; the share is of the returned rows only."""
    aimed = attempts.filter(F.col("dst_port").isNotNull()).groupBy("dst_port")
    return ports_of(aimed.agg(F.count("*").alias("count")), limit)


def ports_of(counted: DataFrame, limit: int = 10) -> DataFrame:
    """The ranking of (dst_port, count)."""
    check_limit(limit, 50)
    top = counted.orderBy(F.desc("count"), "dst_port").limit(limit)
    return _with_total(top).select(
        F.col("dst_port").alias("port"), "count", percent(F.col("count"), F.col("total")).alias("percentage")
    )


def with_rank(ranking: DataFrame, *order: Column) -> DataFrame:
    """Add the 1-based position.  For rankings that are already cut to their top rows."""
    return ranking.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def with_share_of_leader(ranking: DataFrame) -> DataFrame:
    """Add each count as a percentage of the first.  For rankings cut to their top rows."""
    leader = F.max("count").over(W.partitionBy())
    return ranking.withColumn("share", F.col("count").cast("double") / leader.cast("double") * F.lit(100.0))


def filter_options(attempts: DataFrame, kind: str) -> DataFrame:
    """The values a filter can take: ``country``, ``event`` or ``intent``."""
    check_choice("kind", kind, ("country", "event", "intent"))
    if kind == "country":
        return (
            attempts.filter(F.col("country_code") != "")
            .select(F.col("country_code").alias("code"), F.col("country_name").alias("name"))
            .distinct()
            .orderBy("name", "code")
        )
    column = {"event": "event_id", "intent": "intent"}[kind]
    usable = F.col(column).isNotNull() if kind == "event" else F.col(column) != ""
    return attempts.filter(usable).select(F.col(column).alias("value")).distinct().orderBy("value")
