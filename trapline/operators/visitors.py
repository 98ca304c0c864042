"""Dashboard visitors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.addresses import is_valid_ip
from trapline.functions.display import filled
from trapline.functions.times import clock, utc_minus_8_midnight


def visitor_ip(x_real_ip: Column, x_forwarded_for: Column, client_host: Column) -> Column:
    """The real-address header, else the first forwarded address, else the peer; the peer if that is no address."""
    peer = F.coalesce(client_host, F.lit("unknown"))
    forwarded = F.regexp_replace(F.substring_index(x_forwarded_for, ",", 1), r"(?U)^\s+|\s+\z", "")
    candidate = F.coalesce(filled(x_real_ip), filled(forwarded), peer)
    return F.when(is_valid_ip(candidate), candidate).otherwise(peer)


def build_page_views(requests: DataFrame) -> DataFrame:
    """Page views of request records."""
    return requests.select(
        "id",
        visitor_ip(F.col("x_real_ip"), F.col("x_forwarded_for"), F.col("client_host")).alias("visitor_ip"),
        F.coalesce("user_agent", F.lit("")).alias("user_agent"),
        "visited_at",
    )


def viewer_stats(page_views: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: views, visitors, views since UTC-8 midnight, visitors of the last 24 hours.

    Reduced to one row per visitor first; the counts of visitors are then plain counts.
    """
    now = clock(as_of)
    per_visitor = page_views.groupBy("visitor_ip").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("visited_at") >= utc_minus_8_midnight(now)).alias("n_today"),
        F.max("visited_at").alias("last"),
    )
    zero = F.lit(0)
    return per_visitor.agg(
        F.coalesce(F.sum("n"), zero).cast("bigint").alias("total_views"),
        F.count("visitor_ip").alias("unique_visitors"),
        F.coalesce(F.sum("n_today"), zero).cast("bigint").alias("views_today"),
        F.count_if(F.col("last") >= now - F.expr("INTERVAL '24' HOUR")).alias("unique_last_24h"),
    )
