"""Attacking addresses: counts, reputation and what is still unscored."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.display import SCORE_BANDS, score_band
from trapline.functions.times import clock
from trapline.operators.arguments import check_choice, check_limit

# Fixed value: how long a fetched score stays usable.
CACHE_DAYS = 7

_SCORE_COLUMNS = ["abuse_score", "isp", "usage_type", "total_reports"]


def unique_ips(attempts: DataFrame, scores: DataFrame, limit: int = 50) -> DataFrame:
    """The busiest addresses with place, last moment and cached score.

    Cut to ``limit`` rows before the lookup.  The scores are then reduced to
    those rows by a broadcast of at most ``limit`` addresses, so the score table
    is only scanned, never shuffled.
    """
    check_limit(limit, 200)
    top = (
        attempts.groupBy("src_ip")
        .agg(
            F.count("*").alias("count"),
            F.max("country_code").alias("country_code"),
            F.max("country_name").alias("country_name"),
            F.max("city").alias("city"),
            F.max("timestamp").alias("latest_timestamp"),
        )
        .orderBy(F.desc("count"), "src_ip")
        .limit(limit)
    )
    wanted = top.select(F.col("src_ip").alias("ip"))
    scored = scores.select("ip", *_SCORE_COLUMNS).join(F.broadcast(wanted), "ip", "left_semi")
    # One score per address, of several the highest: at most `limit` rows.
    found = scored.groupBy("ip").agg(F.max(F.struct(*_SCORE_COLUMNS)).alias("score")).select("ip", "score.*")
    return (
        top.join(F.broadcast(found), F.col("src_ip") == F.col("ip"), "left")
        .drop("ip")
        .orderBy(F.desc("count"), "src_ip")
    )


def ip_summary(attempts: DataFrame, scores: DataFrame, ip: str) -> DataFrame:
    """One row for one address: count 0 and nulls if it never attacked, null score columns if unscored.

    Both tables are filtered at the scan and reduced together, without a join.
    """
    places = ["country_code", "country_name", "city"]
    hits = attempts.filter(F.col("src_ip") == ip).select(
        F.lit(1).alias("hit"), *places, F.col("timestamp").alias("latest_timestamp")
    )
    score = scores.filter(F.col("ip") == ip).select(F.lit(0).alias("hit"), *_SCORE_COLUMNS)
    rows = hits.unionByName(score, allowMissingColumns=True)
    return rows.agg(
        F.lit(ip).alias("src_ip"),
        F.count_if(F.col("hit") == 1).alias("count"),
        *[F.max(name).alias(name) for name in [*places, "latest_timestamp", *_SCORE_COLUMNS]],
    )


def unscored_ips(attempts: DataFrame, scores: DataFrame) -> DataFrame:
    """Distinct addresses without any score.  Made distinct first, so the join sees each once."""
    return (
        attempts.select("src_ip")
        .distinct()
        .join(scores.select(F.col("ip").alias("src_ip")), "src_ip", "left_anti")
    )


def filter_by_band(ips: DataFrame, band: str = "all") -> DataFrame:
    """Rows of one reputation band: all, critical, high, medium, low or unknown."""
    check_choice("band", band, ["all", *[name for name, _ in SCORE_BANDS], "unknown"])
    return ips if band == "all" else ips.filter(score_band(F.col("abuse_score")) == band)


def sort_by_attacks(ips: DataFrame, most_first: bool = True) -> DataFrame:
    """Order a cut ranking by attempts, either way."""
    return ips.orderBy(F.desc("count") if most_first else F.asc("count"), "src_ip")


def missing_scores(ips: DataFrame) -> DataFrame:
    """Rows of an address ranking that have no score."""
    return ips.filter(F.col("abuse_score").isNull())


def missing_score_count(ips: DataFrame) -> DataFrame:
    return ips.agg(F.count_if(F.col("abuse_score").isNull()).alias("missing"), F.count("*").alias("total"))


def fresh_scores(scores: DataFrame, as_of: datetime | str) -> DataFrame:
    """Scores fetched less than seven days ago."""
    return scores.filter(F.col("fetched_at") > clock(as_of) - F.expr(f"INTERVAL '{CACHE_DAYS}' DAY"))


def merge_scores(current: DataFrame, updates: DataFrame) -> DataFrame:
    """One score per address: the latest fetch, an update before a current row of the same moment.

    The winner is picked by an aggregate that is combined before the shuffle, so
    an address with very many updates is no burden.
    """
    rest = [name for name in current.columns if name not in ("ip", "fetched_at")]
    rows = current.withColumn("is_update", F.lit(0)).unionByName(updates.withColumn("is_update", F.lit(1)))
    newest = F.max(F.struct("fetched_at", "is_update", *rest)).alias("newest")
    return rows.groupBy("ip").agg(newest).select(*[c if c == "ip" else F.col(f"newest.{c}") for c in current.columns])
