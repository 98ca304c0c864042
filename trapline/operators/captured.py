"""Captured files and their scan reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.display import filled

# Fixed value: where a file's report page lives.
REPORT_LINK = "https://www.virustotal.com/gui/file/"


def list_files(files: DataFrame) -> DataFrame:
    """All captured files, newest first."""
    return files.orderBy(F.desc("timestamp"), F.desc("id"))


def get_file(files: DataFrame, sha256: str) -> DataFrame:
    """The captured file with this hash and the lowest id; no row means not found."""
    return files.filter(F.col("sha256") == sha256).orderBy("id").limit(1)


def enrich_files(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Fill verdict counts, link, size and type from the report of each hash.

    Size and type are only filled where they are still empty.  A report is read
    once, before the join.  The join carries no hint: reports below the
    broadcast threshold are broadcast, a larger table is joined by a shuffle
    whose hot hashes are split at run time.
    """
    verdicts = F.from_json("last_analysis_stats", "map<string,int>")
    read = (
        reports.withColumn("verdicts", F.coalesce(verdicts, F.create_map().cast("map<string,int>")))
        .select(
            F.col("sha256").alias("_sha256"),
            F.coalesce(F.try_element_at("verdicts", F.lit("malicious")), F.lit(0)).alias("_positives"),
            F.aggregate(F.map_values("verdicts"), F.lit(0), lambda total, n: total + F.coalesce(n, F.lit(0))).alias("_total"),
            F.col("size").alias("_size"),
            F.coalesce(filled(F.col("type_description")), filled(F.col("magic")), F.lit("")).alias("_type"),
        )
        # One report per hash: the one of most engines, then of most positive verdicts.
        .groupBy("_sha256")
        .agg(F.max(F.struct("_total", "_positives", "_size", "_type")).alias("_best"))
        .select("_sha256", "_best.*")
    )
    known = F.col("_sha256").isNotNull()
    filled_in = {
        "vt_positives": F.when(known, F.col("_positives")).otherwise(F.col("vt_positives")),
        "vt_total": F.when(known, F.col("_total")).otherwise(F.col("vt_total")),
        "vt_link": F.when(known, F.concat(F.lit(REPORT_LINK), F.col("sha256"))).otherwise(F.col("vt_link")),
        "file_size": F.when(known & (F.coalesce("file_size", F.lit(0)) == 0), F.col("_size")).otherwise(
            F.col("file_size")
        ),
        "file_type": F.when(known & (F.coalesce("file_type", F.lit("")) == ""), F.col("_type")).otherwise(
            F.col("file_type")
        ),
    }
    return files.join(read, F.col("sha256") == F.col("_sha256"), "left").select(
        *[filled_in.get(name, F.col(name)).alias(name) for name in files.columns]
    )
