"""Exact duplicates by heavy-hitter split: frequent digests are settled on the map side, the others by a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import written

# At most so many digests are broadcast, some 100 bytes each.
HEAVY = 1_000
# Counters that the frequent-items sketch keeps while it scans.
TRACKED = 16_384


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the UTF-8 text as lowercase hex; null text counts as empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest")
    )


def frequent_digests(digests: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """(digest): at most ``heavy`` digests that may be frequent.

    ``approx_top_k`` is a mergeable Misra-Gries summary: a digest that it leaves
    out occurs in no more than about the larger of 1/``heavy`` and 4/``tracked`` of all rows.
    """
    top = digests.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("entry")).filter("entry.count > 1").select("entry.item").toDF("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  Cases: a null text counts
    as empty, and empty texts are copies of each other; rows that share id and
    text are one document, so each of them counts in ``group_size`` and has the
    same verdict; a null id stays only where no row of its text has an id; an
    empty table gives no rows.  Other columns of ``docs`` are not read.

    Digests are computed once and written.  The counts and winners of frequent
    digests are exact (an aggregate over their rows, combined before the
    shuffle), then broadcast: their rows never meet in one task.
    """
    digests = written(text_digests(docs, id_col, text_col), "exact-digests")
    frequent = written(frequent_digests(digests, heavy), "exact-frequent")
    summary = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*summary)
    marked = digests.join(F.broadcast(written(winners, "exact-winners")), "digest", "left")
    settled = marked.filter(F.col("group_size").isNotNull())
    rest = marked.filter(F.col("group_size").isNull()).select("digest", "doc_id")
    others = rest.join(rest.groupBy("digest").agg(*summary), "digest").select(settled.columns)
    return settled.unionByName(others).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
