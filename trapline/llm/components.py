"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import written

# Rounds grow with the logarithm of the longest path; this many do for any real graph.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b: long).

    Alternates two steps until nothing changes: every node hangs its larger
    neighbours below its smallest one, then every node hangs its smaller ones
    and itself below the smallest.  Each step is a minimum by node, combined before the shuffle, and
    a join, whose hot nodes are split at run time; no neighbourhood is
    collected.  Each round is written, so it can be repeated from disk.
    """
    edges, signature = _ordered(links), None
    for _ in range(MAX_ROUNDS):
        edges = written(_small_star(_large_star(edges)), "component-round")
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("high", "low").cast("long")).alias("h")).first()
        if (seen.n, seen.h) == signature:
            return _labels(edges)
        signature = (seen.n, seen.h)
    raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")


def contracted(links: DataFrame, rounds: int = 1) -> DataFrame:
    """Links (a, b) that connect the same nodes, after a few rounds: nearly one for each node, to the smallest of its group.

    One round is nearly complete for links that form stars, two for groups whose members have many links.
    """
    edges = _ordered(links)
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)), "component-round")
    return edges.select(F.col("high").alias("a"), F.col("low").alias("b"))


def partial_labels(links: DataFrame) -> DataFrame:
    """(node, component) of contracted links: equal labels are connected, connected nodes may still have different ones.

    Enough where labels only save work.
    """
    return _labels(links.select(F.col("a").alias("high"), F.col("b").alias("low")))


def _labels(edges: DataFrame) -> DataFrame:
    below = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))
    tops = edges.select(F.col("low").alias("node")).distinct().join(below, "node", "left_anti")
    return below.unionByName(tops.withColumn("component", F.col("node")))


def _ordered(links: DataFrame) -> DataFrame:
    high, low = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    return links.filter("a != b").select(high, low).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours, linked to the smallest of its neighbours and itself."""
    smallest = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    # A node without a smaller neighbour is itself the smallest.
    hung = edges.join(smallest, edges.low == smallest.node, "left")
    return hung.select("high", F.coalesce("least", "low").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself, linked to the smallest of them."""
    smallest = edges.groupBy("high").agg(F.min("low").alias("least"))
    hung = edges.join(smallest, "high")
    below = hung.filter("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return below.unionByName(smallest.select("high", F.col("least").alias("low"))).distinct()
