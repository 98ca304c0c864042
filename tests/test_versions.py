"""Stores of replaceable pieces: what changes, what stays, what a dying job leaves."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trapline.schemas import TABLES
from trapline.sources import versions


def scores(spark, *given):
    frame = spark.createDataFrame(given, "ip string, abuse_score int, at string")
    columns = [F.lit("isp").alias("isp"), F.lit("use").alias("usage_type"), F.lit(1).alias("total_reports")]
    shown = frame.select("ip", "abuse_score", *columns, F.col("at").cast("timestamp_ntz").alias("fetched_at"))
    return shown.select(*spark.createDataFrame([], TABLES["ip_scores"]).columns)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = versions.score_store(spark, str(tmp_path / "scores"), 8)
    assert (store.version(), store.read().collect()) == (0, [])
    versions.upsert_scores(store, scores(spark, *[(f"1.2.3.{i}", i, "2024-01-01 00:00:00") for i in range(60)]))
    first = store.manifest()["pieces"]
    update = scores(spark, ("1.2.3.7", 99, "2024-01-02 00:00:00"), ("1.2.3.8", 99, "2023-01-02 00:00:00"))
    versions.upsert_scores(store, update)
    touched = set(store.pieces_of(update))
    second = store.manifest()["pieces"]
    assert len(first) == 8 and {piece for piece in first if first[piece] != second[piece]} == touched
    expected = sorted((f"1.2.3.{i}", 99 if i == 7 else i) for i in range(60))
    assert sorted(rows(store.read().select("ip", "abuse_score"))) == expected
    versions.upsert_scores(store, update)
    assert sorted(rows(store.read().select("ip", "abuse_score"))) == expected
    # An earlier version is still what it was.
    assert store.read(version=1).filter("abuse_score = 99").count() == 0
    versions.upsert_scores(store, scores(spark))
    assert store.version() == 3


def test_of_two_writers_of_one_version_one_fails(spark, tmp_path):
    store, late = (versions.score_store(spark, str(tmp_path / "scores"), 8) for _ in range(2))
    versions.upsert_scores(store, scores(spark, ("a", 1, "2024-01-01 00:00:00")))
    late.version = lambda: 0
    with pytest.raises(RuntimeError, match="another job"):
        versions.upsert_scores(late, scores(spark, ("b", 1, "2024-01-01 00:00:00")))
    assert rows(store.read().select("ip")) == [("a",)]
    with pytest.raises(ValueError, match="not to be replaced"):
        store.replace(scores(spark, ("a", 2, "2024-01-01 00:00:00")), [])


def test_a_repeated_batch_counts_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "scores")
    scores(spark, ("a", 1, "2024-01-01 00:00:00"), (None, 2, "2024-01-01 00:00:00")).write.parquet(source)
    store = versions.score_store(spark, target, 4)
    for checkpoint in ("one", "one", "two"):
        stream = spark.readStream.schema(TABLES["ip_scores"]).parquet(source)
        writer = versions.stream_scores(stream, store, f"{target}-{checkpoint}")
        writer.trigger(availableNow=True).start().awaitTermination()
    assert store.version() == 2
    assert len(store.manifest()["done"]) == 2
    assert rows(store.read().select("ip", "abuse_score")) == [("a", 1), (None, 2)]


def test_purge_rewrites_only_days_with_private_sources(spark, tmp_path):
    store = versions.attempt_store(spark, str(tmp_path / "attempts"))
    given = [(1, "10.0.0.1", "2024-01-01 10:00:00"), (2, "8.8.8.8", "2024-01-01 11:00:00"), (3, "8.8.8.8", "2024-01-02 10:00:00"), (4, "10.0.0.2", "2024-01-03 10:00:00"), (5, "10.0.0.2", None)]
    frame = spark.createDataFrame(given, "id long, src_ip string, at string").withColumn("timestamp", F.col("at").cast("timestamp_ntz"))
    empty = spark.createDataFrame([], TABLES["attempts"])
    store.replace(empty.unionByName(frame.drop("at"), allowMissingColumns=True), [])
    before = store.manifest()["pieces"]
    assert sorted(before) == ["2024-01-01", "2024-01-02", "2024-01-03", "none"]
    versions.purge_store(store)
    after = store.manifest()["pieces"]
    assert sorted(after) == ["2024-01-01", "2024-01-02"] and after["2024-01-02"] == before["2024-01-02"]
    assert rows(store.read().select("id")) == [(2,), (3,)]
    assert rows(store.read(["2024-01-02"]).select("id")) == [(3,)]
    versions.purge_store(store)
    assert store.version() == 2
