"""Pages of counted stores: the folders they open, uncounted arrivals, repeated batches."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trapline.operators import listing
from trapline.schemas import TABLES
from trapline.sources import counted, tables


def attempts(spark, first, last, days=10, intent="probe"):
    """Attempts with these ids, one an hour, over so many days."""
    empty = spark.createDataFrame([], TABLES["attempts"])
    given = {
        "id": F.col("id"),
        "timestamp": F.expr(f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id % {24 * days}))"),
        "intent": F.lit(intent),
        "country_code": F.when(F.col("id") % 2 == 0, "NL"),
        "event_id": F.lit("e"),
    }
    cast = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema]
    return spark.range(first, last).select(*cast)


def opened(frame):
    """The date folders of the files that a plan reads."""
    return sorted({name.split("event_date=")[1][:10] for name in frame.inputFiles()})


def test_pages_open_only_their_folders(spark, tmp_path):
    store = str(tmp_path)
    counted.append_counted(attempts(spark, 0, 240), store, gather=True)
    everything = tables.load_table(spark, store, "attempts").drop("event_date")
    for page, days in ((1, ["2024-01-10"]), (3, ["2024-01-08", "2024-01-09"]), (15, ["2024-01-01"])):
        shown = counted.stored_page(spark, store, page, 17)
        assert rows(shown) == rows(listing.attempts_page(everything, page, 17))
        plan = shown._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan
        span = counted.span_of(counted.folder_counts(spark, store), (page - 1) * 17, 17)
        assert [str(span.oldest), str(span.newest)] == [days[0], days[-1]]
        assert opened(tables.load_table(spark, store, "attempts").filter(span.condition()))
    assert counted.stored_page(spark, store, 16, 17).collect() == []
    half = counted.stored_page(spark, store, 2, 50, country=["NL"])
    assert rows(half) == rows(listing.attempts_page(everything, 2, 50, country=["NL"]))
    for filters in ({}, {"country": ["NL"]}, {"intent": ["none"]}):
        info = rows(counted.stored_page_info(spark, store, 2, 50, **filters))
        assert info == rows(listing.page_info(everything, 2, 50, **filters))
    with pytest.raises(ValueError):
        counted.stored_page(spark, store, 0)


def test_uncounted_and_undated_rows_are_on_their_pages(spark, tmp_path):
    store = str(tmp_path)
    counted.append_counted(attempts(spark, 0, 100, 3), store)
    tables.append_table(attempts(spark, 100, 150, 5, "malware_deployment"), store, "attempts")
    # A writer that died before it counted, of rows without time.
    undated = attempts(spark, 150, 160).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    tables.write_arrival(undated, store, "attempts", "batch-died", "overwrite")
    everything = tables.load_table(spark, store, "attempts").drop("event_date")
    for page in range(1, 8):
        shown = counted.stored_page(spark, store, page, 30)
        assert rows(shown) == rows(listing.attempts_page(everything, page, 30)), page
    assert rows(counted.stored_transfers(spark, store, 20)) == rows(listing.files_accessed(everything, 20))
    assert counted.folder_counts(spark, store).agg(F.sum("n")).first()[0] == 160


def test_repeated_batches_count_once(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / name) for name in ("source", "store", "checkpoint"))
    attempts(spark, 0, 80).repartition(4).write.parquet(source)

    def run():
        stream = spark.readStream.schema(TABLES["attempts"]).option("maxFilesPerTrigger", 1).parquet(source)
        counted.stream_counted(stream, store, checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    for name in ("3", ".3.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    run()
    counts = counted.folder_counts(spark, store)
    assert counts.agg(F.sum("n")).first()[0] == 80 == tables.load_table(spark, store, "attempts").count()
    assert len(counts.inputFiles()) >= 4


def test_an_empty_store_has_no_page(spark, tmp_path):
    store = str(tmp_path)
    counted.append_counted(attempts(spark, 0, 0), store)
    assert counted.stored_page(spark, store).collect() == []
    assert rows(counted.stored_page_info(spark, store)) == [(0, 1, 1)]
