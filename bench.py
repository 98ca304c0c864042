"""Time the headline queries and print one JSON line.

Each query is run to completion without keeping its rows: one warm-up run, then
the median of BENCH_RUNS (default 3) runs.  The stored tables that most queries
read are ingested in the warm-up; the ingest itself is timed by ``attempts_normalised``,
``json_roundtrip``, ``session_rollup`` and the streams.

The tables are first laid out in one file for each core, untimed, as a log that arrives in files
would be: a table in a single small file is read by one task, however many cores there are.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from trapline.plans.queries import QUERIES
from trapline.settings import SESSION_OPTIONS, work_folder

HEADLINE = [
    "attempts_normalised",
    "json_roundtrip",
    "log_ingest",
    "session_rollup",
    "live_feed",
    "classify_commands",
    "overview",
    "country_rankings",
    "intent_breakdown",
    "top_commands",
    "top_credentials",
    "top_ports",
    "daily_stats",
    "timeline_hour",
    "timeline_day_tz",
    "unique_ips",
    "ip_summary",
    "unscored_ips",
    "merge_scores",
    "geo_pins",
    "attempts_page",
    "attempts_filtered",
    "files_accessed",
    "malware_enriched",
    "viewer_stats",
    "private_ips",
    "purge_report",
    "stream_sessions",
    "stream_timeline",
]


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def laid_out(spark: SparkSession, folder: str, files: int) -> str:
    """The tables that headline queries read, each in several files."""
    target = work_folder(spark, "bench")
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trapline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
    )
    for name, value in SESSION_OPTIONS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    tables = laid_out(spark, folder, int(cpus))
    for name in HEADLINE:
        once = 1 if name.startswith("stream_") else repeats
        run(QUERIES[name](spark, tables))
        taken = []
        for _ in range(once):
            start = time.perf_counter()
            run(QUERIES[name](spark, tables))
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries, warm",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
