"""Named queries that write a log or tables first and then run over them.

The log is derived from the test tables and arrives in several files.  Each run
works in a fresh folder below the shared work folder and processes all that is
there, so a streaming result can be compared with the batch one.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.operators import listing
from trapline.operators.geo import enrich_geo
from trapline.operators.ingest import build_attempts, captured_files, normalise
from trapline.operators.sessions import locate_sessions
from trapline.settings import work_folder
from trapline.sources import counted, tables, telemetry, versions
from trapline.sources.loglines import parse_lines, read_log, read_log_stream
from trapline.sources.tail import open_folder, tail_log
from trapline.sources.telemetry import AS_OF
from trapline.streaming import counts, ingest, reputation, sessions

# The log arrives in so many batches, each of one file or more of about so many lines.
BATCHES = 4
FILE_LINES = 1_000_000
# Seconds between the modification times of a log file and the next.
FILE_SECONDS = 10
LATE_SECONDS = 30 * 86_400

# A page far from the newest attempts, of some kinds of events.
DEEP_PAGE, DEEP_SIZE = 20, 25
DEEP_EVENTS = ["cowrie.login.failed", "cowrie.command.input"]

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _files_per_batch(lines: DataFrame) -> int:
    return max(1, -(-lines.count() // (BATCHES * FILE_LINES)))


def _write_files(lines: DataFrame, files: int, target: str) -> None:
    lines.repartitionByRange(files, "seq").sortWithinPartitions("seq").select("line").write.mode("append").text(target)


def _ship(spark: SparkSession, target: str, seconds_ago: int) -> None:
    """Give log files the modification times of a sensor that closes one after the other, the first so long ago."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = jvm.java.lang.System.currentTimeMillis() - 1000 * seconds_ago
    names = sorted(status.getPath().getName() for status in system.listStatus(path))
    for place, name in enumerate(name for name in names if name.startswith("part-")):
        file = jvm.org.apache.hadoop.fs.Path(path, name)
        system.setTimes(file, start + 1000 * FILE_SECONDS * place, -1)


# A line's place is the number of its range times this, and its row in the range.
_RANGE = 1 << 33


def _runs(spark: SparkSession, lines: DataFrame, runs: int, files: int) -> DataFrame:
    """Lines with ``part``, from 1: runs of log order, as even as ``ntile`` makes them.

    The lines are sorted by ranges, written, and numbered by the running sum of the ranges' sizes, one row per
    range; so no task sees more than a range.
    """
    target = work_folder(spark, "ordered")
    ordered = lines.repartitionByRange(files, "seq", "line").sortWithinPartitions("seq", "line")
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    ordered.write.parquet(target)
    ordered = spark.read.schema(ordered.schema).parquet(target).withColumn("range", F.expr(f"place div {_RANGE}"))
    sizes = ordered.groupBy(F.col("range").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    least = F.floor(F.sum("size").over(Window.partitionBy()) / runs).alias("least")
    # The first runs have a line more than the others.
    longer = (F.sum("size").over(Window.partitionBy()) % runs).alias("longer")
    starts = F.broadcast(sizes.select("of", F.coalesce(before, F.lit(0)).alias("before"), least, longer))
    numbered = ordered.join(starts, F.col("range") == F.col("of")).withColumn("number", F.expr(f"before + place % {_RANGE}"))
    rest = "longer + (number - longer * (least + 1)) div greatest(least, 1)"
    part = F.expr(f"1 + CASE WHEN number < longer * (least + 1) THEN number div (least + 1) ELSE {rest} END")
    return numbered.select("seq", "line", part.cast("int").alias("part"))


def write_log(spark: SparkSession, folder: str) -> str:
    """The derived log as a folder of JSON-lines files, each a run of log order and older than the next."""
    target = work_folder(spark, "log")
    lines = telemetry.log_lines(spark, folder)
    files = BATCHES * _files_per_batch(lines)
    _write_files(lines, files, target)
    _ship(spark, target, FILE_SECONDS * files)
    return target


def finish(writer) -> None:
    """Process everything that is there, then stop."""
    running_query = writer.trigger(availableNow=True).start()
    running_query.awaitTermination()


def _log_stream(spark: SparkSession, folder: str) -> DataFrame:
    files = _files_per_batch(telemetry.log_lines(spark, folder))
    return ingest.events_of(read_log_stream(spark, write_log(spark, folder), max_files_per_trigger=files), AS_OF)


def _located_stream(spark: SparkSession, folder: str) -> DataFrame:
    return build_attempts(
        enrich_geo(_log_stream(spark, folder), telemetry.geo_ranges(spark, folder))
    )


@query
def log_read(spark, folder):
    """Every line of the written log, counted per event."""
    name = F.get_json_object("value", "$.eventid").alias("event_id")
    return read_log(spark, write_log(spark, folder)).groupBy(name).agg(F.count("*").alias("lines"))


@query
def stored_attempts(spark, folder):
    """Write attempts in date folders, then read one day and two countries back."""
    target = work_folder(spark, "store")
    tables.write_attempts(telemetry.build_table(spark, folder, "attempts"), target)
    stored = tables.load_table(spark, target, "attempts")
    one_day = stored.filter(F.col(tables.DATE_COLUMN) == F.lit("2024-01-15").cast("date")).drop(tables.DATE_COLUMN)
    return listing.filter_attempts(one_day, country=["N1", "N6"])


@query
def stored_captured(spark, folder):
    target = work_folder(spark, "store")
    tables.write_captured(telemetry.build_table(spark, folder, "captured_files"), target)
    return tables.load_table(spark, target, "captured_files").drop(tables.DATE_COLUMN)


@query
def stored_page_views(spark, folder):
    target = work_folder(spark, "store")
    tables.append_table(telemetry.build_table(spark, folder, "page_views"), target, "page_views")
    return tables.load_table(spark, target, "page_views").drop(tables.DATE_COLUMN)


@query
def stream_attempts(spark, folder):
    target = work_folder(spark, "stream")
    finish(
        ingest.store_attempts(
            _log_stream(spark, folder), telemetry.geo_ranges(spark, folder), target, f"{target}-state"
        )
    )
    return tables.load_table(spark, target, "attempts").drop("id", tables.DATE_COLUMN)


@query
def stream_captured(spark, folder):
    target = work_folder(spark, "stream")
    finish(ingest.store_captured(_log_stream(spark, folder), target, f"{target}-state"))
    files = tables.load_table(spark, target, "captured_files")
    return files.select("session_id", "timestamp", "filename", "url", "sha256", "local_path")


@query
def stream_feed(spark, folder):
    target = work_folder(spark, "feed")
    writer = ingest.feed(_log_stream(spark, folder), telemetry.geo_ranges(spark, folder), f"{target}-state")
    finish(writer.format("text").option("path", target))
    return spark.read.text(target).withColumnRenamed("value", "payload")


@query
def stream_sessions(spark, folder):
    target = work_folder(spark, "parts")
    finish(sessions.track_sessions(_log_stream(spark, folder), target, f"{target}-state"))
    return locate_sessions(sessions.tracked_sessions(spark, target), telemetry.geo_ranges(spark, folder))


@query
def stream_sessions_compacted(spark, folder):
    """The same from a state of the first three batches, merged in two turns, and the last batch."""
    target, first, second = (work_folder(spark, name) for name in ("parts", "compact", "compact"))
    finish(sessions.track_sessions(_log_stream(spark, folder), target, f"{target}-state"))
    sessions.compact_parts(spark, target, first, through=1)
    sessions.compact_parts(spark, target, second, state=first, through=2)
    return sessions.tracked_sessions(spark, target, second)


def _halves(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The log in two folders, every other line in each."""
    lines = telemetry.log_lines(spark, folder)
    files = BATCHES * _files_per_batch(lines)
    targets = tuple(work_folder(spark, "log") for _ in range(2))
    for remainder, target in enumerate(targets):
        _write_files(lines.filter(F.col("seq") % 2 == remainder), files, target)
    return targets


def _ingest(spark: SparkSession, folder: str, log: str, target: str) -> None:
    events = normalise(parse_lines(read_log(spark, log), AS_OF))
    located = enrich_geo(events, telemetry.geo_ranges(spark, folder))
    tables.write_attempts(build_attempts(located), target)
    tables.write_captured(captured_files(events), target)


def _ingest_stream(spark: SparkSession, folder: str, log: str, target: str) -> None:
    events = ingest.events_of(read_log_stream(spark, log), AS_OF)
    ranges = telemetry.geo_ranges(spark, folder)
    finish(ingest.store_attempts(events, ranges, target, f"{target}-attempts"))
    finish(ingest.store_captured(events, target, f"{target}-captured"))


def _stored_kinds(spark: SparkSession, target: str) -> DataFrame:
    """What a store holds, in the columns that its attempts and captured files have in common."""
    attempts = tables.load_table(spark, target, "attempts")
    files = tables.load_table(spark, target, "captured_files")
    return attempts.select("session_id", "timestamp", F.col("event_id").alias("detail")).unionByName(
        files.select("session_id", "timestamp", F.col("sha256").alias("detail"))
    )


@query
def log_ingest(spark, folder):
    """Backfill: log files to stored attempts and captured files, read back."""
    target = work_folder(spark, "store")
    _ingest(spark, folder, write_log(spark, folder), target)
    return tables.load_table(spark, target, "attempts").drop("id", tables.DATE_COLUMN)


@query
def store_mixed(spark, folder):
    """One half of the log by a batch job and the other by streams into one store, in either order."""
    first, second = _halves(spark, folder)
    ways = []
    for way, steps in (("batch first", (_ingest, _ingest_stream)), ("stream first", (_ingest_stream, _ingest))):
        target = work_folder(spark, "store")
        for step, log in zip(steps, (first, second)):
            step(spark, folder, log, target)
        ways.append(_stored_kinds(spark, target).withColumn("way", F.lit(way)))
    return ways[0].unionByName(ways[1])


@query
def stored_pages(spark, folder):
    """The newest and a deep page of a store of three arrivals, of which one, a plain append, was not counted."""
    target, attempts = work_folder(spark, "store"), telemetry.attempts(spark, folder)
    for remainder in (0, 1):
        counted.append_counted(attempts.filter(F.col("id") % 3 == remainder), target, gather=True)
    tables.append_table(attempts.filter(F.col("id") % 3 == 2), target, "attempts", gather=True)
    pages = [
        counted.stored_page(spark, target, page, DEEP_SIZE, event_id=DEEP_EVENTS).withColumn("page", F.lit(page))
        for page in (1, DEEP_PAGE)
    ]
    return pages[0].unionByName(pages[1])


@query
def stream_late_file(spark, folder):
    """Half of the log is shipped a month late, after a first run over the other half."""
    log, target = work_folder(spark, "log"), work_folder(spark, "store")
    lines = telemetry.log_lines(spark, folder)
    for remainder, age in ((0, 0), (1, LATE_SECONDS)):
        part = work_folder(spark, "log")
        _write_files(lines.filter(F.col("seq") % 2 == remainder), BATCHES * _files_per_batch(lines), part)
        _ship(spark, part, age)
        _move(spark, part, log)
        _ingest_stream(spark, folder, log, target)
    return _stored_kinds(spark, target)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Log files into another folder, with their modification times."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(jvm.org.apache.hadoop.fs.Path(target))
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("part-"):
            system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(target, name))


# Folders of so many batches are merged in the queries, so that all levels occur.
FAN = 2


def _tracked_attempts(spark: SparkSession, folder: str) -> str:
    """The counts of all attempts, stored batch by batch."""
    target = work_folder(spark, "counts")
    finish(counts.track_attempts(_located_stream(spark, folder), target, f"{target}-state", FAN))
    return target


@query
def stream_timeline(spark, folder):
    target = work_folder(spark, "timeline")
    finish(counts.track_timeline(_log_stream(spark, folder), target, f"{target}-state", FAN))
    return counts.running_timeline(spark, target, "hour")


@query
def stream_timeline_late(spark, folder):
    """Every other event comes a month late, in a second run, whose last batch is then stored a second time."""
    log, target = work_folder(spark, "log"), work_folder(spark, "timeline")
    lines = telemetry.log_lines(spark, folder)
    for remainder, age in ((0, 0), (1, LATE_SECONDS)):
        part = work_folder(spark, "log")
        _write_files(lines.filter(F.col("seq") % 2 == remainder), BATCHES * _files_per_batch(lines), part)
        _ship(spark, part, age)
        _move(spark, part, log)
        events = ingest.events_of(read_log_stream(spark, log, max_files_per_trigger=2 * _files_per_batch(lines)), AS_OF)
        finish(counts.track_timeline(events, target, f"{target}-state", FAN))
    _forget_last_commit(spark, f"{target}-state")
    finish(counts.track_timeline(events, target, f"{target}-state", FAN))
    return counts.running_timeline(spark, target, "day")


def _forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """As if the driver had died after the last batch was stored and before that was noted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = (status.getPath().getName() for status in system.listStatus(path))
    last = max(int(name) for name in names if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        system.delete(jvm.org.apache.hadoop.fs.Path(path, name), False)


@query
def stream_countries(spark, folder):
    return counts.running_countries(spark, _tracked_attempts(spark, folder))


@query
def stream_intents(spark, folder):
    return counts.running_intents(spark, _tracked_attempts(spark, folder))


@query
def stream_commands(spark, folder):
    return counts.running_commands(spark, _tracked_attempts(spark, folder))


@query
def stream_credentials(spark, folder):
    return counts.running_credentials(spark, _tracked_attempts(spark, folder))


@query
def stream_ports(spark, folder):
    return counts.running_ports(spark, _tracked_attempts(spark, folder), 2)


@query
def stream_overview(spark, folder):
    return counts.running_overview(spark, _tracked_attempts(spark, folder), AS_OF)


@query
def stream_daily_stats(spark, folder):
    """The daily summary kept up over four arrivals, the second half of which is late."""
    log, target = work_folder(spark, "log"), work_folder(spark, "days")
    lines = telemetry.log_lines(spark, folder)
    ranges = telemetry.geo_ranges(spark, folder)
    for remainder, age in ((0, 0), (1, LATE_SECONDS)):
        part = work_folder(spark, "log")
        _write_files(lines.filter(F.col("seq") % 2 == remainder), BATCHES * _files_per_batch(lines), part)
        _ship(spark, part, age)
        _move(spark, part, log)
        events = ingest.events_of(read_log_stream(spark, log, max_files_per_trigger=2 * _files_per_batch(lines)), AS_OF)
        finish(counts.track_days(build_attempts(enrich_geo(events, ranges)), target, f"{target}-state", FAN))
    return counts.running_days(spark, target)


@query
def upsert_scores(spark, folder):
    """Scores merged into a store of buckets: all current ones, then the updates in two batches, the first of them twice."""
    store = versions.score_store(spark, work_folder(spark, "scores"), 8)
    versions.upsert_scores(store, telemetry.ip_scores(spark, folder))
    updates = telemetry.score_updates(spark, folder)
    for remainder in (0, 0, 1):
        versions.upsert_scores(store, updates.filter(F.pmod(F.hash("ip"), F.lit(2)) == remainder))
    return store.read()


@query
def purge_stored(spark, folder):
    """Private sources purged from stored attempts and files, after a purge that died before it published the attempts."""
    target = work_folder(spark, "store")
    attempts, files = versions.attempt_store(spark, f"{target}-attempts"), versions.captured_store(spark, f"{target}-files")
    unpurged = telemetry.unpurged(spark, folder)
    for store, name in ((attempts, "attempts"), (files, "captured_files")):
        store.replace(unpurged[name], [])

    def die(manifest, version):
        raise RuntimeError("the driver died")

    dying = versions.attempt_store(spark, f"{target}-attempts")
    dying._publish = die
    try:
        versions.purge_store(dying, files)
    except RuntimeError:
        pass
    if attempts.version() != 1:
        raise AssertionError("a purge that died has published")
    versions.purge_store(attempts, files)
    kept = attempts.read().select("session_id", "timestamp", F.col("event_id").alias("detail"))
    return kept.unionByName(files.read().select("session_id", "timestamp", F.col("sha256").alias("detail")))


@query
def stream_report(spark, folder):
    """Accounting of a damaged log over four batches."""
    log, target = work_folder(spark, "log"), work_folder(spark, "report")
    damaged = telemetry.damaged_lines(spark, folder)
    files = _files_per_batch(damaged)
    damaged.select("line").repartition(BATCHES * files).write.text(log)
    lines = read_log_stream(spark, log, max_files_per_trigger=files)
    finish(counts.track_lines(lines, target, f"{target}-state", FAN))
    return counts.running_report(spark, target)


def _append(spark: SparkSession, lines: DataFrame, log: str) -> None:
    """Lines in log order at the end of one file, which is there after; files that Spark wrote are copied in chunks."""
    part = work_folder(spark, "log")
    _write_files(lines, BATCHES * _files_per_batch(lines), part)
    system, inner = open_folder(part)
    target = open_folder(log)[1]
    system.create_dir(target.rpartition("/")[0])
    listed = system.get_file_info(fs.FileSelector(inner))
    with system.open_append_stream(target) as sink:
        for info in sorted(listed, key=lambda info: info.base_name):
            if info.base_name.startswith("part-"):
                with system.open_input_stream(info.path) as source:
                    while chunk := source.read(1 << 20):
                        sink.write(chunk)


def _cut_log(spark: SparkSession, folder: str, log: str, store) -> None:
    """One file that is missing, grows, is rotated and grows, and is truncated and written anew; ``store`` runs after each step."""
    lines = telemetry.log_lines(spark, folder)
    lines = _runs(spark, lines, 5, BATCHES * _files_per_batch(lines))
    system, inner = open_folder(log)
    store()
    for part in range(1, 6):
        if part == 4:
            # The third part has not been seen when the file gets its new name.
            system.move(inner, f"{inner}.1")
        if part == 5:
            system.open_output_stream(inner).close()
        _append(spark, lines.filter(F.col("part") == part), log)
        if part != 3:
            store()


@query
def tail_growing_log(spark, folder):
    """Attempts of one log file, tailed over growth, rotation and truncation by runs of one checkpoint, with ids by position."""
    log, target = f"{work_folder(spark, 'log')}/sensor.json", work_folder(spark, "store")
    ranges = telemetry.geo_ranges(spark, folder)

    def store() -> None:
        events = ingest.events_of(tail_log(spark, log, piece_bytes=1 << 18), AS_OF)
        finish(ingest.store_attempts(events, ranges, target, f"{target}-state"))

    _cut_log(spark, folder, log, store)
    stored = tables.load_table(spark, target, "attempts").drop(tables.DATE_COLUMN)
    return stored.groupBy("src_ip", "event_id", F.col("timestamp").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_distinct("id").alias("ids")
    )


@query
def tail_repeated_lines(spark, folder):
    """Every line twice in one log file: two attempts with ids of their own, without any grouping."""
    log, target = f"{work_folder(spark, 'log')}/sensor.json", work_folder(spark, "store")
    lines = telemetry.log_lines(spark, folder)
    _append(spark, lines.unionByName(lines), log)
    events = ingest.events_of(tail_log(spark, log), AS_OF)
    finish(ingest.store_attempts(events, telemetry.geo_ranges(spark, folder), target, f"{target}-state"))
    stored = tables.load_table(spark, target, "attempts")
    return stored.groupBy("event_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("id").alias("ids"))


@query
def stream_unscored_retry(spark, folder):
    """Addresses without an answer after four batches, 45 seconds apart: they are due again after a minute though they do not attack again."""
    target = work_folder(spark, "pending")
    log = work_folder(spark, "log")
    lines = telemetry.log_lines(spark, folder)
    lines = _runs(spark, lines, BATCHES, BATCHES * _files_per_batch(lines))
    start = datetime.fromisoformat(AS_OF)
    for part in range(1, BATCHES + 1):
        _write_files(lines.filter(F.col("part") == part), _files_per_batch(lines), log)
        attempts = build_attempts(ingest.events_of(read_log_stream(spark, log), AS_OF))
        scores = telemetry.ip_scores(spark, folder).filter(F.lit(part > 2))
        finish(
            reputation.scan_pending(
                *(attempts, lambda: scores, target, f"{target}-state"),
                as_of=lambda batch_id: start + timedelta(seconds=45 * batch_id),
            )
        )
    return reputation.state_after(spark, target, BATCHES - 1).drop("asked_at")


@query
def stream_unscored(spark, folder):
    target = work_folder(spark, "unscored")
    attempts = build_attempts(_log_stream(spark, folder))
    finish(
        reputation.scan_unscored(attempts, lambda: telemetry.ip_scores(spark, folder), target, f"{target}-state")
    )
    return spark.read.parquet(target).select("src_ip").distinct()
