"""Operators on edge rows, skewed rows and brute force."""

import contextlib
import io
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trapline.operators import addresses, captured, geo, ingest, listing, maintain, rankings, sessions, timeline
from trapline.operators.visitors import build_page_views
from trapline.schemas import ATTEMPTS, CAPTURED_FILES, GEO_RANGES, IP_SCORES
from trapline.settings import work_folder
from trapline.sources import loglines, tables
from trapline.streaming import sessions as tracked

AS_OF = "2024-01-31 00:00:00"


def _events(spark, data):
    """(seq, session, kind) triples as normalised events."""
    start = datetime(2024, 1, 1)
    listed = [(n, n, s, k, start + timedelta(seconds=n), "8.8.8.8", "ssh") for n, s, k in data]
    schema = "id long, seq long, session_id string, kind string, timestamp timestamp_ntz, src_ip string, protocol string"
    return spark.createDataFrame(listed, schema)


def _sessions_by_hand(data):
    found = {}
    for n, s, k in data:
        if k == "connect":
            found.setdefault(s, [n, 0, 0, 0, None])
        elif s in found:
            if k == "closed":
                found[s][4] = n
            else:
                found[s][{"login": 1, "command": 2, "transfer": 3}[k]] += 1
    return sorted(
        (s, logins, commands, files, None if end is None else float(end - n))
        for s, (n, logins, commands, files, end) in found.items()
    )


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
def test_sessions_by_brute_force(spark, width):
    """One session holds a third of all events; slices of any width give the same."""
    rng = random.Random(width)
    kinds = ["connect", "login", "command", "transfer", "closed"]
    data = [
        (n, "hot" if rng.random() < 0.33 else f"s{rng.randrange(60)}", rng.choices(kinds, [1, 6, 6, 3, 1])[0])
        for n in range(3000)
    ]
    frame = _events(spark, data)
    columns = ["session_id", "login_attempts", "commands_run", "files_downloaded", "duration_secs"]
    expected = _sessions_by_hand(data)
    assert rows(sessions.build_sessions(frame, slice_width=width).select(*columns)) == sorted(
        expected, key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    # The same from parts of several batches, some of them merged beforehand.
    batches = [frame.filter(F.col("id").between(k * 1000, k * 1000 + 999)) for k in range(3)]
    parts = [sessions.session_parts(batch, width, k) for k, batch in enumerate(batches)]
    mixed = sessions.merge_parts(parts[0].unionByName(parts[1])).unionByName(parts[2])
    assert rows(sessions.combine_parts(mixed).select(*columns)) == sorted(
        expected, key=lambda r: tuple((v is None, str(v)) for v in r)
    )


@pytest.mark.parametrize("seed", range(3))
def test_sessions_of_late_events_and_compaction(spark, seed):
    """Batches out of log order, merged between any two batches, count as the events arrived."""
    rng = random.Random(seed)
    kinds = ["connect", "login", "command", "transfer", "closed"]
    data = [(n, f"s{rng.randrange(40)}", rng.choices(kinds, [1, 6, 6, 3, 1])[0]) for n in range(400)]
    batch_of = [rng.randrange(5) for _ in data]
    arrived = sorted(range(len(data)), key=lambda n: (batch_of[n], n))
    columns = ["session_id", "login_attempts", "commands_run", "files_downloaded", "duration_secs"]
    expected = sorted(
        _sessions_by_hand([data[n] for n in arrived]), key=lambda r: tuple((v is None, str(v)) for v in r)
    )
    target = work_folder(spark, "parts")
    for k in range(5):
        batch = _events(spark, [row for row, b in zip(data, batch_of) if b == k])
        sessions.session_parts(batch, 7, k).drop("batch").write.parquet(f"{target}/batch={k}")
    state = None
    for through in (1, 3):
        into = work_folder(spark, "state")
        tracked.compact_parts(spark, target, into, state, through)
        state = into
        assert rows(tracked.tracked_sessions(spark, target, state).select(*columns)) == expected
    assert rows(tracked.tracked_sessions(spark, target).select(*columns)) == expected
    with pytest.raises(ValueError, match="up to 3"):
        tracked.stored_parts(spark, target, state, through=2)


LINES = [
    '{"eventid":"cowrie.login.success","session":"a","src_ip":"8.8.8.8","timestamp":"2024-01-15T08:00:00Z","username":"root"}',
    '{"eventid":"cowrie.login.failed","session":"a","src_ip":"8.8.8.8","timestamp":"nonsense","username":null,"dst_port":null}',
    '{"eventid":"cowrie.command.input","session":"a","src_ip":"bad ip","timestamp":"2024-01-15T08:00:01Z","input":null}',
    '{"eventid":"cowrie.session.file_upload","session":"a","src_ip":"","timestamp":"2024-01-15T08:00:02Z","outfile":null}',
    '{"eventid":"cowrie.session.file_download","session":"a","src_ip":"8.8.8.8","destfile":"d","shasum":"h","filename":"x/y/z"}',
    '{"eventid":"cowrie.session.file_download","session":"a","src_ip":"8.8.8.8","url":null,"destfile":"d","shasum":"","outfile":"o"}',
    '{"eventid":"cowrie.login.failed","session":"a","src_ip":"10.0.0.1","timestamp":"2024-01-15T08:00:00Z"}',
    '{"eventid":"cowrie.client.version","session":"a","src_ip":"8.8.8.8","timestamp":"2024-01-15T08:00:00Z"}',
    '{"eventid":"cowrie.session.connect","session":"a","session":"b","src_ip":"8.8.8.8","timestamp":"2024-01-15T08:00:00Z"}',
    "",
    " \t ",
    '\xa0{"eventid":"cowrie.login.failed","session":"c","src_ip":"8.8.8.8","timestamp":"2024-01-15T08:00:00Z"}\r',
    '{"eventid":"cowrie.login.failed","session":"a","src_ip":"8.8.8.8","timestamp":null}',
    '{"eventid":"cowrie.login.failed","session":"a","src_ip":null,"timestamp":"2024-01-15T08:00:00Z"}',
    '{"eventid":"cowrie.login.failed","session":null,"src_ip":"8.8.8.8","timestamp":"2024-01-15T08:00:00Z"}',
    '{"eventid":"cowrie.session.closed","session":null,"src_ip":"8.8.8.8","timestamp":"2024-01-15T08:00:00Z"}',
    '{"eventid":"x"} {"eventid":"y"}',
    '{"eventid":"x"},{"eventid":"y"}',
    "[1, 2]", "3", '"text"', "null", "{", "{'eventid':'x'}",
]


def _lines(spark):
    return spark.createDataFrame([(line, "f") for line in LINES], "value string, file string")


def test_ingest_report(spark):
    # Blank: 2.  Malformed or no object: 8.  Failed: 3.
    assert tuple(loglines.ingest_report(_lines(spark)).first()) == (22, 11, 11)


def test_line_edges(spark):
    events = ingest.normalise(loglines.parse_lines(_lines(spark), AS_OF))
    attempts = {(r.session_id, r.command, r.username) for r in ingest.build_attempts(events).collect()}
    assert attempts == {
        ("a", None, "root"),
        ("a", None, None),
        ("c", None, ""),
        ("a", "upload: None", None),
        ("a", "download: d", None),
        ("a", "upload: o", None),
    } | {("a", None, None)}
    by_stamp = {r.username: r for r in ingest.login_attempts(events).collect()}
    assert by_stamp["root"].dst_port == 22 and by_stamp["root"].password == "" and by_stamp["root"].success
    assert by_stamp[None].dst_port is None and str(by_stamp[None].timestamp) == AS_OF
    assert [r.session_id for r in events.filter("kind = 'connect'").collect()] == ["b"]
    files = ingest.captured_files(events).collect()
    assert [(f.filename, f.url, f.sha256, f.local_path) for f in files] == [("z", "d", "h", "")]


RANGES = [
    (16909056, 16909311, "AA", "Aland", "", "Sub", 1.0, 2.0, 7, "Org"),
    (16909312, 33554431, "BB", "", None, None, None, None, None, None),
]


@pytest.mark.parametrize("bits, spread, threshold", [(16, 1, "64MB"), (8, 1, "-1"), (16, 5, "-1")])
def test_geo_lookup(spark, bits, spread, threshold):
    """Broadcast, shuffled and spread lookups agree, and misses give empty text."""
    ips = ["1.2.3.0", "1.2.3.255", "1.2.4.0", "1.255.255.255", "2.0.0.0", "1.2.2.255", "10.1.1.1", "::1", "x", ""]
    events = spark.createDataFrame([(n, ip) for n, ip in enumerate(ips * 50)], "id long, src_ip string")
    ranges = spark.createDataFrame(RANGES, GEO_RANGES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = geo.enrich_geo(events, ranges, bits, spread).groupBy("src_ip", "country_code", "city", "latitude", "asn").count()
        got = {r.src_ip: (r.country_code, r.city, r.latitude, r.asn, r["count"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
    known, other, miss = ("AA", "Sub", 1.0, 7, 50), ("BB", "", 0.0, None, 50), ("", "", 0.0, None, 50)
    assert got == dict(zip(ips, [known, known, other, other, miss, miss, miss, miss, miss, miss]))


def _attempts(spark, data):
    schema = "id long, timestamp timestamp_ntz, src_ip string, country_code string, country_name string, city string, latitude double, longitude double, event_id string"
    return spark.createDataFrame(data, schema)


def test_pins_keep_ties(spark):
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    data = [
        (1, t1, "a", "X", "x", "", 1.0, 1.0, "e1"),
        (2, t2, "a", "X", "x", "", 1.0, 1.0, "e2"),
        (3, t2, "a", "X", "x", "", None, None, "e3"),
        (4, t1, "b", "Y", "y", "", 2.0, 2.0, "e4"),
        (5, t2, "c", "Z", "z", "", None, None, "e5"),
    ]
    pins = geo.geo_pins(_attempts(spark, data)).collect()
    assert [(p.latest_src_ip, p.id, p["count"]) for p in pins] == [("a", 2, 2), ("a", 3, 2), ("b", 4, 1)]
    single = geo.geo_pins(_attempts(spark, data), dedupe=True).collect()
    assert [(p.latest_src_ip, p.id) for p in single] == [("a", 3), ("b", 4)]


def test_empty_tables(spark):
    attempts = spark.createDataFrame([], ATTEMPTS)
    scores = spark.createDataFrame([], IP_SCORES)
    assert tuple(rankings.overview(attempts, AS_OF).first()) == (0, 0, 0, 0, 0)
    assert rankings.country_rankings(attempts).count() == 0
    assert rankings.top_ports(attempts).count() == 0
    assert {r["count"] for r in timeline.timeline(attempts, AS_OF, "day", 2).collect()} == {0}
    assert tuple(listing.page_info(attempts).first()) == (0, 1, 1)
    assert addresses.ip_summary(attempts, scores, "1.1.1.1").first()["count"] == 0
    assert maintain.private_ips(attempts, attempts).count() == 0


def test_argument_bounds(spark):
    attempts = spark.createDataFrame([], ATTEMPTS)
    for call in (
        lambda: rankings.country_rankings(attempts, 101),
        lambda: rankings.top_ports(attempts, 0),
        lambda: geo.geo_pins(attempts, 2001),
        lambda: timeline.timeline(attempts, AS_OF, "week"),
        lambda: timeline.timeline(attempts, AS_OF, "day", 0.05),
        lambda: timeline.timeline(attempts, AS_OF, "day", 1, 841),
        lambda: listing.attempts_page(attempts, 0),
    ):
        with pytest.raises(ValueError):
            call()


def test_merge_prefers_latest_then_update(spark):
    day = datetime(2024, 1, 1)
    current = spark.createDataFrame([("a", 1, "", "", 0, day), ("b", 2, "", "", 0, day)], IP_SCORES)
    updates = spark.createDataFrame(
        [("a", 9, "", "", 0, day), ("b", 8, "", "", 0, day - timedelta(1)), ("c", 7, "", "", 0, day)], IP_SCORES
    )
    merged = addresses.merge_scores(current, updates)
    assert [(r.ip, r.abuse_score) for r in merged.orderBy("ip").collect()] == [("a", 9), ("b", 2), ("c", 7)]


def test_visitor_address(spark):
    data = [
        (1, "1.1.1.1", "2.2.2.2", "3.3.3.3", "x", None),
        (2, "", " 2.2.2.2 , 9.9.9.9", "3.3.3.3", None, None),
        (3, None, None, "3.3.3.3", "x", None),
        (4, "junk", "2.2.2.2", "3.3.3.3", "x", None),
        (5, "junk", None, None, "x", None),
        (6, "2001:db8::1", None, None, "x", None),
        (7, None, None, "testclient", "x", None),
    ]
    schema = "id long, x_real_ip string, x_forwarded_for string, client_host string, user_agent string, visited_at timestamp_ntz"
    views = build_page_views(spark.createDataFrame(data, schema)).orderBy("id").collect()
    assert [v.visitor_ip for v in views] == [
        "1.1.1.1", "2.2.2.2", "3.3.3.3", "3.3.3.3", "unknown", "2001:db8::1", "testclient",
    ]
    assert views[1].user_agent == ""


def test_report_fills_only_empty(spark):
    files = spark.createDataFrame([(1, "h", 5, "elf"), (2, "h", 0, ""), (3, "none", None, None)], "id long, sha256 string, file_size long, file_type string")
    files = files.selectExpr("*", "cast(null as int) vt_positives", "cast(null as int) vt_total", "cast(null as string) vt_link")
    reports = spark.createDataFrame([("h", '{"undetected": 4}', 9, "", "magic")], "sha256 string, last_analysis_stats string, size long, type_description string, magic string")
    got = captured.enrich_files(files, reports).orderBy("id").select("file_size", "file_type", "vt_positives", "vt_total").collect()
    assert [tuple(r) for r in got] == [(5, "elf", 0, 4), (9, "magic", 0, 4), (None, None, None, None)]


def _plan(frame):
    with contextlib.redirect_stdout(io.StringIO()) as printed:
        frame.explain()
    return printed.getvalue()


def test_stored_table_prunes(spark):
    """Filters reach the files, dates skip folders, and only the used columns are read."""
    target = work_folder(spark, "prune")
    attempts = spark.createDataFrame([], ATTEMPTS).unionByName(
        spark.range(10).select(
            "id", F.expr("timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(id)").alias("timestamp"), F.lit("N1").alias("country_code")
        ),
        allowMissingColumns=True,
    )
    tables.write_attempts(attempts, target)
    stored = tables.load_table(spark, target, "attempts")
    frame = listing.filter_attempts(stored.filter("event_date = date'2024-01-17'"), country=["N1"]).select("id")
    plan = _plan(frame)
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(country_code,N1)" in plan
    assert "ReadSchema: struct<id:bigint,country_code:string>" in plan
    assert frame.count() == 1
    hours = timeline.timeline(stored, "2024-01-18 12:00:00", "hour", 1)
    assert "PartitionFilters: [isnotnull(event_date" in _plan(hours)
    assert sum(row["count"] for row in hours.collect()) == 1
    # Pages by the last row seen are those by number.
    shown = [row.id for row in listing.newest_first(stored).collect()]
    last, paged = ("9999-12-31 00:00:00", 0), []
    while page := listing.attempts_after(stored, last, limit=3).collect():
        paged += [row.id for row in page]
        last = (page[-1].timestamp, page[-1].id)
    assert paged == shown and len(shown) == 10
    older = listing.attempts_after(stored, ("2024-01-17 00:00:00", 2), limit=3)
    assert "PartitionFilters: [isnotnull(event_date" in _plan(older)
    one = listing.get_attempt(stored, 2, datetime(2024, 1, 17).date())
    assert one.count() == 1 and "PartitionFilters: [isnotnull(event_date" in _plan(one)


@pytest.mark.parametrize("stream_first", [False, True])
def test_batch_and_stream_fill_one_table(spark, stream_first):
    """No row is hidden, whoever writes first, and a repeated batch replaces its own rows only."""
    target, log = work_folder(spark, "mixed"), work_folder(spark, "in")
    files = spark.createDataFrame([], CAPTURED_FILES).unionByName(
        spark.range(3).select("id", F.expr("timestamp_ntz'2024-01-15 00:00:00'").alias("timestamp")), allowMissingColumns=True
    )
    files.write.parquet(log)

    def stream(checkpoint):
        reader = spark.readStream.schema(files.schema).parquet(log)
        writer = tables.stream_table(reader, target, "captured_files", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    checkpoint = work_folder(spark, "checkpoint")
    steps = [lambda: stream(checkpoint), lambda: tables.write_captured(files, target)]
    for step in steps if stream_first else reversed(steps):
        step()
    assert tables.load_table(spark, target, "captured_files").count() == 6
    tables.write_captured(files, target)
    stream(checkpoint)  # nothing new
    assert tables.load_table(spark, target, "captured_files").count() == 9
    stream(work_folder(spark, "checkpoint"))
    assert tables.load_table(spark, target, "captured_files").count() == 12


def test_a_line_of_many_copies(spark):
    """More copies than a piece holds are expanded in pieces, with ids of their own."""
    events = spark.createDataFrame([(1, 250_001), (2, 1), (3, 2)], "id long, copies long")
    found = loglines.number_copies(events)
    assert tuple(found.agg(F.count("*"), F.countDistinct("id")).first()) == (250_004, 250_004)
    assert {row.id for row in found.filter("copy = 1").collect()} == {1, 2, 3}


def test_repeated_reports_and_scores_do_not_multiply_rows(spark):
    files = spark.createDataFrame(
        [(1, "h", None, None, None, None, None)],
        "id long, sha256 string, vt_positives int, vt_total int, vt_link string, file_size long, file_type string",
    )
    reports = spark.createDataFrame(
        [("h", '{"malicious": 1, "undetected": 4}', 10, "a", "x"), ("h", '{"malicious": 2, "undetected": 9}', 20, "b", "y")],
        "sha256 string, last_analysis_stats string, size long, type_description string, magic string",
    )
    found = captured.enrich_files(files, reports).collect()
    assert [(row.vt_positives, row.vt_total, row.file_size, row.file_type) for row in found] == [(2, 11, 20, "b")]


def test_a_page_beyond_what_spark_can_skip_is_refused(spark):
    with pytest.raises(ValueError, match="pages reach"):
        listing.attempts_page(spark.range(1), page=100_000_000, limit=200)
