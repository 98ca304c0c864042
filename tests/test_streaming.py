"""The tailing source, the store of counts and the work list, step by step."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trapline.plans import streams
from trapline.sources import tail
from trapline.streaming import counts, reputation


def pieces_of(reader, start, end):
    found = []
    for piece in reader.partitions(start, end):
        for batch in reader.read(piece):
            found += zip(*(column.to_pylist() for column in batch.columns))
    return found


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_pieces_hold_each_line_once(tmp_path, most):
    log = tmp_path / "sensor.json"
    lines = ["first", "", "x" * 40, "é日本", "a\rb", "last"]
    log.write_text("\n".join(lines) + "\nunfinished", encoding="utf-8")
    reader = tail.TailReader(str(log), "start", most)
    end = reader.latestOffset()
    found = sorted(pieces_of(reader, {}, end), key=lambda row: row[2])
    assert [row[0] for row in found] == lines
    data = log.read_bytes()
    assert all(data[at:].startswith(value.encode() + b"\n") for value, _, at in found)
    assert list(end.values()) == [data.index(b"unfinished")]


def test_lines_longer_than_a_chunk(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "_CHUNK", 5)
    log = tmp_path / "sensor.json"
    lines = ["0123456789abc", "", "xy", "z" * 23]
    log.write_text("\n".join(lines) + "\n")
    for most in (1, 3, 10, 100):
        reader = tail.TailReader(str(log), "start", most)
        assert [row[0] for row in pieces_of(reader, {}, reader.latestOffset())] == lines


def test_growth_rotation_truncation(tmp_path):
    log, seen, start = tmp_path / "sensor.json", [], {}
    reader = tail.TailReader(str(log), "start", 1 << 20)

    def look():
        nonlocal start
        end = reader.latestOffset()
        found = [row[0] for row in pieces_of(reader, start, end)]
        start = end
        return found

    assert look() == []  # missing
    log.write_text("a1\na2\n")
    assert look() == ["a1", "a2"]
    assert look() == []
    with log.open("a") as file:
        file.write("a3\na4")
    assert look() == ["a3"]
    with log.open("a") as file:
        file.write("4\n")
    log.rename(tmp_path / "sensor.json.1")
    log.write_text("b1\n")
    assert sorted(look()) == ["a44", "b1"]
    log.write_text("c1\nc2\n")
    assert look() == ["c1", "c2"]
    log.write_text("c1\n")
    assert look() == ["c1"]  # shorter with the same first line: read anew
    (tmp_path / "sensor.json.2").write_text("c1\nc3\n")  # a copy that went on longer is the same file
    assert look() == ["c3"]
    log.unlink()
    assert look() == []


def test_begin_at_the_end(tmp_path):
    log = tmp_path / "sensor.json"
    log.write_text("old\n")
    reader = tail.TailReader(str(log), "end", 1 << 20)
    start = reader.initialOffset()
    with log.open("a") as file:
        file.write("new\n")
    assert [row[0] for row in pieces_of(reader, start, reader.latestOffset())] == ["new"]
    with pytest.raises(ValueError):
        tail.TailReader(str(log), "middle", 1)


def test_a_file_cut_before_it_was_read_is_an_error(tmp_path):
    log = tmp_path / "sensor.json"
    log.write_text("a\nb\n")
    reader = tail.TailReader(str(log), "start", 1 << 20)
    end = reader.latestOffset()
    log.unlink()
    with pytest.raises(RuntimeError, match="deleted or cut"):
        pieces_of(reader, {}, end)


def test_cover_takes_each_batch_once():
    spans = {(i, i) for i in range(11)} | {(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (0, 3), (4, 7), (0, 7)}
    assert counts.cover(spans) == [(0, 7), (8, 9), (10, 10)]
    assert counts.cover(spans - {(0, 7)}, 0, 6) == [(0, 3), (4, 5), (6, 6)]
    assert counts.cover(spans, 8, 9) == [(8, 9)]
    assert counts.cover({(3, 3), (4, 4)}) == [(3, 3), (4, 4)]
    assert counts.cover(set()) == []


def test_counts_of_many_batches(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    groups = lambda: {"value": counts.Group([F.col("value")], F.col("value") != "skip", F.col("label"))}
    for i in range(9):
        frame = spark.createDataFrame([("hot", f"l{9 - i}"), ("hot", None), (f"v{i}", "x"), ("skip", "x"), (None, "x")], "value string, label string")
        frame.coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema("value string, label string").option("maxFilesPerTrigger", 1).json(source)
        counts.store_counts(stream, groups, store, f"{store}-state", fan=2).trigger(availableNow=True).start().awaitTermination()
    spans = counts._spans(spark, store)
    assert counts.cover(spans) == [(0, 7), (8, 8)]
    found = {tuple(r["keys"]): (r.label, r.n) for r in counts.stored_counts(spark, store, "value").collect()}
    assert found == {("hot",): ("l1", 18)} | {(f"v{i}",): ("x", 1) for i in range(9)}
    assert counts.stored_counts(spark, store, "other").collect() == []
    assert counts.stored_counts(spark, str(tmp_path / "none"), "value").collect() == []


def test_pending_addresses_come_back(spark):
    none = spark.createDataFrame([], reputation.STATE)
    attempts = lambda *ips: spark.createDataFrame([(ip,) for ip in ips], "src_ip string")
    scores = lambda *ips: spark.createDataFrame([(ip,) for ip in ips], "ip string")
    first = reputation.pending(none, attempts("a", "b", "b"), scores(), "2024-01-31 00:00:00")
    assert rows(first.select("src_ip", "tries", "due")) == [("a", 1, True), ("b", 1, True)]
    soon = reputation.pending(first, attempts("c", "a"), scores("b"), "2024-01-31 00:00:30")
    assert rows(soon.select("src_ip", "tries", "due")) == [("a", 1, False), ("c", 1, True)]
    later = reputation.pending(soon, attempts(), scores(), "2024-01-31 00:01:00")
    assert rows(later.select("src_ip", "tries", "due")) == [("a", 2, True), ("c", 1, False)]


@pytest.mark.parametrize("size", [0, 3, 4, 5, 103])
def test_runs_are_those_of_ntile_without_a_task_for_all_lines(spark, size):
    data = [(None if i % 50 == 7 else (i * 37) % 101 // 2, f"line {i * 7 % 103:03}") for i in range(size)]
    lines = spark.createDataFrame(data, "seq long, line string").repartition(3)
    found = streams._runs(spark, lines, 4, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Window" in step and "line" in step for step in plan)
    expected, order = [], sorted(data, key=lambda row: (row[0] is not None, row[0] or 0, row[1]))
    for part in range(4):
        least, longer = divmod(size, 4)
        share = least + (part < longer)
        expected += [(*row, part + 1) for row in order[:share]]
        order = order[share:]
    assert rows(found) == sorted(expected, key=lambda r: tuple((v is None, str(v)) for v in r))
