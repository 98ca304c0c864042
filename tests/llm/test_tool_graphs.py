"""Calls of several predecessors against a plain topological order, and a row for every turn."""

import random

from trapline.llm import tool_calls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"
NEEDS = "conv_id long, call_id string, after string"


def plain_levels(ids, pairs):
    """Longest ways by peeling calls whose predecessors all have a level."""
    wanted = {i: {a for c, a in pairs if c == i and a in ids} for i in ids}
    levels = {}
    while True:
        ready = [i for i in ids if i not in levels and wanted[i] <= levels.keys()]
        if not ready:
            return {i: levels.get(i) for i in ids}
        for i, level in [(i, 1 + max((levels[a] for a in wanted[i]), default=-1)) for i in ready]:
            levels[i] = level


def test_levels_of_random_graphs(spark):
    draw, calls, needs, expected = random.Random(5), [], [], {}
    for conv in range(40):
        ids = [f"c{i}" for i in range(draw.randint(1, 14))]
        # Half of the graphs may have cycles and calls that need themselves; some need calls that are not there.
        pairs = set()
        for i, call in enumerate(ids):
            for _ in range(draw.choice((0, 1, 1, 2, 3))):
                pairs.add((call, draw.choice(ids if conv % 2 else ids[:i] or ["none"])))
        after = {}
        for call, up in sorted(pairs):
            if call in after or draw.random() < 0.5:
                needs += [(conv, call, up)] * draw.choice((1, 2))
            else:
                after[call] = up
        calls += [(conv, call, i, "t", "{}", after.get(call)) for i, call in enumerate(ids)]
        expected |= {(conv, call): level for call, level in plain_levels(ids, pairs).items()}
    needs += [(1, None, "c0"), (None, "c0", "c0"), (99, "c0", "c0")]
    frames = (spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS))
    rows = tool_calls.link_calls(*frames, {"t": {}}, spark.createDataFrame(needs, NEEDS)).collect()
    assert {(r.conv_id, r.call_id): r.level for r in rows} == expected and len(rows) == len(expected)
    assert all((r.status == "cycle") == (r.level is None) for r in rows)
    assert None in expected.values() and max(level or 0 for level in expected.values()) > 3
    assert [(r.conv_id, r.level is None, r.level or 0) for r in rows] == sorted((r.conv_id, r.level is None, r.level or 0) for r in rows)


def test_every_row_of_the_input_has_a_row(spark):
    calls = [(1, "a", 1, "t", "{}", None)] * 3 + [(1, "a", 2, "t", None, "x"), (None, "a", 1, "t", "{}", None), (1, None, 1, "t", "{}", None)]
    results = [(1, "a", 2, "r"), (1, "a", 2, None), (1, "a", 5, "r"), (1, "a", 2, "r"), (2, "b", 1, "lost"), (2, "b", 1, "lost"), (None, None, None, None)]
    others = spark.createDataFrame([(1, 0, "system", "s"), (1, 0, "system", "s"), (None, None, None, None)], "conv_id long, turn long, role string, content string")
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    rows = tool_calls.link_all(*frames, {"t": {}}, others=others).collect()
    assert sum(r.copies for r in rows) == len(calls) + len(results) + 3 - 1  # a call and its result share a row
    got = sorted((r.status, str(r.conv_id), str(r.call_id), str(r.turn), r.copies) for r in rows)
    assert got == [
        ("ok", "1", "a", "1", 1),
        ("orphan", "2", "b", "1", 1),
        ("other", "1", "None", "0", 2),
        ("other", "None", "None", "None", 1),
        ("repeated", "1", "a", "1", 2),
        ("repeated", "1", "a", "2", 1),
        ("surplus", "1", "a", "2", 1),
        ("surplus", "1", "a", "2", 1),
        ("surplus", "1", "a", "5", 1),
        ("surplus", "2", "b", "1", 1),
        ("unlinked", "1", "None", "1", 1),
        ("unlinked", "None", "None", "None", 1),
        ("unlinked", "None", "a", "1", 1),
    ]
    assert tool_calls.link_all(*(f.limit(0) for f in frames), {}, others=others.limit(0)).collect() == []
