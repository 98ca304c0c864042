"""Operators that compare documents or conversations with each other, and the pipeline, against brute force."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from trapline.llm import exact_dedup, mixing, near_dedup, shared, tool_calls
from trapline.llm.components import components, contracted, partial_labels

DOCS = "doc_id long, text string, lang string, source string, kept boolean, rep long, key long"


def with_rows(spark, rows):
    return spark.createDataFrame([(*row, None, None, True, 1, 2)[:7] if len(row) == 2 else row for row in rows], DOCS)


# 2: near-duplicates


class Sets:
    """Union-find over ids."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def shingles(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_force(rows, k):
    sets = {doc_id: frozenset(shingles(text, k)) for doc_id, text in rows}
    found, distinct = Sets(), defaultdict(list)
    for doc_id, own in sets.items():
        found.find(doc_id)
        distinct[own].append(doc_id)
    distinct.pop(frozenset(), None)
    for ids in distinct.values():
        for other in ids[1:]:
            found.join(ids[0], other)
    known = list(distinct)
    for i, left in enumerate(known):
        for right in known[:i]:
            both = len(left & right)
            if 100 * both >= 80 * (len(left) + len(right) - both):
                found.join(distinct[left][0], distinct[right][0])
    return {doc_id: (len(own), found.find(doc_id)) for doc_id, own in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    # A large group of copies with edits of their own: similar in a chain, not all to each other.
    base = [f"w{i}" for i in range(120)]
    for copy in range(150):
        words = list(base)
        for edit in range(copy % 9):
            words[(copy * 37 + edit * 13) % 120] = f"e{copy}x{edit}"
        rows.append((10_000 + copy, " ".join(words)))
    rows += [(20_000 + i, " ".join(base[: 20 + i])) for i in range(60)]  # each a little longer than the one before
    rows += [(30_000 + i, "the same passage of some words that all share " * 2 + f"own{i} text{i}") for i in range(50)]
    rows += [(1_000_000, None), (1_000_001, ""), (1_000_002, " \n"), (1_000_003, "One"), (1_000_004, "one"), (1_000_005, "two")]
    frame = with_rows(spark, rows)
    found = {row.doc_id: row for row in near_dedup.near_dedup(frame, shingle_words=k).collect()}
    want = brute_force(rows, k)
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == want
    assert all(row.kept == (row.doc_id == row.component_id) for row in found.values())


def test_near_duplicates_edge_rows(spark):
    text = "a few words that are the same in both of these rows here"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, text.upper()), (3, text + " more")]
    found = near_dedup.near_dedup(with_rows(spark, rows)).select("doc_id", "component_id", "kept").collect()
    assert Counter(map(tuple, found)) == Counter(
        {(1, 1, True): 2, (None, None, True): 2, (2, 1, False): 1, (3, 1, False): 1}
    )
    assert near_dedup.near_dedup(with_rows(spark, []).limit(0)).collect() == []


def test_a_large_group_makes_few_links(spark, monkeypatch):
    import random

    draw, carried = random.Random(5), []
    words = [f"w{i}" for i in range(200)]
    rows = []
    for doc_id in range(400):
        own = list(words)
        for at in draw.sample(range(200), 2):
            own[at] = f"x{doc_id}_{at}"
        rows.append((doc_id, " ".join(own)))
    rows += [(1000 + i, " ".join(f"other{i}_{j}" for j in range(50))) for i in range(100)]
    real = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda links: carried.append(links.count()) or real(links))
    found = near_dedup.near_dedup(with_rows(spark, rows), shingle_words=4).collect()
    assert {r.doc_id: r.component_id for r in found} == {doc_id: 0 if doc_id < 400 else doc_id for doc_id, _ in rows}
    assert carried[0] < 5 * 400


def test_sets_ask_few_pivots_of_a_large_group(spark, monkeypatch):
    import random

    draw, tested = random.Random(7), []
    words = [f"w{i}" for i in range(150)]
    rows = []
    for doc_id in range(600):
        # Sets with three edits link only with those that have fewer, and those with six not at all.
        own = list(words)
        for at in draw.sample(range(150), draw.choice((1, 2, 2, 3, 3, 3, 6))):
            own[at] = f"x{doc_id}_{at}"
        rows.append((doc_id, " ".join(own)))
    monkeypatch.setattr(near_dedup, "BUCKET", 1)  # all buckets are large
    real = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *more: tested.append(pairs.count()) or real(pairs, *more))
    found = near_dedup.near_dedup(with_rows(spark, rows), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(rows, 4)
    assert sum(tested) < 20 * len(rows)


def test_frequent_sets_are_one_class(spark):
    rows = [(i, "the same words in every row") for i in range(50, 1500)] + [(i, f"one of its own {i}") for i in range(50)]
    found = near_dedup.near_dedup(with_rows(spark, rows), shingle_words=4).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: 50 if i >= 50 else i for i, _ in rows}


def test_registers_and_estimate():
    import numpy as np

    draw = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        estimates = []
        for _ in range(60):
            both = draw.integers(0, 1 << 64, int(2000 * share), np.uint64)
            left, right = (
                np.unique(np.concatenate([both, draw.integers(0, 1 << 64, int(1000 * (1 - share)), np.uint64)])) for _ in "ab"
            )
            true = len(np.intersect1d(left, right)) / len(np.union1d(left, right))
            rows = [near_dedup.registers(one)[None] for one in (left, right)]
            estimates.append(near_dedup.estimate(*rows)[0][0] - true)
        assert abs(np.mean(estimates)) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (9, 7), (500, 2), (500, 9), (1000, 1001), (5, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = Sets()
    for a, b in links:
        if a != b:
            want.join(a, b)
    expected = {node: want.find(node) for node in list(want.parent)}
    assert {r.node: r.component for r in components(frame).collect()} == expected
    fewer = contracted(frame, 2)
    for row in partial_labels(fewer).collect():
        assert expected[row.node] == expected[row.component]
    assert {r.node: r.component for r in components(fewer).collect()} == expected
    assert components(frame.limit(0)).collect() == []


# 3: exact duplicates


@pytest.mark.parametrize("heavy", [1, 2, 1000])
def test_exact_duplicates(spark, heavy):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"text {i % 40}") for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, "hot "), (2003, "Hot"), (5, "hot"), (None, "hot"), (None, "alone"), (3000, "y" * 200_000)]
    found = exact_dedup.exact_dedup(with_rows(spark, rows), heavy=heavy).collect()
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    want = Counter()
    for doc_id, text in rows:
        keep = max((i for i in groups[text or ""] if i is not None), default=None)
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        want[doc_id, keep, len(groups[text or ""]), doc_id == keep, sha] += 1
    assert Counter(map(tuple, found)) == want
    assert exact_dedup.exact_dedup(with_rows(spark, []).limit(0)).collect() == []


def test_frequent_digests_are_found_and_bounded(spark):
    digests = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, "warm").otherwise(F.col("id").cast("string")).alias("digest")
    )
    found = [row.digest for row in exact_dedup.frequent_digests(digests, 20, 1024).collect()]
    assert {"hot", "warm"} <= set(found) and len(found) <= 20


# 7: mixing


def test_raked_weights_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.measured(docs).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens")).cache()
    wanted = {"lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1, "xx": 5.0}}
    shares = {m: mixing.targets(cells, m, wanted.get(m), 0.5) for m in mixing.MARGINS}
    fitted = mixing.rake(cells, shares, rounds=30).collect()
    total = sum(row.tokens for row in fitted)
    for margin in ("lang", "topic"):
        share = {row[margin]: row.share for row in shares[margin].collect()}
        for value, target in share.items():
            assert sum(row.weight for row in fitted if row[margin] == value) / total == pytest.approx(target, abs=0.01)


def test_mixing_draws_the_budget_and_handles_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix(docs, budget=0.5).collect()
    assert len(found) == docs.count() and all(0 <= row.probability <= 1 for row in found)
    total = sum(row.tokens for row in found)
    assert sum(row.tokens * row.probability for row in found) == pytest.approx(0.5 * total, rel=0.02)
    assert sum(row.tokens for row in found if row.kept) == pytest.approx(0.5 * total, rel=0.1)
    rows = [(1, "a b", None, None), (1, "a b", None, None), (2, None, "en", "s"), (None, "c", "en", "s"), (3, "", None, "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = odd.withColumn("tokens", F.lit("x")).withColumn("probability", F.lit("x"))
    kept = mixing.mix(odd, budget=1.0).collect()
    assert sorted(row.tokens for row in kept) == [0, 0, 1, 2, 2]
    assert mixing.mix(odd.limit(0)).collect() == []


# 1: tool calls

SCHEMAS = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}}


def linked(spark, calls, results):
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    calls = calls.withColumn("level", F.lit(1)).withColumn("content", F.lit("x"))
    return tool_calls.link_calls(calls, results, SCHEMAS).collect()


def test_tool_calls(spark):
    calls = [
        (1, "b", 2, "add", '{"x": 2}', "a"),
        (1, "a", 1, "add", '{ "x" : 1 }', None),
        (1, "a", 9, "add", '{"x": 7}', None),  # the same identifier again
        (1, "c", 3, "add", '{"x": "no", "z": 1}', "b"),
        (1, "d", 4, "mul", "{}", "unknown"),
        (1, "e", 5, "add", "{", "a"),
        (1, "f", 6, "add", '{"x": 1}', "g"),
        (1, "g", 7, "add", '{"x": 1}', "f"),
        (1, "h", 8, "add", '{"x": 1}', "f"),
        (2, "a", 1, "add", '{"x": true}', None),
        (2, "n", 1, "add", None, None),
        (2, "o", 1, "add", '{"x": 3}', None),
        (None, "p", 1, "add", '{"x": 3}', None),
    ]
    results = [(1, "a", 3, "late"), (1, "a", 2, "é"), (1, "c", 4, "r"), (2, "o", 2, None), (3, "q", 1, "lost"), (1, "b", 3, "two")]
    rows = linked(spark, calls, results)
    got = {(row.conv_id, row.call_id): (row.level, row.status) for row in rows}
    assert got == {
        (1, "a"): (0, "ok"),
        (1, "b"): (1, "ok"),
        (1, "c"): (2, "invalid"),
        (1, "d"): (0, "invalid"),
        (1, "e"): (1, "invalid"),
        (1, "f"): (None, "cycle"),
        (1, "g"): (None, "cycle"),
        (1, "h"): (None, "cycle"),
        (2, "a"): (0, "invalid"),
        (2, "n"): (0, "invalid"),
        (2, "o"): (0, "ok"),
        (3, "q"): (None, "orphan"),
    }
    records = {(row.conv_id, row.call_id): row.record for row in rows}
    assert records[1, "a"] == '{"arguments":{"x":1},"id":"a","name":"add","result":"é"}'
    assert {row.call_id: row.errors for row in rows}["c"] == "x: not of type integer; arguments: z is not known"
    order = [row.call_id for row in rows if row.conv_id == 1 and row.level is not None]
    assert order.index("a") < order.index("b") < order.index("c")
    assert linked(spark, [], []) == []


def test_arguments_that_python_cannot_hold(spark):
    calls = [
        (1, "a", 0, "t", '{"x":"\\ud800"}', None),
        (1, "b", 1, "t", "[" * 100_000, None),
        (1, "c", 2, "t", "1" * 5_000, None),
        (1, "d", 3, "t", '{"x":"\\ud83d\\ude00"}', None),
    ]
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([(1, i, 9, "r") for i in "abcd"], "conv_id long, call_id string, turn long, content string")
    found = {r.call_id: (r.status, r.errors, r.record) for r in tool_calls.link_calls(calls, results, {"t": {}}).collect()}
    for bad in "abc":
        assert found[bad][:2] == ("invalid", "arguments: not JSON")
    assert found["d"] == ("ok", "", '{"arguments":{"x":"😀"},"id":"d","name":"t","result":"r"}')


def test_a_long_conversation_is_ordered(spark):
    n = 3000
    calls = [(1, f"c{i}", (i * 7919) % n, "add", '{"x": 1}', f"c{i - 1}" if i else None) for i in range(n)]
    rows = linked(spark, calls, [(1, f"c{i}", i, "r") for i in range(0, n, 2)])
    assert [row.call_id for row in rows] == [f"c{i}" for i in range(n)]
    assert Counter(row.status for row in rows) == {"ok": n // 2, "unanswered": n // 2}


def test_calls_of_conversations(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    said = {(r.conv_id, r.turn): r for r in turns.collect()}
    rows = tool_calls.link_calls(*tool_calls.calls_of_conversations(turns), {}).collect()
    calls = {(r.conv_id, r.turn): r for r in rows if r.status != "orphan"}
    assert set(calls) == {key for key, r in said.items() if r.role == "user"}
    for (conv, turn), row in calls.items():
        record = json.loads(row.record)
        answer = said.get((conv, turn + 1))
        assert record["arguments"]["prompt"] == said[conv, turn].text
        assert record["result"] == (answer.text if answer and answer.role == "assistant" else None)
        level = 0
        while (conv, turn - 2 * level - 2) in calls:
            level += 1
        assert row.level == level


# The pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact dedup", "near dedup", "mixing", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SMALL).cache()
        assert kept.columns == docs.columns
        left = {r.doc_id for r in kept.collect()}
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "language":
            assert all(text is None or not re.search(r"[^\W\d_]", text) for i, text in rows if i not in left) or len(left) > 0.97 * len(rows)
        if name == "exact dedup":
            assert left == set({text: i for i, text in sorted(rows)}.values())
        if name == "near dedup":
            assert left == {component for _, component in brute_force(rows, 5).values()}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in packed)


FOREIGN = [
    "Быстрая коричневая лиса прыгает через ленивую собаку. ",
    "吾輩は猫である。名前はまだ無い。どこで生れたか。",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. ",
    "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. ",
    "asdkjh qwlekjr zxmcnb poiuqwe lkjasd mnbzxc qpwoeiru ",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0 ",
]


def test_language_stage_drops_foreign_and_junk_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    planted = [(10**9 + i, text * times, None, "planted") for times in (2, 20) for i, text in enumerate(FOREIGN, 100 * times)]
    left = corpus_pipeline.language(spark, docs.unionByName(spark.createDataFrame(planted, docs.schema)), SMALL)
    ids = {row.doc_id for row in left.select("doc_id").collect()}
    assert not ids & {row[0] for row in planted}
    assert len(ids) >= 0.99 * docs.count()


def test_repeated_rows_and_null_ids_leave_one_copy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60)
    clean = [tuple(row) for row in docs.collect()]
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta")]
    rows = clean + clean[:20]  # a shard that is loaded twice
    rows += [(None, text, "en", "s") for text in (long[0], long[0], long[1], long[1] + " end", clean[30][1])]
    rows += [(7_000, long[2], "en", "s"), (7_000, long[3], "en", "s"), (8_000, long[3], "en", "s"), (8_001, long[3] + " x", "en", "s")]
    frame = spark.createDataFrame(rows, docs.schema)
    left = corpus_pipeline.exact(spark, frame, SMALL).cache()
    assert left.columns == docs.columns
    assert Counter(row.text for row in left.collect()) == Counter({row[1]: 1 for row in rows})
    texts = [row.text for row in corpus_pipeline.near(spark, left, SMALL).collect()]
    assert len(texts) == len(set(texts))
    for first, other in ((long[1], long[1] + " end"), (long[3], long[3] + " x")):
        assert (first in texts) + (other in texts) == 1
    assert {long[0], long[2]} <= set(texts)


def test_null_ids_are_judged_row_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    clean = docs.filter("length(text) > 500").limit(1).collect()[0].text
    planted = spark.createDataFrame([(None, clean, "en", "s"), (None, FOREIGN[0] * 5, None, "s")], docs.schema)
    left = corpus_pipeline.language(spark, docs.unionByName(planted), SMALL).filter("doc_id IS NULL")
    assert [row.text for row in left.collect()] == [clean]


CLASHES = ["gone_key", "repeated_key", "document_key", "pipeline_key", "pipeline_gone", "pipeline_several", "kept", "component_id"]


def test_stages_keep_columns_of_any_name_and_empty_tables(spark):
    text = "The quick brown fox jumps over the lazy dog and runs away into the dark wood. "
    rows = [(i, text * 3 + f"Number {i % 4} of them.", "en", f"s{i % 2}", 1) for i in range(12)]
    rows += [(20, "Twice the same row.", "en", None, 1)] * 2 + [(None, None, None, None, None), (21, "", "en", "a", 0), (21, "other", "en", "a", 0)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, shape).withColumns({name: F.lit(f"of {name}") for name in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, None)
        assert kept.columns == docs.columns, name
        assert {tuple(row[c] for c in CLASHES) for row in kept.collect()} <= {tuple(f"of {c}" for c in CLASHES)}
        assert stage(spark, docs.limit(0), None).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), None).collect() == []


def test_buckets_of_the_same_members_are_one(spark):
    # Three sets meet in five buckets, two of them in another one, and one is alone.
    data = [(key, rep, 9, key + rep) for key in range(5) for rep in (1, 2, 3)]
    data += [(7, 1, 9, 1), (7, 2, 9, 2), (8, 3, 9, 0)]
    found = near_dedup._shared(spark.createDataFrame(data, "key long, rep long, n long, place int")).collect()
    buckets = {}
    for row in found:
        buckets.setdefault(row.key, {})[row.rep] = (row.place, row.members, row.least, row.label)
    assert sorted(map(sorted, buckets.values())) == [[1, 2], [1, 2, 3]]
    assert {1: (1, 3, 9, 1), 2: (2, 3, 9, 2), 3: (3, 3, 9, 3)} in buckets.values()


def test_python_tasks_get_small_batches(spark):
    def task(batches):
        yield from (pa.RecordBatch.from_pydict({"size": [batch.nbytes]}) for batch in batches)

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    sizes = [row["size"] for row in shared.written(texts.mapInArrow(task, "size long"), "sizes").collect()]
    assert sum(sizes) > 6_000_000 and max(sizes) < 3_000_000


def test_the_last_stage_runs_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    found = corpus_pipeline.packing(spark, docs, SMALL)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(row.doc_id for row in found.collect()) == [1, 2]
