"""The language model against dictionaries and plain sums."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from trapline.llm import language_model as lm
from trapline.llm.words import gathered, spread

DOCS = "doc_id long, text string, n_tokens long, hash long, held_out boolean"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + ["</s>"]


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        self.count, self.pairs, self.texts = Counter(), Counter(), len(texts)
        for text in texts:
            found = words(text)
            self.count.update(found)
            self.pairs.update(zip([None, *found], found))
        self.before = Counter(right for _, right in self.pairs)
        self.after = defaultdict(list)
        for (left, _), n in self.pairs.items():
            self.after[left].append(n)
        self.d2, self.d1 = (self.discounts(counts.values()) for counts in (self.pairs, self.before))
        self.taken = {left: sum(self.d2[min(m, 3)] for m in counts) for left, counts in self.after.items()}
        self.left = sum(self.d1[min(n, 3)] for n in self.before.values())
        self.total = sum(self.count.values())

    @staticmethod
    def discounts(counts):
        n = [sum(c == i for c in counts) for i in range(5)]
        if not all(n[1:]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        found = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
        return [0, *(min(max(d, 0), i) for i, d in enumerate(found, 1))]

    def word(self, word):
        if not self.before:
            return 1.0
        kinds = len(self.pairs)
        n = self.before.get(word, 0)
        return (n - self.d1[min(n, 3)]) / kinds + self.left / kinds / (len(self.count) + 1)

    def bigram(self, left, right):
        if left not in self.after:
            return self.word(right)
        seen = self.texts if left is None else self.count[left]
        n = self.pairs.get((left, right), 0)
        return (n - self.d2[min(n, 3)]) / seen + self.taken[left] / seen * self.word(right)

    def score(self, text):
        found = words(text)
        known = [self.count[word] for word in found]
        prior = self.total + 0.1 * (len(self.count) + 1)
        base = sum(math.log10((n + 0.1) / prior) for n in known)
        return len(found), sum(n > 0 for n in known), base, sum(
            math.log10(self.bigram(left, right)) for left, right in zip([None, *found], found)
        )


def compare(frame, rows):
    def out(doc_id):
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0

    plain = Plain([text for doc_id, text in rows if doc_id is not None and not out(doc_id)])
    expected = sorted((str(doc_id), out(doc_id), plain.total, *plain.score(text)) for doc_id, text in rows)
    found = sorted(
        (str(r.doc_id), r.held_out, r.train_tokens, r.n_tokens, r.n_known, r.base_score, r.score) for r in frame.collect()
    )
    assert [row[:5] for row in found] == [row[:5] for row in expected]
    for left, right in zip(found, expected):
        assert left[5:] == pytest.approx(right[5:], rel=1e-9, abs=1e-9)
    return plain


def test_spread_is_undone():
    values = np.random.default_rng(1).integers(0, 1 << 63, 10_000, np.uint64) * np.uint64(3)
    assert (gathered(spread(values)) == values).all()


def test_packing_is_undone():
    draw = np.random.default_rng(2)
    keys = np.unique(draw.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2) + np.uint64(1))
    assert (lm.unpacked(lm.packed(keys)) == keys).all()
    counts = draw.integers(0, 1 << 40, (50, 4))
    assert (lm.unpacked_counts(lm.packed_counts(counts), 4) == counts).all()


def test_counter_hands_on_all_counts(monkeypatch):
    monkeypatch.setattr(lm, "HELD", 50)
    draw, counter, parts = np.random.default_rng(3), lm.Counter(), []
    drawn = [draw.integers(0, 200, 60, np.uint64) for _ in range(40)]
    for keys in drawn:
        parts += list(counter.add(keys))
    parts += list(counter.rest())
    assert len(parts) > 1
    keys, counts = lm.merged([k for k, _ in parts], [c for _, c in parts])
    assert dict(zip(keys.tolist(), counts.tolist())) == Counter(np.concatenate(drawn).tolist())


def test_scores_match_dictionaries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    compare(lm.score_corpus(docs), rows)


def test_many_small_arrays(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 1000)
    monkeypatch.setattr(lm, "SHARD_BIGRAMS", 2000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 30")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    compare(lm.score_corpus(docs), rows)


def test_odd_rows(spark):
    long_text = " ".join(f"word{i % 700} and" for i in range(100_000))
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\f\r "),
        (4, long_text),
        (5, "The quick brown fox. " * 30),
        (5, "The quick brown fox. " * 30),
        (6, "É naïve…. a\x1cb <|endoftext|> 日本語。 </s>x"),
        (None, "no id but the quick words"),
        (8, "x" * 300_000),
        (9, "the the THE The"),
        (19, "unseen words only here"),
    ]
    frame = spark.createDataFrame([(*row, 1, 2, True) for row in rows], DOCS)
    compare(lm.score_corpus(frame), rows)


def test_nothing_to_learn_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(held, "some words"), (None, "others")]
    compare(lm.score_corpus(spark.createDataFrame([(*row, 1, 2, True) for row in rows], DOCS)), rows)
    assert lm.score_corpus(spark.createDataFrame([], DOCS)).collect() == []


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "a c c b", "b a b c d e", "e e e a"] * 3 + ["f g", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm.fit(rows)
    assert model.vocabulary == 8
    scorer = model.opened()
    vocabulary = ["a", "b", "c", "d", "e", "f", "g", "zzz"]
    ends = scorer.score(vocabulary)["score"]  # P(w) P(end | w)
    starts = {w: Plain(texts).bigram(None, w) for w in vocabulary}
    ended = {w: Plain(texts).bigram(w, "</s>") for w in vocabulary}
    for word, both in zip(vocabulary, ends):
        assert both == pytest.approx(math.log10(starts[word] * ended[word]))
    empty = 10 ** scorer.score([""])["score"][0]
    assert empty + sum(starts.values()) == pytest.approx(1.0)


def test_a_folder_that_cannot_be_mapped_is_refused():
    assert lm.local_path("file:///a/b") == lm.local_path("file:/a/b") == lm.local_path("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        lm.local_path("hdfs://host/a")


def test_held_out_text_is_less_likely(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = lm.score_corpus(docs).groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("mean"))
    means = {row.held_out: row.mean for row in found.collect()}
    assert means[False] > means[True]


def test_a_counter_holds_little():
    draw, found, total = np.random.default_rng(5), lm.Counter(), 0
    tracemalloc.start()
    for _ in range(60):
        total += sum(int(counts.sum()) for _, counts in found.add(draw.integers(0, 1 << 63, 50_000, np.uint64)))
    total += sum(int(counts.sum()) for _, counts in found.rest())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 3_000_000
    assert peak < 80 << 20


def test_packed_counts_and_keys_take_the_bytes_that_they_need():
    assert len(lm.packed_counts(np.array([[1, 2, 3, 200]] * 100))) == 401
    assert len(lm.packed(np.arange(7, 1007, dtype=np.uint64))) < 1020
    for n in (1, 2):
        keys = np.array([1 << 63, (1 << 64) - 1][:n], np.uint64)
        assert (lm.unpacked(lm.packed(keys)) == keys).all()


def test_merging_pieces_holds_little():
    draw = np.random.default_rng(7)
    drawn = [np.unique(draw.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2)) for _ in range(60)]
    drawn += drawn[:30]
    pieces = [lm.packed(key) for key in drawn], [lm.packed_counts(np.full(len(key), i + 1)) for i, key in enumerate(drawn)]
    tracemalloc.start()
    keys, counts = lm._pieces_merged(*pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.unique(np.concatenate(drawn))
    assert pieces == ([], []) and (keys == want).all()
    assert counts.sum() == sum(len(key) * (i + 1) for i, key in enumerate(drawn))
    # 1.8 million keys and counts are 22 MB as they come; the result is as large again at most.
    assert peak < 80 << 20
