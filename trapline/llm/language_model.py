"""Bigram model with interpolated modified Kneser-Ney smoothing, counted in Spark and scored from memory-mapped arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import give_back, slices, written
from trapline.llm.words import gathered, spread, word_hashes
from trapline.settings import work_folder

# Words and bigrams of one sorted array, about.
SHARD_WORDS = 1 << 18
SHARD_BIGRAMS = 1 << 21
# A task hands its counts on when it has so many different keys.
HELD = 1 << 19
# Bigrams of an array that are sorted, or whose words are looked up, together.
STEP = 1 << 18
# Characters that are looked up together, when texts are scored.
LOOKUP_CHARS = 1 << 19
# The end of a text is a token; its hash is that of no word but by accident.
END = np.uint64(0x9E3779B97F4A7C15)
# Discounts where counts of counts are too few to tell.
FALLBACK = (0.5, 1.0, 1.5)
BASE_PRIOR = 0.1

_SIGN = np.uint64(1 << 63)


def local_path(folder: str) -> str:
    """The folder as a path that workers can map; the shared folder must be mounted where they run."""
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"{folder}: the model's arrays are memory-mapped, so spark.checkpoint.dir must be a mounted folder")
    return path


# Sorted keys and their counts


def merged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values; the lists are emptied, as a worker holds few arrays of this size."""
    key, value = np.concatenate(keys), np.concatenate(values)
    keys.clear()
    values.clear()
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value, first, dtype=np.int64) if len(key) else value.astype(np.int64)


class Counter:
    """Counts of 64-bit keys that are handed on, sorted, when there are many."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        found, counts = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(_narrow(counts))
        self.held += len(found)
        if self.held > 2 * HELD:
            self._merge()
            if self.held > HELD:
                yield from self.rest()

    def _merge(self) -> None:
        key, count = merged(self.keys, self.counts)
        self.keys, self.counts, self.held = [key], [count], len(key)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            self._merge()
            found = self.keys.pop(), self.counts.pop()
            self.held = 0
            yield found


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte of all, as many bytes as the greatest needs, and that number of bytes first."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    parts = values.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(parts.T).tobytes()


def _from_planes(data: bytes, start: int = 0) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=start + 1).reshape(data[start], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : len(planes)] = planes.T
    return values.view(np.uint64).ravel()


def packed(sorted_keys: np.ndarray) -> bytes:
    """The first of sorted unsigned keys, one or more, and the differences of the others."""
    return sorted_keys[:1].tobytes() + _planes(np.diff(sorted_keys))


def unpacked(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, np.uint64, 1)
    return np.cumsum(np.concatenate([first, _from_planes(data, 8)]), dtype=np.uint64)


def packed_counts(values: np.ndarray) -> bytes:
    return _planes(np.ascontiguousarray(values, np.uint64).reshape(-1))


def unpacked_counts(data: bytes, width: int) -> np.ndarray:
    values = _from_planes(data).view(np.int64)
    return values.reshape(-1, width) if width > 1 else values


def _saved(folder: str, **arrays: np.ndarray) -> str:
    """Write the arrays under a name of their own, so that a repeated task replaces nothing; that name."""
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/{uuid.uuid4().hex}"
    for kind, values in arrays.items():
        np.save(f"{name}.{kind}.npy", values)
    return name


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts.astype(np.uint64)


def _mapped(name: str, kind: str) -> np.ndarray:
    return np.load(f"{name}.{kind}.npy", mmap_mode="r")


# The model


@dataclass(frozen=True)
class Shards:
    """Sorted arrays on disk: the first key, number of keys and name of each."""

    first: np.ndarray
    sizes: np.ndarray
    names: list[str]

    @cached_property
    def base(self) -> np.ndarray:
        """Number of keys before each array."""
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def places(self, keys: np.ndarray, arrays: list[np.ndarray]) -> np.ndarray:
        """Place of each of the sorted keys among all, -1 if it is not there."""
        found = np.full(len(keys), -1, np.int64)
        cuts = np.concatenate([[0], np.searchsorted(keys, self.first[1:]), [len(keys)]]) if self.names else [0]
        for i, array in enumerate(arrays):
            part = keys[cuts[i] : cuts[i + 1]]
            if len(part):
                at = np.minimum(np.searchsorted(array, part), len(array) - 1)
                found[cuts[i] : cuts[i + 1]] = np.where(array[at] == part, at + self.base[i], -1)
        return found

    def values(self, places: np.ndarray, arrays: list[np.ndarray]) -> np.ndarray:
        """Values at sorted places, none of them -1."""
        cuts = np.searchsorted(places, self.base)
        parts = [array[places[cuts[i] : cuts[i + 1]] - self.base[i]] for i, array in enumerate(arrays)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """What modified Kneser-Ney smoothing takes from counts of 0, 1, 2, and 3 or more, by the numbers of n-grams seen 1 to 4 times."""
    if not (ones and twos and threes and fours):
        return np.array([0.0, *FALLBACK])
    share = ones / (ones + 2 * twos)
    found = [1 - 2 * share * twos / ones, 2 - 3 * share * threes / twos, 3 - 4 * share * fours / threes]
    return np.array([0.0, *(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1))])


@dataclass(frozen=True)
class BigramModel:
    """Where the arrays are, and the few numbers that hold for all; small whatever the corpus.

    Words stand in the order of their hashes, and a word's place is its number; the start of a text has the number
    after the last word.  ``words`` has arrays ``hash``, ``count`` (occurrences) and ``around``: the words' followers
    seen once, twice and more often, and their different predecessors.  ``bigrams`` has ``hash`` (a bijection
    of both numbers) and ``count``.
    """

    words: Shards
    around: list[str]
    bigrams: Shards
    train_tokens: int
    train_texts: int
    bigram_discount: np.ndarray
    word_discount: np.ndarray
    word_kinds: np.ndarray  # words with one, two, and more predecessors
    predecessors: int  # all words' predecessors together: the number of different bigrams

    @property
    def vocabulary(self) -> int:
        return int(self.words.base[-1])

    def opened(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The model with its arrays mapped into memory; only what is looked up is read."""

    def __init__(self, model: BigramModel):
        self.model = model
        self.hashes = [_mapped(name, "hash") for name in model.words.names]
        self.counts = [_mapped(name, "count") for name in model.words.names]
        self.around = [_mapped(name, "around") for name in model.around]
        self.bigram_hashes = [_mapped(name, "hash") for name in model.bigrams.names]
        self.bigram_counts = [_mapped(name, "count") for name in model.bigrams.names]
        kinds, total = model.word_kinds, max(model.predecessors, 1)
        left = float(model.word_discount[1:] @ kinds) / total if model.vocabulary else 1.0
        self.unseen = left / (model.vocabulary + 1)

    def word_probability(self, predecessors: np.ndarray) -> np.ndarray:
        """Probability by different predecessors, 0 for an unknown word; what is discounted goes to all words and one unknown."""
        taken = self.model.word_discount[np.minimum(predecessors, 3)]
        return (predecessors - taken) / max(self.model.predecessors, 1) + self.unseen

    def bigram_count(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Occurrences of the bigrams of these word numbers."""
        keys, back = np.unique(bigram_hashes(left, right), return_inverse=True)
        places = self.model.bigrams.places(keys, self.bigram_hashes)
        counts = np.zeros(len(keys), np.int64)
        known = places >= 0
        counts[known] = self.model.bigrams.values(places[known], self.bigram_counts)
        return counts[back]

    def score(self, texts: list[str]) -> dict[str, np.ndarray]:
        """By text: n_tokens, n_known, base_score and score, the sum of the log10 probabilities of all its tokens."""
        model = self.model
        hashes, ends = tokens(texts)
        distinct, back = np.unique(hashes, return_inverse=True)
        places = model.words.places(ordered(distinct), self.hashes)
        known = places >= 0
        count, around = np.zeros(len(distinct), np.int64), np.zeros((len(distinct), 4), np.int64)
        if known.any():
            count[known] = model.words.values(places[known], self.counts)
            around[known] = model.words.values(places[known], self.around)
        base = np.log10((count + BASE_PRIOR) / (model.train_tokens + BASE_PRIOR * (model.vocabulary + 1)))
        # The distinct words as contexts, and the start of a text after them.
        followers = np.concatenate([around[:, :3], self.start_followers()])
        seen = np.concatenate([count, [model.train_texts]])
        share = (followers @ model.bigram_discount[1:]) / np.maximum(seen, 1)
        starts = np.concatenate([[0], ends[:-1]])
        previous = np.concatenate([[0], back[:-1]])
        previous[starts] = len(distinct)
        number = np.concatenate([places, [model.vocabulary]])
        context = seen[previous] > 0
        probability = self.word_probability(around[:, 3])[back]
        probability[context] *= share[previous[context]]
        both = np.flatnonzero(context & known[back])
        found = self.bigram_count(number[previous[both]], places[back[both]])
        probability[both] += (found - model.bigram_discount[np.minimum(found, 3)]) / seen[previous[both]]
        return {
            "n_tokens": ends - starts,
            "n_known": np.add.reduceat(known[back].astype(np.int64), starts),
            "base_score": np.add.reduceat(base[back], starts),
            "score": np.add.reduceat(np.log10(probability), starts),
        }

    def start_followers(self) -> np.ndarray:
        """Followers of the start of a text seen once, twice and more often."""
        return self.around[-1][-1:, :3].astype(np.int64) if self.around else np.zeros((1, 3), np.int64)


def ordered(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed ones of the same order, as Spark sorts them."""
    return (hashes ^ _SIGN).view(np.int64)


def bigram_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return spread((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, words and one end for each text, and where each text's tokens end."""
    hashes, ends = word_hashes(texts)
    return np.insert(hashes, ends, END), ends + np.arange(1, len(texts) + 1)


# Fitting


def _count_words(texts: DataFrame) -> DataFrame:
    """(hash, n) of all tokens of (text), counted in the tasks first."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ordered(keys)), pa.array(counts, pa.int64())], names=["hash", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for (found,) in slices(batches, 0):
            for keys, counts in counter.add(tokens(found)[0]):
                yield rows(keys, counts)
        for keys, counts in counter.rest():
            yield rows(keys, counts)
        give_back()

    counted = texts.mapInArrow(task, "hash long, n long")
    return written(counted.groupBy("hash").agg(F.sum("n").alias("n")), "lm-words")


def _word_arrays(counts: DataFrame, size: int, folder: str) -> Shards:
    """The words' hashes and counts, sorted, a file of each for a range of hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts and sum(map(len, parts)):
            hashes, n = (np.concatenate([part.column(i).to_numpy() for part in parts]) for i in (0, 1))
            name = _saved(folder, hash=hashes, count=_narrow(n))
            row = {"first": [int(hashes[0])], "n": [len(hashes)], "name": [name]}
            yield pa.RecordBatch.from_pydict(row)

    ranged = counts.repartitionByRange(max(1, -(-size // SHARD_WORDS)), "hash").sortWithinPartitions("hash")
    return _shards(written(ranged.mapInArrow(task, "first long, n long, name string"), "lm-word-arrays"), np.int64)


def _shards(listed: DataFrame, kind: type) -> Shards:
    """One row per array comes to the driver: a millionth of the words or bigrams."""
    rows = listed.select("first", "n", "name").collect()
    found = sorted((int(np.array(first).astype(kind)), n, name) for first, n, name in rows)
    return Shards(
        np.array([first for first, _, _ in found], kind),
        np.array([n for _, n, _ in found], np.int64),
        [name for _, _, name in found],
    )


def _count_bigrams(texts: DataFrame, words: Shards, shards: int) -> DataFrame:
    """(shard, keys, counts) of the bigrams of (text): sorted hashes and their counts, as far as a task counted them."""
    size = int(words.base[-1])
    starts = np.array([-(-(i << 64) // shards) for i in range(shards)], np.uint64)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cuts = np.append(np.searchsorted(keys, starts), len(keys))
        used = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array([packed(keys[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
                pa.array([packed_counts(counts[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
            ],
            names=["shard", "keys", "counts"],
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [_mapped(name, "hash") for name in words.names]
        counter = Counter()
        for (found,) in slices(batches, 0):
            hashes, ends = tokens(found)
            distinct, back = np.unique(hashes, return_inverse=True)
            right = words.places(ordered(distinct), arrays)[back]
            left = np.concatenate([[0], right[:-1]])
            left[np.concatenate([[0], ends[:-1]])] = size
            for keys, counts in counter.add(bigram_hashes(left, right)):
                yield rows(keys, counts)
        for keys, counts in counter.rest():
            yield rows(keys, counts)
        give_back()

    return texts.mapInArrow(task, "shard int, keys binary, counts binary")


_REDUCED = "first long, n long, name string, n1 long, n2 long, n3 long, n4 long, part int, ids binary, sums binary"


def _bigram_arrays(counted: DataFrame, words: Shards, shards: int, folder: str) -> DataFrame:
    """The bigrams' arrays, with the number of bigrams seen 1 to 4 times; and, by part of the words, what they say of the words."""
    bounds = words.base[:-1].astype(np.uint64)

    def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the bigrams, and what these say of them, from STEP bigrams at a time."""
        left, right = np.empty(len(key), np.uint32), np.empty(len(key), np.uint32)
        steps = [slice(at, at + STEP) for at in range(0, len(key), STEP)]
        for step in steps:
            pair = gathered(key[step])
            left[step], right[step] = pair >> np.uint64(32), pair.astype(np.uint32)
        ids = np.union1d(np.unique(left), np.unique(right))
        sums = np.zeros((len(ids), 4), np.int64)
        for step in steps:
            at, seen = np.searchsorted(ids, left[step]), np.minimum(count[step], 3)
            for i in (1, 2, 3):
                sums[:, i - 1] += np.bincount(at[seen == i], minlength=len(ids))
            sums[:, 3] += np.bincount(np.searchsorted(ids, right[step]), minlength=len(ids))
        return ids.astype(np.uint64), sums

    def reduced(keys: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        key, count = _pieces_merged(keys, counts)
        name = _saved(folder, hash=key, count=count)
        few = [int((count == i).sum()) for i in (1, 2, 3, 4)]
        rows = [(int(key[0].view(np.int64)), len(key), name, *few, None, None, None)]
        ids, sums = summed(key, count)
        del key, count
        cuts = np.append(np.searchsorted(ids, bounds), len(ids))
        for i in range(len(bounds)):
            part = slice(cuts[i], cuts[i + 1])
            if cuts[i] < cuts[i + 1]:
                rows.append((None,) * 7 + (i, packed(ids[part]), packed_counts(sums[part])))
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.binary()]
        names = [one.split()[0] for one in _REDUCED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts in _by_first(batches):
            yield reduced(keys, counts)
            give_back()

    dealt = counted.repartition(shards, "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(task, _REDUCED), "lm-bigram-arrays")


def _pieces_merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of packed pieces and their counts, from about STEP keys at a time; the lists are emptied."""
    parts = []
    while keys:
        parts.append((unpacked(keys.pop()), _narrow(unpacked_counts(counts.pop(), 1))))
    held = sum(len(key) for key, _ in parts)
    low, high = min(int(key[0]) for key, _ in parts), max(int(key[-1]) for key, _ in parts)
    ranges = -(-held // STEP)
    bounds = np.array([low + (high - low) * i // ranges for i in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(key, bounds).tolist(), len(key)] for key, _ in parts]
    found, sums, end = np.empty(held, np.uint64), np.empty(held, np.int64), 0
    for i in range(ranges):
        own = [(key[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]) for (key, count), cut in zip(parts, cuts)]
        key, count = merged([key for key, _ in own], [count for _, count in own])
        found[end : end + len(key)], sums[end : end + len(key)] = key, count
        end += len(key)
    return found[:end], _narrow(sums[:end])


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Rows of equal first columns, which stand together: that value, and the lists of the second and third."""
    now, second, third = None, [], []
    for batch in batches:
        for value, two, three in zip(*(column.to_pylist() for column in batch.columns)):
            if value != now and second:
                yield now, second, third
                second, third = [], []
            now = value
            second.append(two)
            third.append(three)
    if second:
        yield now, second, third


def _around_arrays(reduced: DataFrame, words: Shards, folder: str) -> DataFrame:
    """(part, name, n1, n2, n3, n4, total): arrays ``around`` by part of the words, with the number of words of 1 to 4 predecessors."""
    base, parts = words.base, len(words.names)

    names = ["part", "name", "n1", "n2", "n3", "n4", "total"]

    def saved(part: int, around: np.ndarray) -> pa.RecordBatch:
        last = around[:, 3]
        row = [part, _saved(folder, around=_narrow(around)), *(int((last == i).sum()) for i in (1, 2, 3, 4)), int(last.sum())]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, around = None, None
        for batch in batches:
            for part, ids, sums in zip(*batch.columns):
                if part.as_py() != now:
                    if around is not None:
                        yield saved(now, around)
                    now = part.as_py()
                    # The last part has the start of a text too.
                    around = np.zeros((int(words.sizes[now]) + (now == parts - 1), 4), np.int64)
                at = unpacked(ids.as_py()) - np.uint64(base[now])
                around[at.astype(np.int64)] += unpacked_counts(sums.as_py(), 4)
        if around is not None:
            yield saved(now, around)
        give_back()

    rows = reduced.filter("part IS NOT NULL").select("part", "ids", "sums")
    dealt = rows.repartition(max(1, parts), "part").sortWithinPartitions("part")
    found = dealt.mapInArrow(task, "part long, name string, n1 long, n2 long, n3 long, n4 long, total long")
    return written(found, "lm-around")


def fit(texts: DataFrame) -> BigramModel:
    """The model of the texts (text), each with an end.

    Words are counted, and numbered by sorted hash; bigrams of these numbers are counted in the tasks and merged by
    ranges of their hashes, each into one sorted array of the shared folder, and what bigrams
    say of their words is summed by ranges of words.  The arrays grow with the corpus and stay there.  The driver
    gets one row per array.
    """
    folder = local_path(work_folder(texts.sparkSession, "lm-arrays"))
    counts = _count_words(texts)
    seen = counts.agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens")).first()
    total = seen.tokens or 0
    words = _word_arrays(counts, seen.size, folder)
    shards = max(1, -(-total // SHARD_BIGRAMS))
    reduced = _bigram_arrays(_count_bigrams(texts, words, shards), words, shards, folder)
    arrays = reduced.filter("name IS NOT NULL").select("first", "n", "name", "n1", "n2", "n3", "n4")
    listed = arrays.agg(*(F.sum(f"n{i}") for i in (1, 2, 3, 4))).first()
    around = sorted(_around_arrays(reduced, words, folder).collect())
    kinds = [sum(row[f"n{i}"] for row in around) for i in (1, 2, 3, 4)]
    end = int(ordered(np.array([END]))[0])
    texts_seen = counts.filter(F.col("hash") == F.lit(end)).agg(F.sum("n")).first()[0] or 0
    return BigramModel(
        words,
        [row["name"] for row in around],
        _shards(arrays, np.uint64),
        total,
        texts_seen,
        discounts(*(n or 0 for n in listed)),
        discounts(*kinds),
        np.array([kinds[0], kinds[1], seen.size - kinds[0] - kinds[1]], float),
        sum(row.total for row in around),
    )


# The operator


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of the id as text leaves remainder 0 modulo 10; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def perplexity(docs: DataFrame, model: BigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score, score, perplexity.

    Scores are sums of log10 probabilities over the tokens of the whole text, its end included; perplexity is
    10 to minus the mean.  Cases: a null text counts as empty, which is one token; rows that share an id are scored
    each; a null id stays null; an empty table gives no rows.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "n_known", "base_score", "score"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.opened()
        for doc_ids, texts in slices(batches, 1, LOOKUP_CHARS):
            found = scorer.score(texts)
            columns = [pa.array(doc_ids, pa.int64()), *(pa.array(found[name]) for name in names)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(task, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the rows that are not held out, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Lower-cased A-Z; words are runs without ASCII white space; probabilities are those of modified Kneser-Ney
    smoothing with bigrams and words interpolated down to an equal share for every known word and one unknown.  ``base_score`` is
    that of single tokens with 0.1 added to each count.

    Cases as in ``perplexity``; a row without an id is not learnt from; with nothing to learn from every token has probability 1.
    Words and bigrams are told apart by 64-bit hashes.
    """
    learnt = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
    model = fit(learnt.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    found = perplexity(docs, model, id_col, text_col)
    train_tokens = F.lit(model.train_tokens).cast("long").alias("train_tokens")
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", train_tokens, "base_score", "score", "perplexity")
