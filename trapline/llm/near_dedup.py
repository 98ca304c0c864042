"""Near-duplicates of word shingles by HyperMinHash registers, banding and verification on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.components import components, contracted, partial_labels
from trapline.llm.shared import slices, written
from trapline.llm.words import spread, word_hashes

SHINGLE_WORDS = 5
PERCENT = 80

# Registers per set; each keeps, of the smallest hash of its bucket, the count of
# leading zeros (6 bits) and the next bits (MANTISSA) in 16 bits, 0 if it is empty.
REGISTERS = 128
MANTISSA = 10
# Two different smallest hashes give equal registers if they have as many leading zeros (one in three) and the same mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)
# Four registers make a band of 64 bits.  Sets with a Jaccard similarity of 0.8 agree
# in a band with probability 0.8^4, and in none of the 32 bands with probability 5e-8.
BAND_REGISTERS = 4
BANDS = REGISTERS // BAND_REGISTERS
# A pair goes on to verification unless its estimate lies so many standard deviations below the threshold.
DEVIATIONS = 5.0
# Up to so many sets of a bucket are compared one with another; larger buckets are split by the rarest shingles of their members.
BUCKET = 32
# How many of a hand's pivots a set asks, before and after large buckets are split.
ASKED = (3, 1)
# A bucket has one pivot before that, so many in the first turn after it, and in each further turn so many times more.
HANDS = 6
# Rounds in which the links of a turn are contracted.
LINK_ROUNDS = 1
# A set of more than a thousandth of all rows is frequent; there are fewer than so many.
FREQUENT = 1_000
# Shingles are counted in so many cells by the leading bits of their hashes, to order them by rarity.
CELL_BITS = 18

_WORDS = np.random.default_rng(2024).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], words: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles.

    A-Z count as a-z; words are runs without ASCII white space.  Fewer than
    ``words`` words make one shingle together; a text without words has none.
    """
    hashes, ends = word_hashes(texts)
    count = max(0, len(hashes) - words + 1)
    shingles = np.zeros(count, np.uint64)
    for i in range(words):
        shingles += hashes[i : i + count] * _WORDS[i]
    shingles = spread(shingles)
    lasts = ends.tolist()
    sets, first = [], 0
    for last in lasts:
        if last - first >= words:
            sets.append(np.unique(shingles[first : last - words + 1]))
        elif last > first:
            short = (hashes[first:last] * _WORDS[: last - first]).sum(dtype=np.uint64, keepdims=True)
            sets.append(spread(short + np.uint64(last - first)))
        else:
            sets.append(shingles[:0])
        first = last
    return sets


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (unsigned 16-bit) of sorted 64-bit hashes; the leading bits choose the bucket."""
    bits = REGISTERS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the smallest of each bucket, as the hashes are sorted
    rest = (hashes[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits, exact as a float
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    up, down = np.maximum(MANTISSA + 1 - length, 0), np.maximum(length - MANTISSA - 1, 0)
    mantissa = ((rest << up.astype(np.uint64)) >> down.astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    found = np.zeros(REGISTERS, np.uint16)
    found[bucket[first]] = (((54 - length) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)
    return found


def estimate(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of rows of registers, corrected for collisions, and the number of registers in use."""
    used = ((left != 0) | (right != 0)).sum(axis=1)
    equal = ((left == right) & (left != 0)).sum(axis=1)
    return (equal / np.maximum(used, 1) - COLLISION) / (1 - COLLISION), used


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), bands (the registers, four to a number) of (doc_id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in slices(batches, 1):
            sets = shingle_sets(texts, words)
            bands = np.concatenate([registers(one) for one in sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([len(one) for one in sets], pa.int64()),
                    pa.array([hashlib.blake2b(one.tobytes(), digest_size=16).digest() for one in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), pa.array(bands)),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return docs.mapInArrow(task, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _pair(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _may_link(left: str, right: str) -> Column:
    """Sets that share a shingle at the given places of theirs can still be linked.

    Linked sets have PERCENT / (100 + PERCENT) of both sizes together in common, and the first
    common shingle in order of rarity leaves room for the others.
    """
    both = PERCENT * (F.col(f"{left}_n") + F.col(f"{right}_n"))
    rest = [(100 + PERCENT) * (F.col(f"{side}_n") - F.col(f"{side}_place")) for side in (left, right)]
    return (rest[0] >= both) & (rest[1] >= both)


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers leave the threshold possible."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(i).flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS) for i in (2, 3)]
            similar, used = estimate(*rows)
            share = PERCENT / 100
            margin = DEVIATIONS * np.sqrt(share * (1 - share) / np.maximum(used, 1))
            yield batch.select([0, 1]).filter(pa.array(similar + margin >= share))

    left = reps.select(F.col("rep").alias("a"), F.col("bands").alias("left"))
    right = reps.select(F.col("rep").alias("b"), F.col("bands").alias("right"))
    with_bands = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return written(with_bands.mapInArrow(task, "a long, b long"), "near-candidates")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids in column ``doc_id``, one row each."""
    known = written(ids.select("doc_id").distinct(), "near-ids")
    return written(docs.join(known, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near-texts")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, left, right in slices(batches, 2):
            texts = dict(zip(a, left)) | dict(zip(b, right))
            sets = dict(zip(texts, shingle_sets(list(texts.values()), words)))
            linked = []
            for x, y in zip(a, b):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(sets[x]) + len(sets[y]) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]).filter(pa.array(linked))

    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    with_texts = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return written(with_texts.mapInArrow(task, "a long, b long"), "near-links")


def _cell_counts(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles of all texts, counted by the leading bits of their hashes; bounded by the number of cells."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for _, found in slices(batches, 1):
            hashes = np.concatenate(shingle_sets(found, words))
            counts += np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["cell", "n"])

    summed = texts.mapInArrow(task, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    summed = written(summed, "near-cells").toArrow()
    counts = np.zeros(1 << CELL_BITS, np.int64)
    counts[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return counts


def _least_common(own: int, other: int) -> int:
    """Shingles that linked sets of these sizes have in common at least."""
    return -(-PERCENT * (own + other) // (100 + PERCENT))


def _split(large: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Rows (key, rep, n, place) of new buckets for (rep, n, least): each set under its rarest shingles.

    Linked sets of sizes x and y have c = _least_common(x, y) shingles or more in
    common.  In any fixed order of all shingles, one of those is among the first x - c + 1
    of the one and the first y - c + 1 of the other.  A partner has at least ``least``
    shingles, the smallest size in the set's buckets, and no less than the threshold's share of
    the set's own.  ``place`` is the shingle's place in the order, from 0.
    With rare shingles first, sets that share no more than a common passage do not meet.
    """
    sets = large.groupBy(F.col("rep").alias("doc_id")).agg(F.min("least").alias("least"))
    texts = _texts_of(sets, docs)
    cells = docs.sparkSession.sparkContext.broadcast(_cell_counts(texts, words))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, found, leasts in slices(batches, 1):
            firsts, sizes = [], []
            for own, least in zip(shingle_sets(found, words), leasts):
                n = len(own)
                order = np.lexsort((own, cells.value[(own >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))
                partner = max(least, -(-PERCENT * n // 100))
                firsts.append(own[order[: n - _least_common(n, partner) + 1]].view(np.int64).tolist())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(firsts, pa.list_(pa.int64())),
                ],
                names=["rep", "n", "firsts"],
            )

    lists = texts.join(sets, "doc_id").select("doc_id", "text", "least")
    lists = lists.mapInArrow(task, "rep long, n long, firsts array<long>")
    rows = lists.select("rep", "n", F.posexplode("firsts").alias("place", "key")).select("key", "rep", "n", "place")
    rows = written(rows, "near-split")
    cells.destroy()
    return rows


_MEMBER = ("rep", "n", "place", "label")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two sets or more: key, rep, n, place, members, least (the smallest size), label (itself), degree.

    Buckets of the same members are one, with the first place of each: similar sets share many shingles and bands, and
    would meet in all of them.  As the order of shingles is the same for all sets, the first places are those of one bucket.
    """
    whole = F.struct(*(F.bit_xor(F.xxhash64("rep", F.lit(i))) for i in range(2)))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), whole.alias("whole"))
    shared = rows.join(sizes.filter("members > 1"), "key").groupBy("whole", "members", "rep")
    shared = shared.agg(F.min("n").alias("n"), F.min("place").alias("place"), F.min("least").alias("least"))
    key, label = F.xxhash64("whole", "members").alias("key"), F.col("rep").alias("label")
    return shared.select(key, "rep", "n", "place", "members", "least", label, F.lit(0).cast("long").alias("degree"))


def _proposals(rows: DataFrame, turn: int, hands: int, asked: int) -> DataFrame:
    """Pairs (a, b) of every set with ``asked`` pivots of each hand, if they have other labels.

    Every bucket is dealt into ``hands`` hands, and the pivot of a hand has the most links so far; among
    equals, the order is the same in all buckets, so that the bands of a group have few pivots between them.  Of the pivots of
    its buckets a set asks the first in that order, so a turn makes so many pairs for each set and hand at most; the others
    have their turn if these do not link.
    """
    hand = F.pmod(F.xxhash64(F.lit(turn), "rep"), F.lit(hands)).alias("hand")
    order = F.struct(-F.col("degree"), F.xxhash64("rep", F.lit(turn)))
    pivots = rows.groupBy("key", hand).agg(F.min(F.struct(order.alias("order"), *_MEMBER)).alias("pivot"))
    columns = [F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("order", *_MEMBER)]
    paired = rows.select("key", *(F.col(c).alias(f"own_{c}") for c in _MEMBER))
    paired = paired.join(pivots.select("key", "hand", *columns), "key").filter("own_label != pivot_label")
    grouped = paired.filter(_may_link("own", "pivot")).groupBy("own_rep", "hand")
    one = F.struct("pivot_order", "pivot_rep")
    if asked == 1:
        first = grouped.agg(F.min(one).alias("first"))
    else:
        # A set has a pivot for each of its bands at most.
        several = grouped.agg(F.slice(F.array_sort(F.collect_set(one)), 1, asked).alias("firsts"))
        first = several.select("own_rep", F.explode("firsts").alias("first"))
    return first.select(*_pair("own_rep", "first.pivot_rep"))


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a bucket but not a label."""
    left, right = (
        rows.select("key", *(F.col(c).alias(f"{side}_{c}") for c in _MEMBER))
        for side in ("left", "right")
    )
    found = left.join(right, "key").filter("left_rep < right_rep AND left_label != right_label")
    return found.filter(_may_link("left", "right")).select(F.col("left_rep").alias("a"), F.col("right_rep").alias("b"))


def _mixed(rows: DataFrame, found: Found) -> DataFrame:
    """Rows of buckets with members in different components, with their component so far as ``label`` and number of links."""
    labels = partial_labels(found.edges).join(found.degrees(), "node", "left")
    labels = written(labels.select("node", "component", "degree"), "near-labels")
    labelled = rows.drop("label", "degree").join(labels, rows.rep == labels.node, "left")
    labelled = labelled.select(
        *("key", "rep", "n", "place", "members", "least"),
        F.coalesce("component", "rep").alias("label"),
        F.coalesce("degree", F.lit(0)).cast("long").alias("degree"),
    )
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return written(labelled.join(several.filter("low != high").select("key"), "key"), "near-mixed")


class Found:
    """What the turns so far have found: pairs tested, links confirmed, and contracted links that connect the same sets."""

    def __init__(self, docs: DataFrame, words: int):
        self.docs, self.words = docs, words
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.edges: DataFrame | None = None

    def test(self, pairs: DataFrame, sketches: DataFrame | None) -> None:
        """Test those of ``pairs`` that have not been tested before; with ``sketches``, those that pass the estimate."""
        # Repeated and tested pairs are told in one grouping.
        if self.tested is not None:
            both = pairs.withColumn("old", F.lit(False)).unionByName(self.tested.withColumn("old", F.lit(True)))
            pairs = both.groupBy("a", "b").agg(F.max("old").alias("old")).filter("NOT old").drop("old")
        new = written(pairs.distinct() if self.tested is None else pairs, "near-pairs")
        links = _confirmed(_estimated(new, sketches) if sketches else new, self.docs, self.words)
        self.tested = new if self.tested is None else self.tested.unionByName(new)
        self.links = links if self.links is None else self.links.unionByName(links)
        # What turns connect is carried on as nearly one link for each set, however many a group's members have.
        self.edges = contracted(links if self.edges is None else self.edges.unionByName(links), LINK_ROUNDS)

    def degrees(self) -> DataFrame:
        """(node, degree): confirmed links of each set."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("node"))
        return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _found(reps: DataFrame, docs: DataFrame, words: int) -> Found:
    """Links that connect all representatives which any chain of links connects.

    In every bucket sets are paired with one of them, the pivot, and those that
    pass are linked.  Then up to BUCKET sets are paired with each other, where their components
    differ, and larger buckets are split by ``_split``.  There turns with ever more pivots follow
    for buckets whose sets are not yet in one component: most sets of a group find a link among few pivots and
    ask no more, so only those that link with few others meet many.  What is still of
    several components when a turn has a good part of the largest bucket as pivots is paired in full.  So no link that the
    bands found is lost.  Pairs grow with the members of a group, except those of sets
    that link with none of the others: these are compared with all that the order of shingles leaves.
    """
    bands = reps.select("rep", "n", F.posexplode("bands").alias("band", "value")).filter("value != 0")
    rows = bands.select(F.xxhash64("band", "value").alias("key"), "rep", "n", F.lit(0).alias("place"))
    found = Found(docs, words)
    for last in (False, True):
        open_rows = _mixed(_shared(rows), found) if last else written(_shared(rows), "near-shared")
        # Sets that meet in a rare shingle have passed as good a filter as the estimate.
        sketches = None if last else reps
        turn, hands = 0, HANDS if last else 1
        while True:
            found.test(_proposals(open_rows, turn, hands, ASKED[last]), sketches)
            open_rows = _mixed(open_rows, found)
            turn, hands = turn + 1, hands * HANDS
            if not last or hands * HANDS > (open_rows.agg(F.max("members")).first()[0] or 0):
                break
        found.test(_across(open_rows if last else open_rows.filter(F.col("members") <= BUCKET)), sketches)
        large = open_rows.filter(F.col("members") > BUCKET)
        if last or large.isEmpty():
            return found
        rows = _split(large, docs, words)


def _classes(known: DataFrame) -> DataFrame:
    """``known`` with ``rep``, the smallest id with the same set.

    Sets of more than a FREQUENTth of all rows are fewer than FREQUENT: their smallest ids are broadcast, so
    that their rows meet in no task.
    """
    classes = written(
        known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "near-digests"
    )
    most = (classes.agg(F.sum("size")).first()[0] or 0) // FREQUENT
    frequent = classes.filter(F.col("size") > most).filter("size > 1").select("digest", F.col("rep").alias("frequent_rep"))
    if most < 1:
        return known.join(classes.select("digest", "rep"), "digest")
    marked = known.join(F.broadcast(frequent), "digest", "left")
    often = marked.filter("frequent_rep IS NOT NULL").withColumnRenamed("frequent_rep", "rep")
    seldom = marked.filter("frequent_rep IS NULL").drop("frequent_rep").join(classes.select("digest", "rep"), "digest")
    return often.unionByName(seldom)


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id, class_links.

    Documents are linked if their sets of word shingles have a Jaccard similarity of 0.8
    or more; ``component_id`` is the smallest id reachable, and that document is kept.
    ``class_id`` is the smallest id with the same set, ``class_links`` the number of
    links of that class to others that were confirmed on the way.

    Method: equal sets form a class of which one document goes on.  Its HyperMinHash
    registers are banded, candidates from shared bands pass the collision-corrected
    estimate and are then verified on full sets (see ``_found``).  No bucket
    is ever collected.

    Cases: a null text counts as empty; sets without words link with nothing;
    rows that share an id are one document, of one of their texts if these
    differ; rows without an id have no component and are kept; an empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    if not 1 <= shingle_words <= len(_WORDS):
        raise ValueError(f"shingle_words must be from 1 to {len(_WORDS)}")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    signed = written(signatures(rows, shingle_words), "near-signatures")
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    members = written(
        _classes(known).select(
            "doc_id", "rep", F.col("n_shingles").alias("n"), F.expr("CASE WHEN doc_id = rep THEN bands END").alias("bands")
        ),
        "near-classes",
    )
    reps = members.filter("bands IS NOT NULL").select("rep", "n", "bands").dropDuplicates(["rep"])
    reps = written(reps, "near-representatives")
    found = _found(reps, rows, shingle_words)
    labels = components(found.edges).join(found.degrees().withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    labels = labels.select("node", "component", F.col("degree").alias("count"))
    nodes = members.select("doc_id", "rep").distinct().join(labels, F.col("rep") == F.col("node"), "left")
    nodes = nodes.select(
        F.col("doc_id").alias("of"), "rep", "component", F.coalesce("count", F.lit(0)).cast("long").alias("class_links")
    )
    result = signed.select("doc_id", "n_shingles").join(nodes, F.col("doc_id") == F.col("of"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links"),
    )
