"""The manifest against a plain Merkle tree."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trapline.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, at long, block string, root string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    texts = [None if field is None else str(field) for field in row]
    return digest(*("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def tree(nodes):
    """Root, and for each node its siblings on the way, level by level."""
    ways, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, under = [], []
        for start in range(0, len(nodes), 16):
            run = nodes[start : start + 16]
            for place in range(len(run)):
                for i in below[start + place]:
                    ways[i].append((run[:place], run[place + 1 :]))
            parents.append(digest(*run))
            under.append([i for part in below[start : start + 16] for i in part])
        nodes, below = parents, under
    return nodes[0], ways


def plain(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for name in names:
        ordered = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[name] = ordered, *tree([leaf(r) for r in ordered])
    root, outer = tree([inner[name][1] for name in names])
    found = []
    for name, above in zip(names, outer):
        ordered, subroot, ways = inner[name]
        for row, way in zip(ordered, ways):
            way = way + above
            proof = "".join("".join(left) + "".join(right) for left, right in way)
            found.append((row[0], leaf(row), subroot, root, proof, [len(a) for a, _ in way], [len(b) for _, b in way]))
    return sorted(map(str, found))


def compare(spark, rows):
    frame = spark.createDataFrame([(*row, "t", "n", 7, "b", "r") for row in rows], DOCS)
    found = merkle.manifest(frame).select("doc_id", "leaf", "subroot", "root", "proof", "before", "after").collect()
    assert sorted(str(tuple(r)) for r in found) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 300])
def test_subtrees_grow_as_a_plain_tree(n):
    nodes = [digest(str(i)) for i in range(n)]
    grown = merkle.Subtrees()
    for node in nodes:
        grown.append(node)
    root, ways = tree(nodes)
    assert grown.close() == root
    for witness, way in zip(grown.witnesses, ways):
        assert witness == [("".join(a + b), len(a), len(b)) for a, b in way]


def test_a_block_has_the_height_asked_for():
    grown = merkle.Subtrees()
    grown.append("x")
    assert grown.close(2) == digest(digest("x"))


def test_many_blocks_and_sources(spark):
    rows = [(i, "hot", "en", i, f"text {i}") for i in range(4400)]
    rows += [(i, f"s{i % 40}", None, None, "é" * (i % 5)) for i in range(300)]
    compare(spark, rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (1, "", "en", 1, "a"), (1, "", "en", 1, "b"), (1, "", "en", 1, "b")]
    rows += [(5, "é", "x", 9, "long " * 200_000), (-3, "é", "x", 9, "日本"), (None, "é", "x", 9, "no id"), (2, "z", None, 1, "-")]
    compare(spark, rows)
    frame = spark.createDataFrame([], DOCS)
    assert merkle.folded(merkle.manifest(frame)).collect() == []


def test_a_changed_leaf_leads_elsewhere(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(700)]
    frame = spark.createDataFrame([(*row, "t", "n", 7, "b", "r") for row in rows], DOCS)
    other = merkle.leaf(*(F.lower(name) if name == "text" else F.col(name) for name in merkle.FIELDS))
    checked = merkle.folded(merkle.manifest(frame, presented=other), "presented", "claimed")
    assert {(r.leaf == r.presented, r.claimed == r.root) for r in checked.collect()} == {(False, False)}
    kept = merkle.folded(merkle.manifest(frame))
    assert kept.filter("folded_root != root").count() == 0
