"""Merkle manifest of a dataset: one witness per row, grown while blocks of rows are appended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.shared import written

# Nodes that become one node of the next level.
ARITY = 16
# Levels of a block; blocks are appended in one task, and their roots are the nodes of a further append.
LEVELS = 2
BLOCK = ARITY**LEVELS
# Fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_WITNESS = "proof string, before array<int>, after array<int>"
_DIGEST = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields in turn, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [field.cast("string") for field in fields]
    sized = [F.concat(F.octet_length(text).cast("string"), F.lit(":"), text) for text in texts]
    return F.sha2(F.concat(*(F.coalesce(one, F.lit("-")) for one in sized)), 256)


class Subtrees:
    """Subtrees that still wait for siblings, with the partial witnesses of the leaves below them.

    A leaf is appended with an empty witness.  Whenever a run of siblings is complete, every leaf below gets
    the digests of the siblings of its subtree, and how many stand before and after it, and the run becomes
    one subtree of the next level.  So all witnesses are complete when the root is.
    """

    def __init__(self):
        self.open: list[list[tuple[str, list[int]]]] = [[]]
        self.witnesses: list[list[tuple[str, int, int]]] = []

    def append(self, node: str) -> None:
        self.open[0].append((node, [len(self.witnesses)]))
        self.witnesses.append([])
        level = 0
        while len(self.open[level]) == ARITY:
            self._join(level)
            level += 1

    def _join(self, level: int) -> None:
        run = self.open[level]
        nodes = [node for node, _ in run]
        for place, (_, below) in enumerate(run):
            siblings = "".join(nodes[:place] + nodes[place + 1 :])
            for at in below:
                self.witnesses[at].append((siblings, place, len(nodes) - 1 - place))
        if level + 1 == len(self.open):
            self.open.append([])
        self.open[level + 1].append((digest("".join(nodes)), [at for _, below in run for at in below]))
        run.clear()

    def close(self, height: int | None = None) -> str:
        """The root: of the given height, or of the least height at which one node remains."""
        level = 0
        while True:
            run = self.open[level]
            alone = len(run) == 1 and not any(self.open[level + 1 :])
            if alone if height is None else level == height:
                return run[0][0]
            if run:
                self._join(level)
            level += 1


def _appended(nodes: pa.Table) -> tuple[pa.Table, Subtrees, str]:
    """The nodes of a block in order, appended: with their witnesses and the block's root."""
    nodes = nodes.sort_by("at")
    trees = Subtrees()
    for node in nodes["node"].to_pylist():
        trees.append(node)
    # The only block of a tree ends where one node remains; others all have the same height.
    return nodes, trees, trees.close(None if nodes["n"][0].as_py() <= BLOCK else LEVELS)


def _roots(nodes: DataFrame) -> DataFrame:
    """(tree, at, n, node) of the next level: one node per block of (tree, at, n, node), n nodes in all."""

    def block(rows: pa.Table) -> pa.Table:
        tree, at, n = (rows[name][0].as_py() for name in ("tree", "at", "n"))
        return pa.table({"tree": [tree], "at": [at // BLOCK], "n": [-(-n // BLOCK)], "node": [_appended(rows)[2]]})

    grouped = nodes.select("tree", "at", "n", "node", _block().alias("block")).groupBy("tree", "block")
    return written(grouped.applyInArrow(block, "tree string, at long, n long, node string"), "merkle-roots")


def _block() -> Column:
    return F.expr(f"at div {BLOCK}")


def _extended(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """All columns of ``nodes`` and their witnesses: those within the block, extended by that of the block's root.

    ``upper`` has one row per block: tree, block, proof, before, after, subroot, root.
    """
    kept = [name for name in nodes.columns if name not in ("n", "block")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema if f.name in kept)

    def block(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, trees, _ = _appended(rows)
        top = above.to_pylist()[0]
        proofs, before, after = [], [], []
        for witness in trees.witnesses:
            proofs.append("".join(siblings for siblings, _, _ in witness) + top["proof"])
            before.append([n for _, n, _ in witness] + top["before"])
            after.append([n for _, _, n in witness] + top["after"])
        found = {name: rows[name] for name in kept}
        counts = pa.list_(pa.int32())
        found |= {"proof": pa.array(proofs), "before": pa.array(before, counts), "after": pa.array(after, counts)}
        for name in ("subroot", "root"):
            found[name] = pa.array([top[name]] * len(rows), pa.string())
        return pa.table(found)

    own = nodes.withColumn("block", _block()).groupBy("tree", "block")
    paired = own.cogroup(upper.groupBy("tree", "block"))
    return paired.applyInArrow(block, f"{schema}, {_WITNESS}, subroot string, root string")


def _numbered(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``nodes`` with ``at``, the place in its ``tree`` by ``order`` from 0, and ``n``, the tree's nodes.

    Rows are dealt by ranges and sorted there; a row's place is its place in the range, and the rows of
    its tree in earlier ranges, of which there are no more than ranges.  No tree is gathered.
    """
    keys = ["tree", *order]
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33).alias("part")
    runs = ranged.groupBy("tree", part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("tree").alias("run_tree"),
        F.col("part").alias("run_part"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    found = ranged.withColumn("part", part)
    found = found.join(runs, (F.col("tree") == F.col("run_tree")) & (F.col("part") == F.col("run_part")))
    return found.select(*nodes.columns, (F.col("place") + F.col("shift")).alias("at"), "n")


def _witnessed(nodes: DataFrame, joined: bool = False) -> DataFrame:
    """Columns of ``nodes`` (tree, at, n, node, ...) with proof, before, after, subroot, root.

    Upwards, blocks of every tree are appended and their roots are the nodes of the next level.  The roots of
    all trees are then the nodes of one tree, unless ``joined``, where the tree's root is the whole's.  Downwards, the
    witness of a block's root extends those of the block.
    """
    levels, finished = [nodes], []
    while True:
        roots = _roots(levels[-1])
        finished.append(roots.filter("n = 1").select("tree", "node", F.lit(len(levels) - 1).alias("level")))
        higher = roots.filter("n > 1")
        if higher.isEmpty():
            break
        levels.append(higher)
    subroots = finished[0]
    for more in finished[1:]:
        subroots = subroots.unionByName(more)
    if joined:
        none = F.array().cast("array<int>")
        tops = subroots.select("*", F.lit("").alias("proof"), none.alias("before"), none.alias("after"))
        tops = tops.withColumns({"subroot": F.col("node"), "root": F.col("node")})
    else:
        named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node", "level")
        numbered = _numbered(named, ["name"], "merkle-subroots")
        tops = written(_witnessed(numbered, joined=True), "merkle-tops")
        tops = tops.withColumns({"tree": F.col("name"), "subroot": F.col("node")})
    columns = ["tree", "block", "proof", "before", "after", "subroot", "root"]
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    found = None
    for level in reversed(range(len(levels))):
        upper = tops.filter(F.col("level") == level).select(columns)
        if found is not None:
            upper = upper.unionByName(written(found.withColumn("block", F.col("at")).select(columns), "merkle-witnesses"))
        found = _extended(levels[level], upper)
    return found


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    fields: Sequence[str] = FIELDS,
    presented: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, presented, subroot, root, proof, before, after.

    The leaves of a source, by ascending id, are joined in runs of 16 until one node remains, the
    source's subroot; the subroots, by source, are joined likewise into the root.  A proof
    is the digests of the siblings on the way from leaf to root as one text, and ``before`` and ``after``
    say, level by level, how many of them stand on either side.  ``presented`` is the given expression over ``docs``, null
    without one: a leaf that somebody claims, which ``folded`` can check.

    Leaves get their places by a sort by ranges, blocks of 256 are appended each in a task, and
    block roots are appended in turn, so no more than 256 nodes meet anywhere, whatever a source's share.

    Cases: a null field is ``-``; a null id comes first in its source and a null source first of all; rows that share an id
    are leaves each, ordered by digest; a repeated row is a leaf of its own; very long texts count whole; an
    empty table gives no rows.  Columns that are not named are not read, whatever their names.
    """
    source = F.col(source_col).cast("string")
    leaves = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("tree"),
        leaf(*(F.col(name) for name in fields)).alias("node"),
        (F.lit(None).cast("string") if presented is None else presented).alias("presented"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = _numbered(written(leaves, "merkle-leaves"), ["doc_id", "node", "row"], "merkle-sorted")
    found = _witnessed(leaves.drop("row"))
    return found.select(
        *("doc_id", "source", F.col("node").alias("leaf"), "presented", "subroot", "root", "proof", "before", "after")
    )


def folded(witnesses: DataFrame, leaf_col: str = "leaf", name: str = "folded_root") -> DataFrame:
    """``witnesses`` without proof, before and after, with ``name``: the root that the leaf in ``leaf_col`` leads to."""
    kept = [column for column in witnesses.columns if column not in ("proof", "before", "after")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in witnesses.schema if f.name in kept)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for node, proof, *counts in zip(*(batch[c].to_pylist() for c in (leaf_col, "proof", "before", "after"))):
                at = 0
                for before, after in zip(*counts):
                    middle, end = at + _DIGEST * before, at + _DIGEST * (before + after)
                    node = digest(proof[at:middle] + node + proof[middle:end])
                    at = end
                roots.append(node)
            columns = [batch[column] for column in kept] + [pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    return witnesses.mapInArrow(task, f"{schema}, {name} string")
