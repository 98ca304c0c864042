"""Packing of tokenised documents into windows of fixed length by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import slices
from trapline.llm.vocabulary import word_tokenizer

WINDOW = 4096
# Token that ends every document.
END = 2
# Pieces are sorted and placed in blocks of about so many tokens.
BLOCK_TOKENS = 1 << 21

# Characters encoded together; new words are cheaper in larger numbers.
SLICE_CHARS = 1 << 20

# A task numbers its sequences from its partition number times this.
_NUMBERS = 1 << 33

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class OpenWindows:
    """Windows with room left, found by a segment tree indexed by remaining capacity."""

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.next = window, first
        self._size = 1 << (window + 1).bit_length()
        self._open = [0] * (2 * self._size)  # node: number of open windows in its range of capacities
        self._windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, capacity: int, change: int) -> None:
        node = capacity + self._size
        while node:
            self._open[node] += change
            node >>= 1

    def _tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least ``length``; 0 if no window has that much."""
        tree, node = self._open, length + self._size
        if tree[node]:
            return length
        while node > 1:  # up to the first right neighbour that holds a window
            if not node & 1 and tree[node + 1]:
                node += 1
                break
            node >>= 1
        if node <= 1:
            return 0
        while node < self._size:  # down to its leftmost window
            node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self._size

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``length`` tokens, at most a window."""
        room = self._tightest(length)
        if room:
            sequence = self._windows[room].pop()
            self._count(room, -1)
        else:
            room, sequence = self.window, self.next
            self.next += 1
        if room > length:
            self._windows[room - length].append(sequence)
            self._count(room - length, 1)
        return sequence, self.window - room


def _placed(block: list[tuple[int, np.ndarray]], windows: OpenWindows) -> pa.RecordBatch:
    """Cut and place the documents of one block."""
    pieces = []
    for doc_id, ids in block:
        for start in range(0, len(ids), windows.window):
            pieces.append((doc_id, start, ids[start : start + windows.window], len(ids)))
    pieces.sort(key=lambda piece: -len(piece[2]))  # stable: equal lengths keep their order
    rows = [
        (doc_id, start, len(ids), ids.tobytes(), total, *windows.place(len(ids)))
        for doc_id, start, ids, total in pieces
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _PIECES)], schema=_PIECES
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end: int = END,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    The file must be of a tokenizer that drops white space (see ``WordTokenizer``).
    Every document gets the token ``end``.  Documents longer than a window are
    cut into full windows and a remainder; then the pieces of a block, longest
    first, go each to the tightest open window of the task, and a new one is
    opened only if none has room.  Windows stay open from block to block, so
    padding is what best-fit leaves over a whole task.  No token is shuffled: a
    task packs what it reads, and numbers its sequences after its partition, so
    that a repeated task gives the same rows.

    Cases: a null text counts as empty and gives the end token alone; rows that
    share an id are packed each for itself; a null id stays null; an empty table
    gives no rows.  Other columns of ``docs`` are not read.
    """
    if not 1 <= window < 1 << 20:
        raise ValueError("window must be from 1 to 2^20 - 1 tokens")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        windows = OpenWindows(window, TaskContext.get().partitionId() * _NUMBERS)
        last = np.array([end], "<u4")
        block, tokens = [], 0
        for doc_ids, texts in slices(batches, 1, SLICE_CHARS):
            for doc_id, ids in zip(doc_ids, tokenizer.encode(texts)):
                block.append((doc_id, np.concatenate([ids, last])))
                tokens += len(ids) + 1
            if tokens >= block_tokens:
                yield _placed(block, windows)
                block, tokens = [], 0
        if block:
            yield _placed(block, windows)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).mapInArrow(
        task,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
