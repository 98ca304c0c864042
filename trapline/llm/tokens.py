"""Word-piece counts of whole texts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import slices

# Words whose count a Python worker remembers.
CACHED_WORDS = 1_000_000


class LongestMatch:
    """Greedy longest-match piece counts in one pass over the bytes of a word.

    The pieces form a trie.  Each node has a failure link: where the automaton
    goes when the next byte does not fit, after it has popped the pieces that
    greedy matching would have taken by then.  Only their number is kept, so a
    word is counted without building a piece.
    """

    def __init__(self, pieces: Iterable[bytes]):
        goto: dict[int, int] = {}  # node * 256 + byte -> node
        is_piece = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                step = node << 8 | byte
                if step not in goto:
                    goto[step] = len(is_piece)
                    is_piece.append(False)
                node = goto[step]
            is_piece[node] = bool(piece)
        self._goto = goto
        # -1: no failure link, greedy matching cannot go on from here.
        fail, popped = [-1] * len(is_piece), [0] * len(is_piece)
        # Nodes are numbered along the pieces, so a parent precedes its children,
        # but a link may lead to a node of any number: go by depth.
        by_depth = [[0]]
        children: list[list[tuple[int, int]]] = [[] for _ in is_piece]
        for step, node in goto.items():
            children[step >> 8].append((step & 255, node))
        while by_depth[-1]:
            by_depth.append([node for parent in by_depth[-1] for _, node in children[parent]])
        for level in by_depth:
            for parent in level:
                for byte, node in children[parent]:
                    if is_piece[node]:
                        fail[node], popped[node] = 0, 1
                        continue
                    link, count = fail[parent], popped[parent]
                    while link >= 0 and (link << 8 | byte) not in goto:
                        link, count = fail[link], count + popped[link]
                    if link >= 0:
                        fail[node], popped[node] = goto[link << 8 | byte], count
        self._fail, self._popped = fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1, for an unknown word, if greedy matching gets stuck."""
        goto, fail, popped = self._goto, self._fail, self._popped
        node = total = 0
        for byte in word:
            step = goto.get(node << 8 | byte)
            while step is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                step = goto.get(node << 8 | byte)
            node = step
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total if node == 0 else 1


def rank_file_pieces(lines: Iterable[bytes]) -> list[bytes]:
    """Pieces of a rank file: base64 of the piece, a space, its rank."""
    return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@lru_cache(maxsize=2)
def _automaton(path: str) -> LongestMatch:
    with open(path, "rb") as lines:
        return LongestMatch(rank_file_pieces(lines))


def token_counts(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", marker: bytes = b" "
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, n_words, n_tokens (long).

    Words are runs without ASCII white space; each is matched as ``marker`` and
    the word, as the vocabulary writes the start of a word, by greedy
    longest-match-first over bytes.  Where no piece fits, the word counts as one
    unknown token.  The file is read once per Python worker from the path that
    all machines have.

    Cases: a null text counts as empty, and an empty text has no tokens; a very
    long word takes time in proportion to its length; rows that share an id are
    counted each for itself; a null id stays null; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(ranks_path)
        known: dict[bytes, int] = {}
        for doc_ids, texts, chars in slices(batches, 1):
            split = [text.encode().split() for text in texts]
            if len(known) > CACHED_WORDS:
                known = {}
            for word in set().union(*split).difference(known):
                known[word] = automaton.count(marker + word)
            counts = [sum([known[word] for word in words]) for words in split]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (doc_ids, chars, map(len, split), counts)],
                names=["doc_id", "n_chars", "n_words", "n_tokens"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("chars")
    ).mapInArrow(task, "doc_id long, n_chars long, n_words long, n_tokens long")
