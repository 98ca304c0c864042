"""Hashes of words, for whole slices of texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_draw = np.random.default_rng(2024)
_BYTES = _draw.integers(1, 1 << 63, 256, np.uint64)
_BASE = 0xD6E8FEB86659FD93
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FORWARD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_BACKWARD = tuple(pow(factor, -1, 1 << 64) for factor in _FORWARD)
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def spread(values: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(_FORWARD[0])
    values = (values ^ (values >> np.uint64(27))) * np.uint64(_FORWARD[1])
    return values ^ (values >> np.uint64(31))


def gathered(values: np.ndarray) -> np.ndarray:
    """What ``spread`` made the values from."""
    values = (values ^ (values >> np.uint64(31)) ^ (values >> np.uint64(62))) * np.uint64(_BACKWARD[1])
    values = (values ^ (values >> np.uint64(27)) ^ (values >> np.uint64(54))) * np.uint64(_BACKWARD[0])
    return values ^ (values >> np.uint64(30)) ^ (values >> np.uint64(60))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in turn, and how many words there are up to the end of each text.

    A-Z count as a-z; words are runs without ASCII white space.
    """
    raw = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    codes = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[codes], prepend=True))
    begins, ends = edges[0::2], edges[1::2]
    # A word's hash is a polynomial in its bytes, taken as a difference of running sums.
    powers, inverse = _powers_to(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[codes] * powers[: len(codes)], dtype=np.uint64)])
    hashes = spread((sums[ends] - sums[begins]) * inverse[begins])
    text_ends = np.cumsum([len(text) + 1 for text in raw])
    return hashes, np.searchsorted(begins, text_ends)
