"""Five-word shingles of whole texts: all of them by place, and each text's set as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER, mix64, per_row, text_blocks, words
from .prefix_hash import PrefixHash

WIDTH = 5


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word; A-Z are lower-cased."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    return starts, ends, row, mix64(PrefixHash(data).spans(starts, ends))


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, rows: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, where each row's shingles begin) of all shingles in order; a row with fewer words than ``width`` has one, all its words."""
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    many = np.maximum(counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    at_word = np.repeat(first[:-1] - begin[:-1], many) + np.arange(begin[-1])
    span = np.minimum(np.repeat(counts, many), width)
    out = np.zeros(begin[-1], np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for t in range(width):
        out = np.where(span > t, (out ^ padded[at_word + t]) * np.uint64(0x9E3779B97F4A7C15) + (out >> np.uint64(23)), out)
    return mix64(out + span.astype(np.uint64)), at_word, begin


def shingle_sets(column: pa.Array, width: int = WIDTH, limit: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, offsets): each row's distinct shingles, sorted.

    A-Z are lower-cased. A row with fewer words than ``width`` has one shingle, all its words; a
    row without words has none.
    """
    for at, to, data, offsets in text_blocks(column, limit):
        _, _, row, hashes = word_hashes(data, offsets)
        out, _, begin = shingle_hashes(hashes, row, to - at, width)
        for s, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if e - s > 1:
                out[s:e].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[begin[:-1][np.diff(begin) > 0]] = True
        size = per_row(new, begin)
        yield at, to, out[new], np.concatenate([[0], np.cumsum(size)])
