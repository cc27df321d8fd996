"""Vectorised rolling hashes over the word lists of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per row) of a list<string> array; each distinct word is hashed once."""
    coded = lists.flatten().dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return (table[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)), lengths


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash of every stretch of ``width`` entries, as signed 64-bit."""
    count = max(0, len(hashes) - width + 1)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = total * _BASE + hashes[i : i + count]
    return total.view(np.int64)


def stretches(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, position in the flat array) of every stretch that lies within one row."""
    per_row = np.maximum(lengths - width + 1, 0)
    row = np.repeat(np.arange(len(lengths)), per_row)
    pos = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return row, pos, np.repeat(np.cumsum(lengths) - lengths, per_row) + pos
