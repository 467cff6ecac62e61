"""Whole-column text primitives over Arrow batches, shared by the Python operators.

Batches are worked off in slices of a few MB of text, so memory does not
depend on how many rows Spark puts into a batch; one very long text makes a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch with about ``limit`` bytes of text each."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as text without nulls (null: empty)."""
    return pc.fill_null(batch.column(name), "")


def hash_strings(values: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    if len(values) == 0:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class Words:
    """The words (runs of non-white-space, ASCII white space only) of some texts.

    ids: for each word its number in ``unique``; doc: for each word its text's
    number; start: the first word of each text, and the end of the last.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if lower:
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        doc = pc.list_parent_indices(split).to_numpy()
        full = pc.greater(pc.binary_length(flat), 0)
        if not pc.all(full).as_py():
            doc = doc[full.to_numpy(zero_copy_only=False)]
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        self.unique: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy()
        self.doc = doc
        self.start = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.counts = np.diff(self.start)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``size``-word shingles.

    A text with fewer words has one shingle, the whole sequence; without words, none.
    """
    h = hash_strings(words.unique)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    n = len(h)
    out = []
    if n >= size:
        acc = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k] + np.uint64(k + 1))
    for a, b in zip(words.start[:-1], words.start[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(acc[a : b - size + 1]))
        elif b > a:
            x = np.uint64(1000 + b - a)
            for v in h[a:b]:
                x = mix64(np.array([x], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs that Spark keeps."""
    return values.view(np.int64)
