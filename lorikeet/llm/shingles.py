"""Word shingles as hashes, sketches and set overlaps, whole batches at a time.

Sets travel as Arrow list columns of 64-bit hashes and are handled as one flat
array with offsets, so the Python side runs a fixed number of vector operations
per batch, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column | str) -> Column:
    """Hashes of the longest runs of letters and digits, in lower case; null for null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(found, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null([])
    off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64), off - off[0]


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def shingle_sets(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles.

    A row of fewer than k words is one shingle, an empty row has none.
    """
    size = np.diff(offsets)
    n = len(values)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    first = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    end = np.repeat(offsets[1:], count)
    acc = np.zeros(len(first), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            at = first + j
            here = at < end
            nxt = mix(acc * _PRIME + values[np.minimum(at, max(n - 1, 0))] if n else acc)
            acc = np.where(here, nxt, acc)
    order = np.lexsort((acc.view(np.int64), row))
    acc, row = acc[order], row[order]
    new = np.ones(len(acc), dtype=bool)
    new[1:] = (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])
    acc, row = acc[new], row[new]
    return acc, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(size)))))


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit keys per row, equal for equal sets: sums of independent hashes."""
    out = np.zeros((len(offsets) - 1, 2), dtype=np.uint64)
    full = np.diff(offsets) > 0
    with np.errstate(over="ignore"):
        for j, seed in enumerate((np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))):
            if full.any():
                out[full, j] = np.add.reduceat(mix(values ^ seed), offsets[:-1][full])
    return out.view(np.int64)


def parity_sketch(values: np.ndarray, offsets: np.ndarray, lanes: int) -> np.ndarray:
    """Per row ``lanes`` words of bits, each the parity of the elements hashed to it.

    Bits in which two sketches differ are at most as many as elements in which
    the two sets differ.
    """
    with np.errstate(over="ignore"):
        h = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    bit = np.uint64(1) << (h & np.uint64(63))
    lane = ((h >> np.uint64(6)) % np.uint64(lanes)).astype(np.int64)
    out = np.zeros((len(offsets) - 1, lanes), dtype=np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    np.bitwise_xor.at(out, (row, lane), bit)
    return out.view(np.int64)


def overlaps(a: pa.Array, b: pa.Array, sort: bool = False) -> np.ndarray:
    """Common elements per row of two columns of distinct lists, sorted or sorted here.

    Every element of the one list is probed in the other by binary search.  The row
    number takes the upper bits of the key, so one search serves the batch, and as
    the lists are sorted so are the probes.  50 bits of each hash decide.
    """
    (va, oa), (vb, ob) = flat(a), flat(b)
    n = len(oa) - 1
    out = np.zeros(n, dtype=np.int64)
    for lo in range(0, n, 1 << 13):
        hi = min(n, lo + (1 << 13))
        keys = []
        for v, o in ((va, oa), (vb, ob)):
            row = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(o[lo : hi + 1]))
            keys.append((row << 50) | ((v[o[lo] : o[hi]].view(np.int64) >> 14) + (1 << 49)))
        ka, kb = keys
        if sort:
            ka.sort(), kb.sort()
        if len(ka) and len(kb):
            at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
            out[lo:hi] = np.bincount(ka[kb[at] == ka] >> 50, minlength=hi - lo)
    return out
