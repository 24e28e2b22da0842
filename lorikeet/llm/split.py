"""Splitting oversized texts at natural boundaries by pointer doubling.

A text of more than ``limit`` words becomes numbered pieces of at most
``limit`` words, each repeating the last ``overlap`` words of the one before.
A piece ends at the farthest natural boundary (line end, or sentence end) that
keeps it within the limit; where there is none, at the limit itself, between
two words.

All possible cuts are joined to their successors at once: the table ``succ``
maps every boundary ``e`` to the farthest boundary in ``(e, e + limit -
overlap]``.  Squaring the table (``succ = succ[succ]``) while applying it to the
set of cuts found so far doubles the number of known cuts per round, so all
greedy cuts of all texts of an Arrow batch are found in ``log2(pieces)``
vector operations.  Every text is a row of its own: there is no shuffle on the
document, hence no skew; only oversized rows are deduplicated by key.

Edge cases: a null key or text, an empty text and a text within the limit give
no rows (they need no splitting); rows with equal key count once (smallest
text); a text without any boundary is cut at the limit; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 512, 77

#: Words whose final period ends no sentence (fixed values).
ABBREVIATIONS = frozenset("rs. no. nos. st. rd. dr. mr. mrs. ms. vs. viz. approx. inc. ltd. e.g. i.e. sec. cl. art. z.b. bzw. sr. sra. mme. tel.".split())

_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?…।。]+[\"'”’»)\]]*\Z")


def boundaries(text: str, words: list[re.Match]) -> np.ndarray:
    """Numbers of words after which a natural boundary lies, without the last."""
    out = []
    for k in range(len(words) - 1):
        a, b = words[k], words[k + 1]
        if "\n" in text[a.end() : b.start()]:
            out.append(k + 1)
            continue
        w = a.group()
        if _END.search(w) and w.lower() not in ABBREVIATIONS and not b.group()[0].islower() and not (len(w) == 2 and w[0].isupper()):
            out.append(k + 1)
    return np.array(out, dtype=np.int64)


def greedy_cuts(bounds: list[np.ndarray], sizes: list[int], limit: int, overlap: int) -> list[np.ndarray]:
    """Ends of all pieces of each text, from its boundaries and its word count."""
    step = limit - overlap
    tables, roots, base = [], [], 0
    lefts = []
    for b, n in zip(bounds, sizes):
        # Forced cuts are legal ends too: those reachable from a boundary or the
        # start without passing a natural one in reach.
        ends = _with_forced(b, n, limit, step)
        reach = np.where(ends == 0, limit, ends + step)
        succ = np.searchsorted(ends, reach, side="right") - 1
        natural = np.isin(ends, b) | (ends == n) | (ends == 0)
        last_natural = np.maximum.accumulate(np.where(natural, np.arange(len(ends)), 0))
        best = last_natural[succ]
        here = np.arange(len(ends))
        succ = np.where(best > here, best, succ)
        succ[-1] = len(ends) - 1
        tables.append(succ + base)
        roots.append(base)
        lefts.append(ends)
        base += len(ends)
    if not tables:
        return []
    jump = np.concatenate(tables)
    cut = np.zeros(base, dtype=bool)
    cut[roots] = True
    while True:
        before = int(cut.sum())
        cut[jump[np.flatnonzero(cut)]] = True
        jump = jump[jump]
        if int(cut.sum()) == before:
            break
    out, at = [], 0
    for ends in lefts:
        mine = cut[at : at + len(ends)]
        out.append(ends[mine][1:])
        at += len(ends)
    return out


def _with_forced(b: np.ndarray, n: int, limit: int, step: int) -> np.ndarray:
    """0, the boundaries, n, and the cuts forced inside stretches without any."""
    stops = np.concatenate(([0], b, [n]))
    parts = [stops]
    for left, right in zip(stops[:-1], stops[1:]):
        first = left + (limit if left == 0 else step)
        if first < right:
            parts.append(np.arange(first, right, step))
    return np.unique(np.concatenate(parts))


def _pieces(limit: int, overlap: int):
    schema = pa.schema(
        [("key", pa.string()), ("heading", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("natural_end", pa.bool_()), ("piece", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keys, heads, texts = (part.column(c).to_pylist() for c in range(3))
                found = []
                for k, h, t in zip(keys, heads, texts):
                    ws = list(_WORD.finditer(t))
                    if len(ws) > limit:
                        found.append((k, h, t, ws, boundaries(t, ws)))
                cuts = greedy_cuts([f[4] for f in found], [len(f[3]) for f in found], limit, overlap)
                rows = []
                for (k, h, t, ws, b), ends in zip(found, cuts):
                    natural = np.isin(ends, b) | (ends == len(ws))
                    for j, e in enumerate(ends.tolist()):
                        s = max(0, int(ends[j - 1]) - overlap) if j else 0
                        rows.append((k, h, j, len(ends), s, e, bool(natural[j]), t[ws[s].start() : ws[e - 1].end()]))
                cols = list(zip(*rows)) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def split_oversized(df: DataFrame, key: Column | str, text: Column | str, heading: Column | str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text of ``df`` with more than ``limit`` words.

    Result: ``key, heading, piece_no, n_pieces, start_word, end_word,
    natural_end, piece``; words are runs without white space, ``start_word``
    inclusive, ``end_word`` exclusive.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    big = (
        df.select(col(key).cast("string").alias("key"), col(text).alias("text"), col(heading).alias("heading"))
        # limit + 1 words need at least 2 * limit + 1 characters
        .where(F.col("key").isNotNull() & (F.length("text") > 2 * limit))
        .groupBy("key")
        .agg(F.min(F.struct("text", "heading")).alias("r"))
        .select("key", "r.heading", "r.text")
    )
    return big.mapInArrow(_pieces(limit, overlap), "key string, heading string, piece_no int, n_pieces int, start_word int, end_word int, natural_end boolean, piece string")
