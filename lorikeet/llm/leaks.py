"""Test passages inside a training corpus: BM25 with block-max bounds, then proof.

The held-out passages are the indexed side.  For every term and passage the
index holds a BM25 weight, divided by that passage's own threshold: the smallest
score that any ``run`` consecutive words of the passage reach.  A corpus window
that repeats ``run`` words of a passage therefore scores at least 1 for it, so
retrieving all passages above 1 loses nothing.

Every window of ``run`` consecutive words of every document is a query:

1. the sum of its terms' largest weights over all passages bounds any score;
   windows under 1, or with a word no passage has, are dropped (a difference of
   running sums, no loop over windows);
2. for the rest, the largest weights per block of passages bound the score in
   each block, as in block-max WAND; only blocks that reach 1 are scored;
3. passages scoring 1 or more are verified: the window's words must stand
   consecutively in the passage.

The corpus is scanned once and never shuffled; only found pairs are.  Passages
are indexed in blocks of at most ``MAX_ITEMS``, and at most ``BLOCKS`` blocks are
sent to a task, which brings every text to words once and searches block after
block.  A test set beyond that takes another scan.

Both texts are brought to NFKC, characters of category Cf are dropped, and words
are longest runs of letters and digits in lower case.  Null and empty texts
match nothing; passages shorter than ``run`` words cannot leak; repeated rows
give one pair; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN, MAX_ITEMS, BLOCK, BLOCKS = 12, 512, 16, 16
K1, B = 1.2, 0.75
_EPS = 1e-6

_WORDS = re.compile(r"[^\W_]+")
_FORMAT = regex.compile(r"\p{Cf}+")


def normal_words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORDS.findall(text.lower())


class PassageIndex:
    """BM25 weights of passages, scaled by each passage's threshold, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, block: int = BLOCK) -> None:
        self.run, self.block = run, block
        docs = [(i, w) for i, t in sorted(set(items)) if len(w := normal_words(t)) >= run]
        self.items = np.array([i for i, _ in docs], dtype=np.int64)
        self.term: dict[str, int] = {}
        for _, ws in docs:
            for w in ws:
                self.term.setdefault(w, len(self.term))
        n = len(docs)
        df = Counter(t for _, ws in docs for t in set(ws))
        mean = sum(len(ws) for _, ws in docs) / max(1, n)
        # One row more than terms, all zero: words that no passage has.
        weight = np.zeros((len(self.term) + 1, n), dtype=np.float32)
        self.grams: dict[bytes, list[int]] = {}
        for k, (_, ws) in enumerate(docs):
            for w, f in Counter(ws).items():
                idf = np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                weight[self.term[w], k] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean))
            ids = np.array([self.term[w] for w in ws], dtype=np.int32)
            low = np.inf
            for j in range(len(ids) - run + 1):
                g = ids[j : j + run]
                low = min(low, float(weight[np.unique(g), k].sum()))
                own = self.grams.setdefault(g.tobytes(), [])
                if not own or own[-1] != k:
                    own.append(k)
            weight[:, k] /= low
        self.weight = weight
        self.most = weight.max(axis=1, initial=0)
        starts = np.arange(0, n, block)
        self.block_most = np.maximum.reduceat(weight, starts, axis=1) if n else weight

    def search(self, words: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(text number, passage number, first word position, windows) of all leaks."""
        run, none = self.run, len(self.term)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        total = int(sizes.sum())
        if total < run or not len(self.items):
            return []
        get = self.term.get
        ids = np.fromiter((get(w, none) for w in chain.from_iterable(words)), dtype=np.int32, count=total)
        bound = np.concatenate(([0.0], np.cumsum(self.most[ids], dtype=np.float64)))
        unknown = np.concatenate(([0], np.cumsum(ids == none)))
        ends = np.cumsum(sizes)
        start = np.flatnonzero((unknown[run:] == unknown[:-run]) & (bound[run:] - bound[:-run] >= 1 - _EPS))
        text = np.searchsorted(ends, start, side="right")
        inside = start + run <= ends[text]
        start, text = start[inside], text[inside]
        found: dict[tuple[int, int], list[int]] = {}
        for lo in range(0, len(start), 4096):
            at, own = start[lo : lo + 4096], text[lo : lo + 4096]
            win = ids[at[:, None] + np.arange(run)]
            win.sort(axis=1)
            win[:, 1:][win[:, 1:] == win[:, :-1]] = none  # every term counts once
            hot = np.argwhere(self.block_most[win].sum(axis=1) >= 1 - _EPS)
            if not len(hot):
                continue
            for b in np.unique(hot[:, 1]):
                rows = hot[hot[:, 1] == b, 0]
                score = self.weight[:, b * self.block : (b + 1) * self.block][win[rows]].sum(axis=1)
                for r, k in np.argwhere(score >= 1 - _EPS):
                    p, j = int(at[rows[r]]), int(b * self.block + k)
                    if j in self.grams.get(ids[p : p + run].tobytes(), ()):
                        t = int(own[rows[r]])
                        hit = found.setdefault((t, j), [p - int(ends[t] - sizes[t]), 0])
                        hit[0] = min(hit[0], p - int(ends[t] - sizes[t]))
                        hit[1] += 1
        return [(t, j, p, n) for (t, j), (p, n) in found.items()]


def find_leaks(docs: DataFrame, doc: Column | str, text: Column | str, items: DataFrame, item: Column | str, passage: Column | str, run: int = RUN) -> DataFrame:
    """``doc_id, item_id, first_word, n_windows`` of every document and leaked item."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    spark = docs.sparkSession
    rows = docs.select(col(doc).cast("bigint").alias("doc_id"), col(text).alias("text")).where("doc_id is not null and text is not null")
    tests = items.select(col(item).cast("bigint").alias("item_id"), col(passage).alias("passage")).where("item_id is not null and passage is not null").distinct()
    schema = "doc_id bigint, item_id bigint, first_word int, n_windows int"
    scans = max(1, -(-tests.count() // (MAX_ITEMS * BLOCKS)))
    result = None
    for k in range(scans):
        part = tests if scans == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == k)
        own = [(r.item_id, r.passage) for r in part.collect()]
        indexes = [PassageIndex(own[lo : lo + MAX_ITEMS], run) for lo in range(0, len(own), MAX_ITEMS)]
        held = spark.sparkContext.broadcast(indexes)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 250):
                    ids = b.column(0).slice(lo, 250).to_pylist()
                    words = [normal_words(t) for t in b.column(1).slice(lo, 250).to_pylist()]
                    hits = [(ids[t], int(ix.items[j]), p, n) for ix in held.value for t, j, p, n in ix.search(words)]
                    cols = list(zip(*hits)) if hits else [[]] * 4
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "first_word", "n_windows"])

        found = rows.mapInArrow(search, schema)
        result = found if result is None else result.unionByName(found)
    return result.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("n_windows").alias("n_windows"))
