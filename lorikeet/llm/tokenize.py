"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

1. One pass counts the pre-tokens of all texts (combined per batch, per task,
   then per key).  The most frequent ones, at most ``lexicon_size``, get their
   ids by exact merging on the executors.
2. They are compiled into a minimal acyclic transducer, written to the shared
   folder, shipped to every executor as a Spark file and memory-mapped there.
3. A second pass looks up all distinct pre-tokens of an Arrow batch at once;
   unseen ones are merged exactly.  The lexicon's size changes only the speed,
   never an id.

Null and empty texts encode to the empty list.  Strings of special tokens inside
a text are ordinary text.  Rows are independent: no shuffle of texts, no skew;
repeated rows come out repeated, an empty table empty, and clashing extra
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.transducer import Transducer, build
from lorikeet.session import shared_dir

VOCABULARY = os.environ.get("LORIKEET_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Bound of the lexicon in words; rarer words are merged where they occur.
LEXICON = 1 << 15

# The vocabulary's split pattern, with the white space of the Unicode property
# spelled out; pure ASCII texts take an equal pattern of plain classes.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def split_words(text: str) -> list[str]:
    """The pre-tokens of a text; joined they are the text."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked pair next, leftmost first."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    parts: list[bytes | None] = [word[k : k + 1] for k in range(n)]
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, size = heapq.heappop(heap)
        a = parts[k]
        if a is None or (j := nxt[k]) < 0 or len(a) + len(parts[j]) != size:  # made stale by an earlier merge
            continue
        parts[k], parts[j] = a + parts[j], None
        nxt[k] = j2 = nxt[j]
        if j2 >= 0:
            prev[j2] = k
            if (r := ranks.get(parts[k] + parts[j2])) is not None:
                heapq.heappush(heap, (r, k, size + len(parts[j2])))
        if (i := prev[k]) >= 0 and (r := ranks.get(parts[i] + parts[k])) is not None:
            heapq.heappush(heap, (r, i, len(parts[i]) + size))
    return [ranks[p] for p in parts if p is not None]


_RANKS: dict[str, dict[bytes, int]] = {}


def _ranks(path: str) -> dict[bytes, int]:
    if path not in _RANKS:
        _RANKS[path] = load_ranks(path)
    return _RANKS[path]


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all rows of a one-column table of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["word", "n"])
            c.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    c.update(split_words(t))
            if len(c) > 500_000:
                yield flush()
        yield flush()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(texts: DataFrame, vocabulary: str, size: int) -> tuple[list[bytes], list[list[int]]]:
    """The ``size`` most frequent pre-tokens of all texts with their ids; ties by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(vocabulary)
        for b in batches:
            ws = b.column(0).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([merge(w.encode(), ranks) for w in ws], pa.list_(pa.int32()))], names=["word", "ids"])

    # Words of over 64 characters gain nothing in a lexicon and would unbound its size.
    top = word_counts(texts).where("n > 1 and length(word) <= 64").orderBy(F.desc("n"), "word").limit(size).select("word")
    rows = top.mapInArrow(run, "word string, ids array<int>").collect()
    return [r.word.encode() for r in rows], [list(r.ids) for r in rows]


def ship(spark: SparkSession, data: bytes) -> str:
    """Write bytes to the shared folder and register them as a Spark file; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


class _Encoder:
    """Per-worker state: the mapped transducer and the words met so far."""

    MOST = 200_000

    def __init__(self, lexicon: str, vocabulary: str) -> None:
        self.machine = Transducer(SparkFiles.get(lexicon))
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.lists: list[list[int]] = []

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        words = [split_words(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(words)) - self.index.keys())
        if len(self.index) + len(new) > self.MOST:
            self.reset()
            new = list(set(chain.from_iterable(words)))
        raw = [w.encode() for w in new]
        for w, b, k in zip(new, raw, self.machine.lookup(raw).tolist()):
            self.index[w] = len(self.lists)
            self.lists.append(self.machine.ids_of(k) if k >= 0 else merge(b, _ranks(self.vocabulary)))
        if new:
            self.size = np.fromiter(map(len, self.lists), dtype=np.int64, count=len(self.lists))
            self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
            self.flat = np.fromiter(chain.from_iterable(self.lists), dtype=np.int32, count=int(self.size.sum()))
        n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        total = int(n_words.sum())
        if not total:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, dtype=np.int32)), pa.array([], pa.int32()))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=total)
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        values = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1])]
        word_ends = np.concatenate(([0], np.cumsum(n_words)))
        offsets = np.concatenate(([0], ends))[word_ends]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def encode(df: DataFrame, key: Column | str, text: Column | str, vocabulary: str = VOCABULARY, lexicon_size: int = LEXICON) -> DataFrame:
    """``key, ids`` for every row of ``df``, in no particular order."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(key).alias("key"), col(text).alias("text"))
    lexicon = ship(df.sparkSession, build(*frequent(rows.select("text"), vocabulary, lexicon_size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _Encoder(lexicon, vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield pa.record_batch([part.column(0), enc.encode(part.column(1).to_pylist())], names=["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>")
