"""Personal items in free text by a skip-chain conditional random field.

The features of a token depend on the token alone and on single neighbours, so
the scores of all distinct tokens of a batch are computed once and gathered for
all positions by vector operations.  Every line is a chain over all its tokens.
Within one text, consecutive occurrences of an uncommon word, and of two uncommon
words one edit apart, are joined by skip edges with learned potentials; loopy
message passing lets them agree on being part of an item before the chains are
decoded.  Chains and messages of a whole batch run in step, as vector operations.

Rows are independent: no shuffle, no skew.  Null and empty texts have no items;
repeated rows repeat their items (callers take distinct rows); an empty table
gives none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.llm import crf
from lorikeet.llm.pii_tokens import AROUND, LABELS, context_features, iterate, kind_of, strings, token_features

MODEL = Path(__file__).with_name("pii_model.json")
_KIND_OF = ["", *(x[2:] for x in LABELS[1:])]
#: What a skip edge joins, and the kinds of item it lets agree: one learned weight each.
SKIPS, AGREEING = ("same", "like"), ("name", "address")
#: Shortest words that are joined, and that are joined to others one edit apart.
LEAST, LEAST_LIKE = 3, 5
_SIGNS = " \t\r\n,.;:!?()[]{}<>\"'*|/\\_-–—•·#&"
#: Texts handled together.
BATCH = 250


def agreement(weights: dict[str, dict[str, float]]) -> np.ndarray:
    """Log potentials of the two labels at the ends of a skip edge, by what it joins."""
    same = {k: np.array([[a == b == k for b in _KIND_OF] for a in _KIND_OF], dtype=np.float64) for k in AGREEING}
    return np.stack([sum(weights[s][k] * same[k] for k in AGREEING) for s in SKIPS])


def whole_name(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """A name from its first to its last part: no sign at its ends; nothing with a digit is one."""
    name = text[start:end]
    start += len(name) - len(name.lstrip(_SIGNS))
    end -= len(name) - len(name.rstrip(_SIGNS))
    return (start, end, kind) if start < end and not any(map(str.isdigit, name)) else None


def shortened(w: str) -> list[str]:
    """The word, and the word without each of its letters: two words one edit apart share one of these."""
    return [w, *{w[:i] + w[i + 1 :] for i in range(len(w))}]


class Tagger:
    """The model with the scores of the tokens met so far."""

    MOST = 200_000

    def __init__(self, model: dict | None = None, skips: bool = True) -> None:
        m = model or json.loads(MODEL.read_text())
        self.known = set(m["known"])
        self.weights = {k: np.array(v) for k, v in m["weights"].items()}
        self.trans, self.start = np.array(m["trans"]), np.array(m["start"])
        self.zero = np.zeros(len(LABELS))
        into = np.concatenate([self.trans - self.trans[0, 0], self.start[None] - self.start[0]]).max(axis=0)
        #: Most that a step into each label but O, and the step back to O, can add.
        self.gain = np.maximum(into[1:], 0) + max(into[0], 0)
        self.agree = agreement(m["skips"]) if skips else None
        self.edge = np.stack([self.weights.get(f"{o}edge", self.zero) for o in AROUND]).astype(np.float32)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {"\n": 0}
        self.scores: list[np.ndarray] = []
        self.table = np.zeros((1, 1 + len(AROUND), len(LABELS)), dtype=np.float32)
        #: Number of each uncommon word among those joined by skip edges, or -1.
        self.word = np.array([-1], dtype=np.int64)
        self.joined: dict[str, int] = {}
        self.spelled: list[str] = []

    def _score(self, s: str) -> np.ndarray:
        w, z, kind = self.weights, self.zero, kind_of(s)
        ctx = context_features(s, kind, self.known)
        return np.stack([sum((w.get(f, z) for f in token_features(s, kind, self.known)), z), *(sum((w.get(f"{o}{f}", z) for f in ctx), z) for o in AROUND)])

    def _joined(self, s: str) -> int:
        low = s.lower()
        if len(low) < LEAST or not low[0].isalpha() or low in self.known or kind_of(low) != "word":
            return -1
        if low not in self.joined:
            self.joined[low] = len(self.spelled)
            self.spelled.append(low)
        return self.joined[low]

    def _rows(self, flat: list[str]) -> np.ndarray:
        """The score row of every token; row 0 is a line end."""
        index = self.index
        rows = list(map(index.get, flat))
        if None in rows:
            first = len(self.table)
            words = []
            for s in dict.fromkeys(s for s, r in zip(flat, rows) if r is None):
                index[s] = first + len(self.scores)
                self.scores.append(self._score(s))
                words.append(self._joined(s))
            self.table = np.concatenate([self.table, np.stack(self.scores).astype(np.float32)])
            self.word = np.concatenate([self.word, np.array(words, dtype=np.int64)])
            self.scores = []
            rows = list(map(index.__getitem__, flat))
        return np.array(rows, dtype=np.int64)

    def unary(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Scores of all tokens but line ends, with their text, place in it, first rows and
        sizes of lines, and the number of the word they are joined by."""
        flat: list[str] = []
        n_tokens = []
        for t in texts:
            ts = strings(t) if t else []
            flat += ts
            n_tokens.append(len(ts))
        rows = self._rows(flat)
        text_of = np.repeat(np.arange(len(texts)), n_tokens)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n_tokens, dtype=np.int64) - n_tokens, n_tokens)
        # A line is a run of tokens of one text between line ends.
        brk = rows == 0
        brk[1:] |= text_of[1:] != text_of[:-1]
        line = np.cumsum(brk)
        keep = rows != 0
        at, line, text_of, place = rows[keep], line[keep], text_of[keep], place[keep]
        n = len(at)
        u = self.table[at, 0]
        for j, o in enumerate(AROUND):
            ok = np.zeros(n, dtype=bool)
            near = np.zeros(n, dtype=np.int64)
            if abs(o) < n:
                here, there = (slice(0, n - o), slice(o, n)) if o > 0 else (slice(-o, n), slice(0, n + o))
                ok[here] = line[here] == line[there]
                near[here] = at[there]
            u += np.where(ok[:, None], self.table[near, 1 + j], self.edge[j])
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if n else np.zeros(0, dtype=np.int64)
        return u, text_of, place, first, np.diff(np.append(first, n)), self.word[at]

    def edges(self, text_of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Skip edges between rows, and what each joins (an index of ``SKIPS``)."""
        at = np.flatnonzero(word >= 0)
        order = at[np.lexsort((at, word[at], text_of[at]))]
        t, w = text_of[order], word[order]
        again = np.flatnonzero((t[1:] == t[:-1]) & (w[1:] == w[:-1]))
        same = np.stack([order[again], order[again + 1]], axis=1)
        # The first occurrences of different words of one text that are one edit apart.
        new = np.ones(len(order), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
        like = []
        held, seen = -1, {}
        for r, k, x in zip(order[new].tolist(), t[new].tolist(), w[new].tolist()):
            if k != held:
                held, seen = k, {}
            s = self.spelled[x]
            if len(s) < LEAST_LIKE:
                continue
            for c in shortened(s):
                if c in seen:
                    like.append((seen[c], r))
                    break
            for c in shortened(s):
                seen.setdefault(c, r)
        like = np.array(like, dtype=np.int64).reshape(-1, 2)
        return np.concatenate([same, like]), np.repeat([0, 1], [len(same), len(like)])

    def labels(self, u: np.ndarray, text_of: np.ndarray, first: np.ndarray, size: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The decoded label of every row."""
        edges, kinds = self.edges(text_of, word) if self.agree is not None else (np.zeros((0, 2), dtype=np.int64), None)
        u = u.astype(np.float64)
        if len(edges):
            # Only lines with an end of an edge have messages to pass.
            line = np.searchsorted(first, edges.ravel(), side="right") - 1
            own = np.unique(line)
            rows = np.concatenate([np.arange(a, a + n) for a, n in zip(first[own].tolist(), size[own].tolist())])
            starts = np.cumsum(size[own]) - size[own]
            back = np.searchsorted(rows, edges)
            u[rows], _ = crf.skip_messages(u[rows], starts, size[own], back, kinds, self.agree, self.trans, self.start)
        # A label gains at most its margin over O and the best step into it.  Where that is below
        # zero for all labels of a line, no labelling beats O throughout: nothing to decode.
        hot = np.flatnonzero(np.maximum.reduceat((u[:, 1:] - u[:, :1] + self.gain).max(axis=1), first) >= -1e-9)
        y = np.zeros(len(u), dtype=np.int64)
        if len(hot):
            rows = np.concatenate([np.arange(a, a + n) for a, n in zip(first[hot].tolist(), size[hot].tolist())])
            y[rows] = crf.viterbi_lines(u[rows], np.cumsum(size[hot]) - size[hot], size[hot], self.trans, self.start)
        return y

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of all items of each text."""
        if len(self.index) > self.MOST:
            self.reset()
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        u, text_of, place, first, size, word = self.unary(texts)
        if not len(u):
            return out
        y = self.labels(u, text_of, first, size, word)
        hot = np.flatnonzero(y)
        line = np.searchsorted(first, hot, side="right")
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, p, v, ln in zip(text_of[hot].tolist(), place[hot].tolist(), y[hot].tolist(), line.tolist()):
            found.setdefault(k, []).append((p, v, ln))
        for k, items in found.items():
            at = [m.span() for m in iterate(texts[k])]
            last = (-2, "", -1)
            for p, v, ln in items:
                a, b = at[p]
                kind = _KIND_OF[v]
                if LABELS[v][0] == "I" and last == (p - 1, kind, ln):
                    out[k][-1] = (out[k][-1][0], b, kind)
                else:
                    out[k].append((a, b, kind))
                last = (p, kind, ln)
            out[k] = [x for x in (whole_name(texts[k], *i) if i[2] == "name" else i for i in out[k]) if x]
        return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in the place of every item."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_items(df: DataFrame, key: Column | str, text: Column | str) -> DataFrame:
    """``key, kind, start_pos, end_pos`` of every item of every text."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(key).alias("key"), col(text).alias("text")).where("key is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                found = [(r, *s) for r, spans in enumerate(tagger.spans(part.column(1).to_pylist())) for s in spans]
                keys = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.record_batch([keys, pa.array([f[3] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())], names=["key", "kind", "start_pos", "end_pos"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, kind string, start_pos int, end_pos int")


def redact_texts(df: DataFrame, key: Column | str, text: Column | str) -> DataFrame:
    """``key, text, n_items``: every text with placeholders, nulls kept."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(key).alias("key"), col(text).alias("text")).where("key is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                texts = part.column(1).to_pylist()
                found = tagger.spans(texts)
                clean = [t and redact(t, s) for t, s in zip(texts, found)]
                yield pa.record_batch([part.column(0), pa.array(clean, pa.string()), pa.array([len(s) for s in found], pa.int32())], names=["key", "text", "n_items"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string, n_items int")
