"""Scores for abusive, hateful and sexual passages.

1. The corpus's words are counted in one combined pass; their character n-grams
   (bounded by the alphabet) are the language model of the restorer.
2. Every text is folded, disguised words are restored (``deobfuscate``), and an
   automaton over all risk words, and over a piece that each threat or group
   phrase requires, finds the sentences worth a look in one scan.
3. Such a sentence is evidence by the classes of its words: insults aimed at a
   person, threats, demeaned groups, sexual words.  A logistic model fitted to
   reviewers' labels (``train_abuse``, ``abuse_model.json``) gives the probability
   that it offends.  A text scores as its worst sentence; from ``THRESHOLD`` on it is
   listed.

Texts are scored where they lie, without a shuffle.  Null, empty and blank texts and
texts without any evidence score 0; every row gives a row, also where ids repeat; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.llm import abuse_words as W
from lorikeet.llm.deobfuscate import ORDER, Restorer, fold
from lorikeet.llm.literals import required

THRESHOLD = 0.5
MODEL = Path(__file__).with_name("abuse_model.json")
#: Kinds of evidence in a sentence.
EVIDENCE = ("strong", "insult", "more_insults", "unaimed_insults", "threat", "group", "sexual", "suggestive")
#: What the weights are before any label is seen.
PRIOR = {"strong": 4.0, "insult": 4.0, "more_insults": 1.6, "unaimed_insults": 2.0, "threat": 4.0, "group": 4.0, "sexual": 4.0, "suggestive": 2.0, "bias": -3.2}
#: The language model takes words of the scripts that the lexicon has.
MODEL_WORD = r"^([a-zß-öø-ÿœ]{2,}|[\u0900-\u0965]{2,})$"

_MODEL_WORD = re.compile(MODEL_WORD)
_WORD = re.compile(r"[^\W\d_]+(?:[ऀ-ॿ]+)*(?:['’][^\W\d_]+)?|[ऀ-ॿ]+")
_SENTENCE = re.compile(r"(?<=[.!?।])\s+|\n+")
_PHRASES, _THREATS = re.compile("|".join(W.GROUP_PHRASES)), re.compile("|".join(W.THREATS))
_ADDRESS = re.compile(r"\b(?:you|your|hey|nobody wants)\b|\b(?:agent|manager|boss|he|she) is an? ")


def unaccented(words: list[str]) -> frozenset[str]:
    """The words, and those with accents also without them: so they are written in disguise."""
    plain = ("".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in words if max(w, default="") < "\u0250")
    return frozenset(words) | frozenset(plain)


_STRONG, _INSULT, _TARGET, _GROUP, _DEMEAN = map(unaccented, (W.STRONG, W.INSULT, W.TARGET, W.GROUP, W.DEMEAN))
_SEXUAL, _SUGGESTIVE, _AROUSE, _HARMLESS = map(unaccented, (W.SEXUAL, W.SUGGESTIVE, W.AROUSE, W.HARMLESS))
_ADDRESSED = frozenset(W.ADDRESSED)
LEXICON = _STRONG | _INSULT | _ADDRESSED | _SEXUAL | {w for w in _SUGGESTIVE | _DEMEAN | _GROUP if len(w) > 3}
#: Every word that a score can come from, as a whole word.  GROUP and AROUSE only count beside another one.
_TRIGGERS = _STRONG | _INSULT | _ADDRESSED | _SEXUAL | _SUGGESTIVE | _DEMEAN


#: Pieces of text that a threat or a group phrase can't do without, anywhere in a word.
_PIECES = frozenset().union(*map(required, W.THREATS + W.GROUP_PHRASES))


def evidence(s: str) -> dict[str, float]:
    """The kinds of evidence in one folded, restored sentence; empty if there is none."""
    words = _WORD.findall(s)
    have = set(words)
    harmless = bool(have & _HARMLESS)
    out = dict.fromkeys(EVIDENCE, 0.0)
    insults = len(have & _INSULT)
    if have & _ADDRESSED and _ADDRESS.search(s):
        insults += len(have & _ADDRESSED)
    if insults and not harmless:
        if have & _TARGET:
            out["insult"], out["more_insults"] = 1.0, insults - 1.0
        elif insults > 1:
            out["unaimed_insults"] = float(insults)
    out["strong"] = float(bool(have & _STRONG))
    out["threat"] = float(bool(_THREATS.search(s)))
    out["group"] = float(bool(have & _GROUP and (_PHRASES.search(s) or have & _DEMEAN)))
    out["sexual"] = float(bool(have & _SEXUAL))
    if not have & _SEXUAL and (n := len(have & _SUGGESTIVE)) and n + len(have & _AROUSE) >= 2 and not harmless:
        out["suggestive"] = float(n + len(have & _AROUSE))
    return out if any(out.values()) else {}


class Scorer:
    """Finds and scores the offending sentences of texts; built once per task."""

    def __init__(self, grams: dict[str, int], weights: dict[str, float] | None = None) -> None:
        self.weights = weights or json.loads(MODEL.read_text())
        self.restorer = Restorer(grams, set(LEXICON))
        self.machine = ahocorasick.Automaton()
        for w in _TRIGGERS | _PIECES:
            self.machine.add_word(w, 0 if w in _PIECES else len(w))
        self.machine.make_automaton()

    def sentences(self, text: str) -> list[tuple[dict[str, float], str]]:
        """(evidence, sentence) of all sentences with any evidence."""
        t = self.restorer.restore(fold(text))
        hits = []
        n = len(t)
        for end, size in self.machine.iter(t):
            if not size or (end + 1 == n or not t[end + 1].isalpha()) and (end < size or not t[end - size].isalpha()):
                hits.append(end)
        if not hits:
            return []
        out, k, lo = [], 0, 0
        cuts = [*((m.start(), m.end()) for m in _SENTENCE.finditer(t)), (n, n)]
        for hi, nxt in cuts:
            if k < len(hits) and hits[k] < hi:
                while k < len(hits) and hits[k] < hi:
                    k += 1
                s = t[lo:hi]
                if e := evidence(s):
                    out.append((e, s.strip()))
            lo = nxt
        return out

    def score(self, found: dict[str, float]) -> float:
        """Probability that a sentence of this evidence offends."""
        w = self.weights
        return 1 / (1 + math.exp(-w["bias"] - sum(w[k] * v for k, v in found.items())))

    def passages(self, text: str) -> list[tuple[float, str]]:
        """(score, sentence) of all sentences with any evidence."""
        return [(self.score(e), s) for e, s in self.sentences(text)]


def counted_words(texts: Iterable[str]) -> Counter:
    """The words of texts that enter the language model, with their counts."""
    c: Counter = Counter()
    for t in texts:
        c.update(t.lower().split())
    return Counter({w: n for w, n in c.items() if _MODEL_WORD.match(w)})


def model_grams(texts: DataFrame) -> dict[str, int]:
    """Character n-gram counts over the words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["w", "n"])
            c.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(t.lower().split())
            if len(c) > 300_000:
                yield flush()
        yield flush()

    words = texts.where("text is not null").mapInArrow(count, "w string, n bigint").where(F.col("w").rlike(MODEL_WORD)).groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    # Sixty-fourths: rounding up would favour rare words the more, the smaller the corpus.
    padded = words.select(F.concat(F.lit("^" * (ORDER - 1)), "w", F.lit("$")).alias("w"), F.round(64 * F.sqrt("n")).cast("bigint").alias("n"))
    at = F.explode(F.sequence(F.lit(ORDER), F.length("w"))).alias("k")
    size = F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("j")
    grams = padded.select("w", "n", at).select("w", "n", "k", size).select(F.substring("w", F.col("k") - F.col("j") + 1, F.col("j")).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    # A fixed number of rows, by the alphabets of MODEL_WORD and ORDER; in practice some ten thousand.
    return {r.g: r.n for r in grams.where("n > 1 or length(g) < 3").collect()}


def score_texts(df: DataFrame, key: Column | str, text: Column | str) -> DataFrame:
    """``key, score, n_passages, worst`` for every row of ``df`` with a key."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(key).cast("bigint").alias("key"), col(text).alias("text")).where("key is not null")
    grams = df.sparkSession.sparkContext.broadcast(model_grams(rows.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(grams.value)
        for b in batches:
            scores, counts, worst = [], [], []
            for t in b.column(1).to_pylist():
                ps = scorer.passages(t) if t else []
                bad = [p for p in ps if p[0] >= THRESHOLD]
                top = max(ps, default=(0.0, None))
                scores.append(top[0])
                counts.append(len(bad))
                worst.append(top[1] if bad else None)
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(worst, pa.string())], names=["key", "score", "n_passages", "worst"])

    return rows.mapInArrow(run, "key bigint, score double, n_passages int, worst string")
