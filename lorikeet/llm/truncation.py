"""Texts that stop inside a word or sentence.

One pass over all values gathers the corpus's own evidence, combined per task
and then per key: its words, the pairs of words that end a sentence inside a
value, and the finished list lines that are followed by another line.  The words
are spread into the nodes of a trie (every proper prefix of a known word).

Only values without a clean sentence end are looked at closer.  Signs added
behind the text (dots of omission, dashes, brackets, emphasis, emoji, broken
characters) are taken off first.  What is left is cut if

* its last token is no known word but a proper prefix of known words: the trie
  decides, whatever else speaks for a complete text; or
* it ends with an abbreviation that never ends a sentence elsewhere; or
* it has no sentence end, its last token tells nothing to the trie, and it is
  neither a list line nor a short phrase that may stand as it is.  A list line may
  if it is a finished line elsewhere, a phrase of at most ``PHRASE_WORDS`` words if
  its last two words end sentences elsewhere, and both if their last token is a
  word of its own (a name, a code) that no known word continues.  None may at a
  length at which values pile up (a field limit, of any size).  Values of one
  length and the same last two words count once there: a limit cuts anywhere,
  while a repeated phrase or one form with other numbers has one ending.

All evidence is looked up by merging joins on the key, so vocabulary and evidence
may grow with the corpus.  Null and empty texts, placeholders, finished lists, short
complete phrases and copies of the prompt are no cases; repeated rows give one
row; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.copies import copies, says_nothing, words
from lorikeet.llm.split import ABBREVIATIONS
from lorikeet.session import cut_lineage

#: A phrase without sentence end may be complete up to this many words.
PHRASE_WORDS = 8
#: A length is a field limit if this many unended values of different endings, and this share of all around it, have it.
LIMIT_VALUES, LIMIT_SHARE, AROUND = 4, 0.5, 4

_SENTENCE = re.compile(r"(?<=[.!?।])[\"”’»)\]*]*\s+")
_BULLET = re.compile(r"\s*(?:[-*•–·]|\d{1,3}[.)])\s+(.*\S)\s*\Z")
_DIGITS = re.compile(r"\d+")
_STRIP = "\"'“”‘’«»()[]{}<>.,;:!?।…*_-–—`"
_ADDED = regex.compile(r"(?:[\s\p{Cf}\p{Cc}\p{So}\p{Sk}\ufe00-\ufe0f�\"'“”‘’«»()\[\]{}*_~`>|…—–\-]|(?<![.])[.]{2,3}(?![.])|(?<=[.!?।])[.]{2,3})+\Z")
#: What a value with a clean sentence end looks like; the rest is looked at closer.
_CLEAN = r"[\p{L}\p{N}\)%][.!?।][\s\"”’»)\]*]*$"
_DOUBTFUL = r"(^|[^\p{L}\p{N}.,/-])\p{L}{1,6}(\.\p{L})?\.[\s\"”’»)\]*]*$"

_FEATURES = "token string, pair string, item string, ended boolean, doubtful boolean, n_words int, size int, prompted boolean"


def word_key(token: str) -> str:
    return token.strip(_STRIP).lower()


def pair_key(sentence: str) -> str | None:
    """The last two words of a sentence, numbers masked."""
    ws = sentence.rsplit(None, 2)[-2:]
    ws = [w for w in (word_key(x) for x in ws) if w]
    return _DIGITS.sub("9", " ".join(ws)) if ws else None


def core(text: str) -> str:
    """The text without signs added behind it; a closing bracket of its own stays out too."""
    end = len(text)
    while end and not text[end - 1].isalnum():
        end -= 1
    m = _ADDED.search(text, end)
    return text[: m.start()] if m else text


def last_words(text: str, end: int) -> str:
    """The last two white-space words before a position, whatever their length."""
    reach = 80
    while True:
        ws = text[max(0, end - reach) : end].rsplit(None, 2)
        if len(ws) == 3 or reach >= end:
            return " ".join(ws[-2:])
        reach *= 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, pairs, items = Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words: Counter = Counter()
        for t, n in tokens.items():
            if (w := word_key(t)) and not any(c.isdigit() for c in w):
                words[w] += n
        rows = [(k, x, n) for k, c in (("w", words), ("p", pairs), ("i", items)) for x, n in c.items()]
        tokens.clear(), pairs.clear(), items.clear()
        cols = list(zip(*rows)) if rows else [[], [], []]
        return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["kind", "key", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            tokens.update(t.split()[:-1])
            for m in _SENTENCE.finditer(t):
                before = last_words(t, m.start())
                if (m.end() == len(t) or not t[m.end()].isdigit() or before[-2:-1].isdigit()) and (p := pair_key(before)):
                    pairs[p] += m.end() < len(t)
            if "\n" in t:
                for line in t.split("\n")[:-1]:
                    if m := _BULLET.match(line):
                        items[m[1].lower()] += 1
        if len(tokens) + len(pairs) > 300_000:
            yield flush()
    yield flush()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t, prompt in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            c = core(t)
            last = c.rsplit(None, 1)[-1] if c.strip() else ""
            ended = c[-1:] in ("." , "!", "?", "।")
            doubtful = ended and last.lower() in ABBREVIATIONS and len(c.split()) > 3
            line = c.rsplit("\n", 1)[-1]
            m = _BULLET.match(line) if "\n" in c else None
            w = word_key(last)
            token = None if not w or any(ch.isdigit() for ch in w) or not any(ch.isalpha() for ch in w) else w
            prompted = says_nothing(ws := words(t)) or prompt is not None and copies(words(prompt), ws)
            rows.append((token, pair_key(c), m[1].lower() if m else None, ended, doubtful, len(c.split()), len(t), prompted))
        kinds = [pa.string()] * 3 + [pa.bool_()] * 2 + [pa.int32()] * 2 + [pa.bool_()]
        cols = list(zip(*rows)) if rows else [[]] * 8
        yield pa.record_batch([b.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=["key", "token", "pair", "item", "ended", "doubtful", "n_words", "size", "prompted"])


def find_truncated(values: DataFrame) -> DataFrame:
    """``key`` of every cut value of ``values (key, text, prompt)``, once each.

    ``key`` may be a struct; ``prompt`` is the text whose copy is no case, or null.
    """
    kind = values.schema["key"].dataType.simpleString()
    values = values.where("text is not null")
    seen = cut_lineage(values.select("text").mapInArrow(_count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = seen.where("kind = 'w'")
    trie = (
        words.where(F.length("key") > 1)
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda k: F.substring("key", 1, k))).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .select(F.lit("t").alias("kind"), "key", "n")
    )
    # The end alone tells whether a value must be looked at closer, where it is judged whole.
    end = F.substring("text", -48, 48)
    clean = end.rlike(_CLEAN) & ~end.rlike(_DOUBTFUL)
    close = cut_lineage(values.where(~clean).select("key", "text", "prompt").mapInArrow(_describe, f"key {kind}, {_FEATURES}"))

    ask = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).alias("key"))
    asked = close.select(F.explode(F.array(ask("w", "token"), ask("t", "token"), ask("p", "pair"), ask("i", "item"))).alias("q")).select("q.kind", "q.key").where("key is not null").distinct()
    # Vocabulary and evidence grow with the data: these joins sort and merge.
    known = cut_lineage(seen.unionByName(trie).join(asked.hint("merge"), ["kind", "key"], "left_semi"))

    def lookup(df: DataFrame, kind: str, column: str, out: str) -> DataFrame:
        side = known.where(F.col("kind") == kind).select(F.col("key").alias(column), F.col("n").alias(out))
        return df.join(side.hint("merge"), column, "left").withColumn(out, F.coalesce(out, F.lit(0)))

    for kind_, column, out in (("w", "token", "n_word"), ("t", "token", "n_longer"), ("p", "pair", "n_pair"), ("i", "item", "n_item")):
        close = lookup(close, kind_, column, out)
    open_ = close.where("not ended and not prompted and n_words > 0")
    sizes = open_.select("size", "pair").distinct().groupBy("size").agg(F.count("*").alias("n"))
    around = sizes.select(F.explode(F.sequence(F.col("size") - AROUND, F.col("size") + AROUND)).alias("size"), "n").groupBy("size").agg(F.sum("n").alias("near"))
    limits = sizes.join(around.hint("merge"), "size").where((F.col("n") >= LIMIT_VALUES) & (F.col("n") >= LIMIT_SHARE * F.col("near"))).select("size", F.lit(True).alias("at_limit"))
    close = close.join(limits.hint("merge"), "size", "left")

    unknown = F.col("token").isNotNull() & (F.col("n_word") == 0)
    inside_word = unknown & (F.col("n_longer") > 0)
    # A last word that the corpus doesn't know tells nothing about sentences: only the trie speaks against it.
    item, free = F.col("item").isNotNull(), F.col("at_limit").isNull()
    listed = item & ((F.col("n_item") > 0) | unknown & free)
    phrase = ~item & (F.col("n_words") <= PHRASE_WORDS) & ((F.col("n_pair") > 0) | unknown) & free
    cut = F.when(F.col("prompted") | (F.col("n_words") == 0), False).when(F.col("ended"), F.col("doubtful") & (F.col("n_pair") == 0)).otherwise(inside_word | ~(listed | phrase))
    return close.where(cut).select("key").distinct()
