"""Lines repeated across the documents of one source.

Every distinct written line of a source is a node.  Steps, all partitioned by
(source, line) and pre-aggregated before a shuffle:

1. Mask: numbers, dates and names of a node's line are masked word by word.
2. Cluster within the source.  Lines with the same letters, lower-cased, form a class:
   they may differ in numbers, punctuation, layout or letter case.  Each class is signed
   by the five-word shingles of its masked line; classes with equal shingle sets fall
   together, and all pairs of sets alike at ``similarity`` or more are linked by the exact
   search of problem 3, to whose lists a source adds its own name.  Clusters are the
   connected classes.
3. Count: documents are counted out of the clusters, distinct per class and per
   cluster.  A cluster is excessive from ``min_docs`` documents on.
4. Mark every occurrence and rebuild each text without the marked lines.

A hot source is no problem, since no step groups by source alone; a hot line is
pre-aggregated, and its occurrences are marked in a merging semi join, whose skewed
partitions adaptive execution splits.  Nothing is broadcast.

The search is exact: no link at ``similarity`` or more is lost, however many lines are
alike.

Edge cases: null texts, null document keys and null sources take part in
nothing (texts come out unchanged); lines with fewer than four letters never
count; equal rows count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.llm.components import components
from lorikeet.llm.near_records import SET, link_sets, signed
from lorikeet.llm.shingles import mix, shingle_sets
from lorikeet.session import cut_lineage

MIN_LETTERS, MIN_DOCS, SIMILARITY, SHINGLE = 4, 10, 0.8, 5

_WORD = re.compile(r"[^\W_]+")
#: A run of words with digits, dates and amounts included; no letter is looked at twice.
_NUMBERS = re.compile(r"(?<![^\W_])[^\W\d_]*+\d[\w.,/:-]*+(?:\s++\d[\w.,/:-]*+)*+")
#: Two or more capitalised words in a row behind another word or number.
_NAMES = regex.compile(r"(?<=[\p{L}\p{N}],? )\p{Lu}[\p{Ll}\p{M}'’-]+(?: \p{Lu}[\p{Ll}\p{M}'’-]+)+")


def masked(line: str) -> list[str]:
    """The words of a line, lower-cased: a run of words with digits is one mark, a run of two
    or more capitalised words behind the first word another.

    A single capitalised word is no name: it may be any noun of another language.
    """
    line = _NUMBERS.sub(" 0 ", line)
    return _WORD.findall(_NAMES.sub("1", line).lower())


def occurrences(df: DataFrame, doc: Column | str, source: Column | str, text: Column | str) -> DataFrame:
    """``doc, source, line_no, line, h, l`` of every countable line.

    ``h`` identifies the written line and ``l`` its letters, both within the source.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(doc).cast("string").alias("doc"), col(source).cast("string").alias("source"), col(text).alias("text")).where("doc is not null and source is not null and text is not null")
    lines = rows.select("doc", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("mask", F.lower(F.regexp_replace("line", r"\P{L}+", ""))).where(F.length("mask") >= MIN_LETTERS)
    key = lambda c: F.struct(F.xxhash64("source", c).alias("a"), F.xxhash64(F.lit("~"), "source", c).alias("b"))
    return lines.select("doc", "source", "line_no", "line", key("line").alias("h"), key("mask").alias("l"))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, set, n, sh, sketch`` of a class: the shingles of its line, told apart by source."""
    known: dict[str, int] = {}
    for b in batches:
        words, size = [], []
        for line in b.column(2).to_pylist():
            ws = masked(line)
            for w in ws:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            words.extend(map(known.__getitem__, ws))
            size.append(len(ws))
        if len(known) > 500_000:
            known.clear()
        v, o = shingle_sets(np.array(words, dtype=np.uint64), np.concatenate(([0], np.cumsum(size))).astype(np.int64), SHINGLE)
        source = b.column(1).to_numpy().view(np.uint64)
        with np.errstate(over="ignore"):
            v = mix(v ^ mix(np.repeat(source, np.diff(o))))
        # A line without words is like no other.
        yield signed(b.column(0), v, o, alone=b.column(0))


def clusters(occ: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``h, n, class, cluster`` of every node; ``n`` counts its occurrences."""
    nodes = cut_lineage(occ.groupBy("h").agg(F.count("*").alias("n"), F.first("l").alias("l"), F.first("source").alias("source"), F.first("line").alias("line")))
    # A class is signed by the line of its smallest hash.
    classes = nodes.groupBy("l").agg(F.min(F.struct("h", "source", "line")).alias("m"))
    rows = cut_lineage(classes.select("l", F.xxhash64("m.source").alias("s"), "m.line").mapInArrow(_sign, f"key struct<a:bigint,b:bigint>, {SET}"))
    members, links = link_sets(rows, similarity)
    label = components(links).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    of = members.join(label.hint("merge"), "sid", "left").select(F.col("key").alias("l"), F.coalesce("cluster", "sid").alias("cluster"))
    # A written number stands for a class in all that follows.
    of = cut_lineage(of.withColumn("class", F.monotonically_increasing_id()))
    return nodes.select("h", "l", "n").join(of.hint("merge"), "l").select("h", "n", "class", "cluster")


def excessive_nodes(occ: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``h, class_docs, cluster_docs`` of the nodes in excessive clusters."""
    c = cut_lineage(clusters(occ, similarity))
    # The occurrences of a cluster bound its distinct documents from above, so only
    # clusters that can matter are counted.
    most = c.groupBy("cluster").agg(F.sum("n").alias("most")).where(F.col("most") >= min_docs).select("cluster")
    c = cut_lineage(c.join(most.hint("merge"), "cluster", "left_semi").select("h", "class", "cluster"))
    document = F.struct(F.xxhash64("doc").alias("a"), F.xxhash64(F.lit("~"), "doc").alias("b")).alias("d")
    seen = occ.select("h", document).join(c.hint("merge"), "h").groupBy("cluster", "class", "d").agg(F.count("*").alias("x"))
    seen = cut_lineage(seen.select("cluster", "class", "d"))
    of_cluster = seen.select("cluster", "d").distinct().groupBy("cluster").agg(F.count("*").alias("cluster_docs")).where(F.col("cluster_docs") >= min_docs)
    of_class = seen.groupBy("cluster", "class").agg(F.count("*").alias("class_docs"))
    counted = of_class.join(of_cluster.hint("merge"), "cluster").select("class", "class_docs", "cluster_docs")
    return c.select("h", "class").join(counted.hint("merge"), "class").select("h", "class_docs", "cluster_docs")


def mark(occ: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc, line_no`` of every occurrence of the given nodes, once each."""
    return occ.select("doc", "line_no", "h").join(nodes.select("h").hint("merge"), "h", "left_semi").select("doc", "line_no").distinct()


def without_lines(df: DataFrame, doc: str, text: str, marked: DataFrame) -> DataFrame:
    """``doc, text, n_removed``: every text without its marked lines, nulls kept."""
    drop = marked.groupBy("doc").agg(F.collect_set("line_no").alias("drop"))  # at most the lines of one text
    rows = df.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).groupBy("doc").agg(F.min("text").alias("text"))
    rows = rows.join(drop.hint("merge"), "doc", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("drop"), i))
    return rows.select(
        "doc",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"),
    )
