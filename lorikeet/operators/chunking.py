"""Documents to headed paragraphs, and paragraphs to overlapping token windows.

Two forms of the paragraph operator give the same rows.  ``paragraphs`` folds
each document's lines in one expression, without any shuffle: a document is a
row, so a hot source does no harm.  Windows and chunk numbers follow from the
paragraph arrays the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.functions.text import strip, stripped_is_heading

SIZE, OVERLAP, DEFAULT_SECTION = 512, 0.15, "General"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line, is_heading`` of every line, split at ``\\n`` only."""
    parts = F.split(F.col(text), "\n", -1)
    ls = df.select(F.col(key).alias("key"), F.posexplode(parts).alias("line_no", "line")).withColumn("_s", strip("line"))
    return ls.withColumn("is_heading", stripped_is_heading(F.col("_s"))).drop("_s")


def _fold(text: Column) -> Column:
    """Array of ``(section, text)`` paragraphs of one document."""
    kind = "struct<section:string,open:array<string>,done:array<struct<section:string,text:string>>>"
    zero = F.struct(F.lit(DEFAULT_SECTION).alias("section"), F.array().cast("array<string>").alias("open"), F.array().cast("array<struct<section:string,text:string>>").alias("done")).cast(kind)

    def flushed(acc: Column) -> Column:
        para = F.array(F.struct(acc["section"].alias("section"), F.array_join(acc["open"], "\n").alias("text")))
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], para)).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        empty = F.array().cast("array<string>")
        heading, blank = line["h"], line["s"] == ""
        return F.struct(
            F.when(heading, line["s"]).otherwise(acc["section"]).alias("section"),
            F.when(heading | blank, empty).otherwise(F.concat(acc["open"], F.array(line["s"]))).alias("open"),
            F.when(heading | blank, flushed(acc)).otherwise(acc["done"]).alias("done"),
        ).cast(kind)

    stripped = F.transform(F.split(text, "\n", -1), strip)
    marked = F.transform(stripped, lambda x: F.struct(x.alias("s"), stripped_is_heading(x).alias("h")))
    return F.aggregate(marked, zero, step, flushed)


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, para_id, section, text``: body lines between headings and blank lines.

    A heading's own text is in no paragraph; a section lasts over blank lines.
    Null texts, empty texts and texts of headings only give no rows.
    """
    found = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(_fold(F.col(text))).alias("para_id", "p"))
    return found.select("key", "para_id", "p.section", "p.text")


@dataclass(frozen=True)
class Tokens:
    """A tokenizer as two Column functions: a text to its tokens, and tokens to a text."""

    split: Callable[[Column], Column]
    join: Callable[[Column], Column]


def _white(text: Column) -> Column:
    s = strip(text)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


#: Words between white space, joined by single spaces.
WHITE_SPACE = Tokens(_white, lambda t: F.array_join(t, " "))


def token_windows(df: DataFrame, keys: list[str], text: str, size: int = SIZE, overlap: float = OVERLAP, tokens: Tokens = WHITE_SPACE) -> DataFrame:
    """``keys..., start, n_tokens, text``: whole short texts, windows of long ones.

    A text of at most ``size`` tokens comes out as it is; a longer one
    as windows every ``int(size * (1 - overlap))`` tokens, the last ones kept even
    if wholly inside the window before.
    """
    step = int(size * (1 - overlap))
    cut = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"), tokens.split(F.col(text)).alias("_t"))
    n = F.size("_t")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = cut.select(*keys, "_text", "_t", n.alias("_n"), F.explode(starts).alias("start"))
    window = F.slice("_t", F.col("start") + 1, size)
    return cut.select(*keys, "start", F.size(window).alias("n_tokens"), F.when(F.col("_n") <= size, F.col("_text")).otherwise(tokens.join(window)).alias("text"))


def chunks(df: DataFrame, key: str, name: str, text: str, size: int = SIZE, overlap: float = OVERLAP, tokens: Tokens = WHITE_SPACE) -> DataFrame:
    """``chunk_id, text, metadata``: the chunk table of a document table.

    Chunk numbers run through a document from 0.  They are running counts within
    the document's own row (windows per paragraph, summed), so nothing is shuffled.
    """
    base = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("name"), _fold(F.col(text)).alias("ps"))
    step = int(size * (1 - overlap))
    number_of = lambda n: F.when(n <= size, F.lit(1)).otherwise(F.ceil(n / step).cast("int"))
    count = lambda p: number_of(F.size(tokens.split(p["text"])))
    base = base.withColumn("counts", F.transform("ps", count))
    base = base.select("key", "name", "counts", F.posexplode("ps").alias("para_id", "p"))
    base = base.withColumn("first", F.aggregate(F.slice("counts", F.lit(1), F.col("para_id")), F.lit(0), lambda a, x: a + x))
    wins = token_windows(base.select("key", "name", "para_id", "first", F.col("p.section").alias("section"), F.col("p.text").alias("body")), ["key", "name", "para_id", "first", "section"], "body", size, overlap, tokens)
    number = F.col("first") + (F.col("start") / step).cast("int")
    return wins.select(
        "key",
        F.concat_ws("_", F.coalesce("name", F.lit("")), number.cast("string")).alias("chunk_id"),
        "text",
        F.struct(F.col("name").alias("document_name"), F.col("section").alias("section_heading")).alias("metadata"),
    )
