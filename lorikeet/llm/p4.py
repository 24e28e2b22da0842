"""Queries of problem 4: personal items in questions and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.pii import find_items, redact_texts
from lorikeet.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """``key (src, row_key), text`` of questions and chunks."""
    key = lambda src, c: F.struct(F.lit(src).alias("src"), F.col(c).cast("string").alias("row_key")).alias("key")
    q = table(spark, d, "query_history").where("id is not null").select(key("question", "id"), F.col("question").alias("text"))
    c = table(spark, d, "chunk").where("chunk_id is not null").select(key("chunk", "chunk_id"), "text")
    return q.unionByName(c)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return find_items(_texts(spark, d), "key", "text").select("key.src", "key.row_key", "kind", "start_pos", "end_pos").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every question and chunk with typed placeholders for its personal items."""
    out = redact_texts(_texts(spark, d), "key", "text").groupBy("key").agg(F.max(F.struct("n_items", "text")).alias("r"))
    return out.select("key.src", "key.row_key", "r.text", "r.n_items")


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLE: dict[str, str] = {}
