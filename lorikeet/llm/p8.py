"""Queries of problem 8: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.tokenize import encode
from lorikeet.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens per source."""
    docs = table(spark, d, "documents")
    ids = encode(docs.select("text", F.struct("doc_id", "source").alias("k")), "k", "text")
    return ids.groupBy(F.col("key.source").alias("source")).agg(F.count("*").alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}
ORACLE: dict[str, str] = {}
