"""Queries of problem 10: abusive, hateful or sexual documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.abuse import THRESHOLD, score_texts
from lorikeet.sources.tables import table


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return score_texts(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= THRESHOLD).select(F.col("key").alias("doc_id")).distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score, offending passages and the worst of them."""
    return _scores(spark, d).select(F.col("key").alias("doc_id"), F.round("score", 3).alias("score"), "n_passages", "worst")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and offending documents per source."""
    docs = table(spark, d, "documents")
    scored = docs.select("doc_id", "source").join(_scores(spark, d).select(F.col("key").alias("doc_id"), "score").hint("merge"), "doc_id")
    bad = F.sum((F.col("score") >= THRESHOLD).cast("bigint"))
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), bad.alias("n_offending"), F.round(bad / F.count("*"), 6).alias("rate"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
ORACLE: dict[str, str] = {}
