"""Queries of problem 6: unusable question and answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.pairs import broken_pairs
from lorikeet.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(table(spark, d, "query_history"), "id", "question", "answer")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs per kind of defect."""
    return p6_found(spark, d).groupBy("defect").agg(F.count("*").alias("n_pairs"))


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates}
ORACLE: dict[str, str] = {}
