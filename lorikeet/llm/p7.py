"""Queries of problem 7: cut answers and source previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.truncation import find_truncated
from lorikeet.sources.tables import table


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Answers and previews as ``key (id, field, pos), text, prompt, origin``."""
    q = table(spark, d, "query_history").where("id is not null")
    key = lambda field, pos: F.struct("id", F.lit(field).alias("field"), pos.cast("int").alias("pos")).alias("key")
    answers = q.select(key("answer", F.lit(0)), F.col("answer").alias("text"), F.col("question").alias("prompt"), F.col("scope").alias("origin"))
    previews = q.select("id", F.posexplode("sources").alias("p", "s"))
    previews = previews.select(key("sources", F.col("p")), F.col("s.text").alias("text"), F.lit(None).cast("string").alias("prompt"), F.col("s.document").alias("origin"))
    return answers.unionByName(previews)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(_values(spark, d).drop("origin")).select("key.id", "key.field", "key.pos")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Values and cut values per scope (answers) and per document (previews)."""
    v = _values(spark, d)
    cut = find_truncated(v.drop("origin")).withColumn("cut", F.lit(1))
    all_ = v.where("text is not null").groupBy("key").agg(F.min("origin").alias("origin"))
    rate = all_.join(cut.hint("merge"), "key", "left").groupBy("key.field", "origin").agg(F.count("*").alias("n_values"), F.count("cut").alias("n_cut"))
    return rate.select("field", "origin", "n_values", "n_cut", F.round(F.col("n_cut") / F.col("n_values"), 6).alias("share_cut"))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
ORACLE: dict[str, str] = {}
