"""Queries of problem 3: chunks that share most of their wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.near_records import expand, groups, near_records
from lorikeet.sources.tables import table

WORDS, SIMILARITY, LEAST_WORDS = 3, 0.6, 30


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_records(table(spark, d, "chunk"), "chunk_id", "text", WORDS, SIMILARITY, LEAST_WORDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return expand(*_near(spark, d)).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(*_near(spark, d)).select(F.col("key").alias("chunk_id"), F.col("group_key").alias("group_id"), "n_links")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

_PAIRS = r"""
c as (select chunk_id, min(text) as text from chunk where chunk_id is not null and text is not null group by chunk_id),
     w as (select chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from c),
     s as (select chunk_id, unnest(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) as g
           from w where len(ws) >= 30),
     n as (select chunk_id, count(*) as n from s group by chunk_id),
     r as (select g from s group by g having count(*) > 1),
     t as (select chunk_id, hash(g) as g from s join r using (g)),
     p as (select a.chunk_id as x, b.chunk_id as y, count(*) as o from t a join t b on a.g = b.g and a.chunk_id < b.chunk_id group by all),
     f as (select x, y from p join n a on a.chunk_id = x join n b on b.chunk_id = y where o::double / (a.n + b.n - o) >= 0.6 - 1e-9)"""

ORACLE = {
    "p3_found": f"with {_PAIRS} select x as chunk_id_a, y as chunk_id_b from f",
    # Groups are what a chunk reaches over links; every chunk of enough words has a row.
    "p3_groups": f"""with recursive {_PAIRS},
     e as (select x, y from f union all select y, x from f),
     reach as (select chunk_id as x, chunk_id as y from n union select reach.x, e.y from reach join e on e.x = reach.y)
select reach.x as chunk_id, min(reach.y) as group_id, any_value(coalesce(k, 0)) as n_links
from reach left join (select x, count(*) as k from e group by x) d on d.x = reach.x group by reach.x""",
}
