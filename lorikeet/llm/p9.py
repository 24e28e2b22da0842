"""Queries of problem 9: evaluation passages inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.leaks import find_leaks
from lorikeet.sources.tables import table


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents it leaked into."""
    n = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    items = table(spark, d, "eval_items").select("item_id", "suite").distinct()
    return items.join(n, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_docs"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
# SQL has no NFKC.  Composed letters and the wide forms of ASCII, the only ones in these
# tables, are brought to it by hand.
_WIDE, _PLAIN = ("".join(map(chr, range(first, first + 94))).replace("'", "''") for first in (0xFF01, 0x21))
_WORDS = r"regexp_extract_all(lower(regexp_replace(translate(nfc_normalize({x}), '{wide}', '{plain}'), '[\p{{Cf}}]', '', 'g')), '[\p{{L}}\p{{N}}]+')"
_GRAMS = "unnest(list_distinct(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(list_slice(ws, i, i + 11), ' '))))"
_LEAKS = f"""i as (select distinct item_id, {_WORDS.format(x='passage', wide=_WIDE, plain=_PLAIN)} as ws from eval_items where item_id is not null and passage is not null),
    ig as (select item_id, {_GRAMS} as g from i where len(ws) >= 12),
    d as (select doc_id, {_WORDS.format(x='text', wide=_WIDE, plain=_PLAIN)} as ws from documents where doc_id is not null and text is not null),
    dg as (select doc_id, {_GRAMS} as g from d where len(ws) >= 12),
    f as (select distinct doc_id, item_id from dg join ig using (g))"""

ORACLE = {
    "p9_found": f"with {_LEAKS} select doc_id, item_id from f",
    "p9_items": f"with {_LEAKS}, n as (select item_id, count(*) as n from f group by item_id) select item_id, suite, coalesce(n, 0) as n_docs from (select distinct item_id, suite from eval_items) left join n using (item_id)",
}
