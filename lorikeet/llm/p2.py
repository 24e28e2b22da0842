"""Queries of problem 2: running lines of policy documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.repeated_lines import MIN_DOCS, excessive_nodes, mark, occurrences, without_lines
from lorikeet.session import cut_lineage
from lorikeet.sources.tables import table


def _occ(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(occurrences(table(spark, d, "chunk"), "chunk_id", "metadata.document_name", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of excessive clusters whose own class of equal letters is excessive in its cluster."""
    occ = _occ(spark, d)
    return mark(occ, excessive_nodes(occ).where(F.col("class_docs") >= MIN_DOCS)).select(F.col("doc").alias("chunk_id"), "line_no")


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk without the lines of excessive clusters, near-duplicates included."""
    occ = _occ(spark, d)
    return without_lines(table(spark, d, "chunk").where("chunk_id is not null"), "chunk_id", "text", mark(occ, excessive_nodes(occ))).select(F.col("doc").alias("chunk_id"), "text", "n_removed")


QUERIES = {"p2_found": p2_found, "p2_cleaned": p2_cleaned}

ORACLE = {
    "p2_found": r"""
with c as (select distinct chunk_id, metadata.document_name as dn, text from chunk where text is not null and metadata.document_name is not null and chunk_id is not null),
     p as (select chunk_id, dn, string_split(text, chr(10)) as parts from c),
     l as (select chunk_id, dn, unnest(range(len(parts)))::int as line_no, unnest(parts) as line from p),
     k as (select *, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) as letters from l),
     x as (select dn, letters from k where length(letters) >= 4 group by all having count(distinct chunk_id) >= 10)
select distinct chunk_id, line_no from k join x using (dn, letters)""",
}
