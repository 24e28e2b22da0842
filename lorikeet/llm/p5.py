"""Queries of problem 5: oversized chunks and their pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.llm.split import ABBREVIATIONS, LIMIT, OVERLAP, split_oversized
from lorikeet.sources.tables import table


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunk"), "chunk_id", "text", "metadata.section_heading")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0").select(F.col("key").alias("chunk_id"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select(
        F.col("key").alias("chunk_id"), "piece_no", F.col("heading").alias("section_heading"), "start_word", "end_word", "natural_end", F.col("piece").alias("text")
    )


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}

_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SHORT = ", ".join(f"'{a}'" for a in sorted(ABBREVIATIONS))
#: Words with their place, line and whether a piece may end behind them; the farthest such end up
#: to each place; and the ends of all pieces, one after the other.
_CUTS = rf"""
c0 as (select chunk_id, min(row(text, metadata.section_heading)) as r from chunk where chunk_id is not null and text is not null group by chunk_id),
c as (select chunk_id, r[1] as text, r[2] as heading, regexp_extract_all(r[1], '[^{_SPACE}]+') as ws, regexp_extract_all(r[1], '[{_SPACE}]+') as gaps, regexp_matches(r[1], '^[{_SPACE}]')::int as led from c0 where len(regexp_extract_all(r[1], '[^{_SPACE}]+')) > {LIMIT}),
l as (select chunk_id, unnest(range(len(string_split(text, chr(10))))) as ln, unnest(string_split(text, chr(10))) as line from c),
w0 as (select chunk_id, ln, unnest(regexp_extract_all(line, '[^{_SPACE}]+')) as w, unnest(range(1, 1 + len(regexp_extract_all(line, '[^{_SPACE}]+')))) as j from l),
w1 as (select chunk_id, ln, w, row_number() over (partition by chunk_id order by ln, j) as k, count(*) over (partition by chunk_id) as n,
         lead(ln) over (partition by chunk_id order by ln, j) as ln2, lead(w) over (partition by chunk_id order by ln, j) as w2 from w0),
w as (select chunk_id, k, n, k < n and (ln2 > ln or (regexp_matches(w, '[.!?…।。]+["''”’»)\]]*$') and lower(w) not in ({_SHORT}) and not regexp_matches(w2, '^\p{{Ll}}') and not regexp_matches(w, '^\p{{Lu}}.$'))) as nat from w1),
f as (select chunk_id, k, n, nat, max(case when nat then k end) over (partition by chunk_id order by k) as far from w),
t as (select chunk_id, 0::bigint as no, 0::bigint as e, (select max(n) from f where f.chunk_id = c.chunk_id) as n from c
      union all
      select t.chunk_id, t.no + 1, case when t.e + s.step >= t.n then t.n when f.far > t.e then f.far else t.e + s.step end, t.n
      from t, (select 1) one, lateral (select case when t.e = 0 then {LIMIT} else {LIMIT - OVERLAP} end as step) s join f on f.chunk_id = t.chunk_id and f.k = least(t.e + s.step, t.n) where t.e < t.n)"""

ORACLE = {
    "p5_pieces": rf"""with recursive {_CUTS},
p as (select t.chunk_id, t.no - 1 as no, t.n, t.e, case when t.no = 1 then 0 else greatest(0, lag(t.e) over (partition by t.chunk_id order by t.no) - {OVERLAP}) end as s from t)
select p.chunk_id, p.no::int as piece_no, c.heading as section_heading, p.s::int as start_word, p.e::int as end_word, (p.e = p.n or f.nat) as natural_end,
  array_to_string(list_transform(range(p.s + 1, p.e), lambda k: ws[k] || gaps[k + led]), '') || ws[p.e] as text from p join c using (chunk_id) join f on f.chunk_id = p.chunk_id and f.k = p.e where p.no >= 0""",
    "p5_found": r"select distinct chunk_id from chunk where chunk_id is not null and text is not null and len(regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) > 512",
}
