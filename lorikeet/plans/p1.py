"""Queries of problem 1: sessions of asking activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.operators.sessions import cut, gap_tree
from lorikeet.sources.tables import table

GAP_S = 30 * 60
#: Gap settings of the profile query, in seconds.
PROFILE_S = (300, 1800, 7200, 86400, 604800)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    user = F.lower(F.regexp_replace("username", r"(?U)^\s+|\s+$", ""))
    return gap_tree(table(spark, d, "query_history"), user, "created_at", "id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cut(_tree(spark, d), GAP_S).select(F.col("entity").alias("username"), "first_id", "last_id")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return cut(_tree(spark, d), GAP_S).select(
        F.col("entity").alias("username"),
        "first_id",
        F.unix_micros("session_start").alias("start_us"),
        F.unix_micros("session_end").alias("end_us"),
        F.round("duration_s", 3).alias("duration_s"),
        "n_events",
    )


def p1_gap_profile(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and longest session per gap setting, all cut from one tree."""
    t = _tree(spark, d)
    at = F.explode(F.array(*(F.lit(s).cast("bigint") for s in PROFILE_S)))
    hit = t.select("*", at.alias("gap_s")).where("height <= gap_s * 1000000 and parent_height > gap_s * 1000000")
    return hit.groupBy("gap_s").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_questions"), F.max("n").alias("most_questions"))


QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions, "p1_gap_profile": p1_gap_profile}

_BASE = r"""
with q as (select distinct id, lower(regexp_replace(username, '^\s+|\s+$', '', 'g')) as username, created_at
           from query_history where created_at is not null and username is not null),
     g as (select *, date_diff('microsecond', lag(created_at) over w, created_at) as gap
           from q window w as (partition by username order by created_at, id))"""
_CUT = _BASE + """,
     s as (select *, sum(case when gap is null or gap > {us} then 1 else 0 end)
                     over (partition by username order by created_at, id rows unbounded preceding) as sn from g),
     r as (select username, sn, arg_min(id, (created_at, id)) as first_id, arg_max(id, (created_at, id)) as last_id,
                  min(created_at) as session_start, max(created_at) as session_end, count(*) as n_events
           from s group by username, sn)"""

ORACLE = {
    "p1_found": _CUT.format(us=GAP_S * 1_000_000) + " select username, first_id, last_id from r",
    "p1_sessions": _CUT.format(us=GAP_S * 1_000_000)
    + " select username, first_id, epoch_us(session_start) as start_us, epoch_us(session_end) as end_us, round(date_diff('microsecond', session_start, session_end) / 1000000.0, 3)::double as duration_s, n_events from r",
    "p1_gap_profile": _BASE
    + f""", t as (select unnest([{', '.join(map(str, PROFILE_S))}])::bigint as gap_s),
     s as (select gap_s, username, sum(case when gap is null or gap > gap_s * 1000000 then 1 else 0 end)
                  over (partition by gap_s, username order by created_at, id rows unbounded preceding) as sn from g, t),
     r as (select gap_s, username, sn, count(*) as n from s group by all)
     select gap_s, count(*) as n_sessions, sum(n)::bigint as n_questions, max(n) as most_questions from r group by gap_s""",
}
