"""Reads and mutations of the operational tables, as plans over snapshots.

A mutation gives the new snapshot as a DataFrame; writing it to a new path is the
caller's.  Nothing here overwrites what it reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorikeet.session import cut_lineage

#: The operational tables, as Spark types.
SCHEMAS = {
    "users": "username string, role string, salt string, password_hash string, password_algo string, failed_attempts int, locked_until timestamp, last_login_at timestamp, created_at timestamp",
    "uploaded_files": "id bigint, filename string, scope string, username string, size_bytes bigint, uploaded_at timestamp",
    "audit_events": "id bigint, username string, role string, event_type string, resource_type string, resource_id string, metadata string, ip string, user_agent string, created_at timestamp",
    "query_history": "id bigint, username string, role string, scope string, question string, answer string, justification string, sources array<struct<document:string,section:string,text:string>>, created_at timestamp",
}
#: Columns that must not be null, by table.
REQUIRED = {"users": ["username", "role"], "uploaded_files": ["id", "filename", "scope"], "audit_events": ["id", "event_type"], "query_history": ["id", "username", "question"]}
#: What an appended row has where it gives nothing; a function of the column's type.
AUDIT_DEFAULTS: dict[str, Callable[[str], Column]] = {"metadata": lambda kind: F.lit("{}").cast(kind), "created_at": lambda kind: F.current_timestamp().cast(kind)}
HISTORY_DEFAULTS: dict[str, Callable[[str], Column]] = {"sources": lambda kind: F.array().cast(kind), "created_at": lambda kind: F.current_timestamp().cast(kind)}


def empty_table(spark, name: str) -> DataFrame:
    """A table of the schema, without rows."""
    return spark.createDataFrame([], SCHEMAS[name])


def missing_values(df: DataFrame, name: str) -> DataFrame:
    """Rows that break the table's rule of columns that must not be null."""
    bad = F.lit(False)
    for c in REQUIRED[name]:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def numbered(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """Rows numbered from 1 in an order, without bringing them to one task.

    The rows are cut into ranges of the order; a range's first number is the count
    of the ranges before, one row per range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # As many rows as ranges, so the window and the broadcast have a fixed size.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.withColumn("_own", F.row_number().over(own)).join(F.broadcast(before), "_range").withColumn(number, (F.col("_before") + F.col("_own")).cast("bigint")).drop("_range", "_own", "_before")


def append_rows(old: DataFrame, new: DataFrame, key: str, tie: str, defaults: dict[str, Callable[[str], Column]], time: str = "created_at") -> DataFrame:
    """``old`` and behind it ``new`` with keys that go on from the largest, in order of time.

    Columns that ``new`` lacks, or has null, get their default, others null; ``tie``
    orders equal times and is left out unless ``old`` has it.
    """
    last = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    rows = numbered(new, [time, tie], "_number").crossJoin(F.broadcast(last))  # one row
    kinds = {f.name: f.dataType.simpleString() for f in old.schema.fields}

    def column(c: str) -> Column:
        if c == key:
            return (F.col("_last") + F.col("_number")).cast(kinds[c]).alias(c)
        given = F.col(c).cast(kinds[c]) if c in new.columns else F.lit(None).cast(kinds[c])
        return (F.coalesce(given, defaults[c](kinds[c])) if c in defaults else given).alias(c)

    return old.unionByName(rows.select(*(column(c) for c in old.columns)))


def register(users: DataFrame, names: DataFrame, reserved: list[str], role: str = "user") -> DataFrame:
    """``users`` and those ``names`` that are neither reserved nor taken, with their defaults.

    Null names are left out and repeated ones count once.
    """
    new = names.select("username").where(F.col("username").isNotNull() & ~F.col("username").isin(reserved)).distinct()
    return insert_absent(users, new.withColumns({"role": F.lit(role), "failed_attempts": F.lit(0)}), "username")


def newest(df: DataFrame, condition: Column, time: str, tie: str, n: int | None = None) -> DataFrame:
    """Matching rows, newest first, rows without a time before all others."""
    out = df.where(condition).orderBy(F.desc_nulls_first(time), F.desc(tie))
    return out if n is None else out.limit(n)


def upsert(old: DataFrame, new: DataFrame, key: str, replaced: list[str]) -> DataFrame:
    """``old`` overlaid with ``new``: the replaced columns of known keys change, the
    others stay; unknown keys are added with nulls where ``new`` has no column.

    Keys of ``new`` must be unique.
    """
    n = new.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in replaced), F.lit(True).alias("_new"))
    both = old.join(n, F.col(key) == F.col("_k"), "full_outer")
    cols = [F.coalesce(key, "_k").alias(key) if c == key else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in old.columns]
    return both.select(*cols)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key is not there yet."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def delete_matching(df: DataFrame, condition: Column) -> DataFrame:
    """Without the rows for which the condition holds; rows where it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def latest_per(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key, by an aggregate of structs that combines before the
    shuffle; rows without a time are the oldest."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("_t"), F.col(tie).alias("_i"), F.struct(*rest).alias("_r"))).alias("_m"))
    return best.select(*keys, "_m._r.*").select(*df.columns)


def with_defaults(df: DataFrame, **defaults: Column) -> DataFrame:
    """Nulls of the named columns replaced."""
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def existing(df: DataFrame, other: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows of ``df`` whose ``left`` is some row's ``right`` of ``other``, each once."""
    keys = other.select(right.alias("_key"))
    return df.join(keys, left == keys["_key"], "left_semi")


def json_field(c: Column | str, path: str) -> Column:
    """A value of a JSON text; null for null, empty or broken JSON."""
    return F.get_json_object(c, path)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; ranks are limited before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
