"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "lorikeet", **conf: str) -> SparkSession:
    """A ``local[n]`` session for tests and benchmarks; clusters bring their own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    A local master may do without; there, and only there, a temporary one is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lorikeet-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


_WRITTEN: dict[str, None] = {}


def scratch(spark: SparkSession) -> str:
    """The path of a new folder below the shared one; it goes with the intermediate tables."""
    path = f"{shared_dir(spark)}/lorikeet-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    _WRITTEN[path] = None
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lost executors then cost no more than the tasks they ran.  ``release`` deletes
    one such table, ``end_query`` all; what is left goes when the session ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.pop(path, None)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(table: DataFrame) -> None:
    """Delete a table of ``cut_lineage`` that no later step reads, such as a round's input."""
    if path := table.__dict__.get("written_at"):
        _delete(table.sparkSession, path)


def end_query(spark: SparkSession) -> int:
    """Delete all intermediate tables once a query's result is written; gives their number.

    DataFrames that read them can't be run again.
    """
    paths = list(_WRITTEN)
    for p in paths:
        _delete(spark, p)
    return len(paths)
