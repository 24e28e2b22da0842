"""Document files: listing, dispatch by suffix, and text extraction.

Files are read as ``binaryFile`` rows, so listing and reading are distributed.
PDF text needs a parser that the caller plugs in; DOCX is read with the standard
library.  A file that fails gives a null text and its error, never a failed job.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.operators.chunking import chunks as chunked

_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """``doc_name, path, content`` of the files of a folder; suffixes are case-sensitive."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(folder).select(file_name("path").alias("doc_name"), "path", "content")


def scan_files(spark: SparkSession, paths: list[str], suffix: str = ".pdf") -> DataFrame:
    """The same for a list of files; others than ``suffix`` are skipped."""
    own = [p for p in paths if p.endswith(suffix)]
    if not own:
        return spark.createDataFrame([], "doc_name string, path string, content binary")
    return spark.read.format("binaryFile").load(own).select(file_name("path").alias("doc_name"), "path", "content")


def file_name(path: str):
    return F.regexp_extract(path, r"[^/]+$", 0)


def file_kind(name: str):
    """``pdf``, ``docx``, ``image`` or ``other`` by the lower-cased suffix."""
    s = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    return F.when(s == ".pdf", "pdf").when(s == ".docx", "docx").when(s.isin(".png", ".jpg", ".jpeg"), "image").otherwise("other")


def docx_text(data: bytes) -> str:
    """Paragraph texts of a DOCX body joined by line ends; tables are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
    paras = [] if body is None else body.findall(f"{_NS}p")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_NS}t")) for p in paras)


def with_text(files: DataFrame, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """Adds ``kind, text, error``.  Images have an empty text; other files none."""

    @F.pandas_udf("text string, error string")
    def extract(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for k, c in zip(kind, content):
            try:
                if k == "docx":
                    rows.append((docx_text(c), None))
                elif k == "image":
                    rows.append(("", None))
                elif k == "pdf":
                    rows.append((pdf_text(c), None) if pdf_text else (None, "no PDF parser is set"))
                else:
                    rows.append((None, "this kind of file isn't read"))
            except Exception as x:  # noqa: BLE001 - any broken file
                rows.append((None, f"{type(x).__name__}: {x}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    out = files.withColumn("kind", file_kind("doc_name")).withColumn("x", extract("kind", "content"))
    return out.select("doc_name", "path", "kind", "x.text", "x.error")


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_name`` of a folder's PDFs, sorted; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(file_name("path").alias("doc_name")).orderBy("doc_name")


def stored_file(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The one file of a folder by its name; no rows if it is missing or lies outside."""
    path = safe_path(base, name)
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], "doc_name string, path string, content binary")
    return spark.read.format("binaryFile").load(path).select(file_name("path").alias("doc_name"), "path", "content")


def converted_tree(spark: SparkSession, folder: str, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """``out_path, text`` of every file of a tree that has a text; ``out_path`` keeps its place
    below the folder, with the suffix ``.txt``."""
    root = _path(spark, folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        raise FileNotFoundError(f"no folder: {folder}")
    base = fs.resolvePath(root).toUri().getPath().rstrip("/") + "/"
    files = with_text(scan_folder(spark, folder, "*", recursive=True), pdf_text).where("text is not null")
    below = F.substring_index(F.col("path"), base, -1)
    return files.select(F.concat(F.regexp_replace(below, r"\.[^./]*$", ""), F.lit(".txt")).alias("out_path"), "text")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _drop(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def delete_stored(spark: SparkSession, base: str, name: str) -> bool:
    """Delete one file of a folder; False if it is missing or lies outside.

    Its row and its audit event are mutations of the tables (``operators.store``), and
    its chunks stay in their collection.
    """
    path = safe_path(base, name)
    return bool(path) and _exists(spark, path) and _drop(spark, path)


def clear_folder(spark: SparkSession, folder: str) -> int:
    """Delete the files of a folder, not its subfolders, and return their number."""
    root = _path(spark, folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.listStatus(root) if s.isFile()] if fs.exists(root) else []
    return sum(1 for f in files if fs.delete(f, False))


#: Distance of a new collection.
METRIC = "cosine"


def collection_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Chunks of the named collections of a table partitioned by ``collection``.

    Only their partitions are read; unknown names give no rows.
    """
    return spark.read.parquet(path).where(F.col("collection").isin(names))


def open_or_create(spark: SparkSession, path: str, name: str, metric: str = METRIC) -> dict[str, str]:
    """Name and metric of a collection; a new one is noted beside the table, an old one keeps its metric."""
    known = collections(spark, path)
    if name not in known:
        spark.createDataFrame([(name, metric)], "name string, metric string").coalesce(1).write.mode("append").parquet(f"{path}/_collections")
        known[name] = metric
    return {"name": name, "metric": known[name]}


def collections(spark: SparkSession, path: str) -> dict[str, str]:
    """Metric by name of all collections; those that only hold chunks have the usual one."""
    out = {}
    if _exists(spark, path):
        root = _path(spark, path)
        parts = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
        out = {n.removeprefix("collection="): METRIC for s in parts if (n := s.getPath().getName()).startswith("collection=")}
    if _exists(spark, f"{path}/_collections"):
        out |= {r.name: r.metric for r in spark.read.parquet(f"{path}/_collections").collect()}  # one row per collection
    return out


def drop_collection(spark: SparkSession, path: str, name: str) -> bool:
    """Delete a collection's chunks and its note; False if there is none."""
    known = collections(spark, path)
    if name not in known:
        return False
    _drop(spark, f"{path}/collection={name}")
    rest = [(n, m) for n, m in known.items() if n != name]
    _drop(spark, f"{path}/_collections")
    if rest:
        spark.createDataFrame(rest, "name string, metric string").coalesce(1).write.parquet(f"{path}/_collections")
    return True


def append_chunks(chunks: DataFrame, path: str, embed: Callable[[Column], Column] | None = None) -> None:
    """Append to the collection table; ids already there are ignored, the first stays.

    With ``embed`` the new chunks, and only these, get a ``vector``, in Arrow batches.
    """
    spark = chunks.sparkSession
    if _exists(spark, path) and any(s.getPath().getName().startswith("collection=") for s in _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(_path(spark, path))):
        old = spark.read.parquet(path).select("collection", "chunk_id")
        chunks = chunks.join(old, ["collection", "chunk_id"], "left_anti")
    if embed is not None:
        chunks = chunks.withColumn("vector", embed(F.col("text")))
    chunks.write.mode("append").partitionBy("collection").parquet(path)


def ingest_folder(spark: SparkSession, folder: str, path: str, collection: str, embed: Callable[[Column], Column], pdf_text: Callable[[bytes], str] | None = None) -> None:
    """A folder's documents read, chunked, embedded and appended to a collection."""
    texts = with_text(scan_folder(spark, folder, "*"), pdf_text).where("text is not null")
    made = chunked(texts, "path", "doc_name", "text").select("chunk_id", "text", "metadata", F.lit(collection).alias("collection"))
    open_or_create(spark, path, collection)
    append_chunks(made.dropDuplicates(["collection", "chunk_id"]), path, embed)


def write_chunk_json(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, one object per chunk with its nested metadata."""
    chunks.select("chunk_id", "text", "metadata").write.mode("errorifexists").json(path)


def safe_path(base: str, name: str) -> str | None:
    """The path of a file inside ``base``, or None if the name leads out of it."""
    root = os.path.realpath(base)
    full = os.path.realpath(os.path.join(root, name))
    return full if os.path.commonpath([root, full]) == root and full != root else None
