"""Queries over stored files: the uploads of a table written as files, then read as any user would.

Every upload becomes one small file under ``shared/`` or ``personal/<user>/`` of a new
folder in the shared one; the files are written by the tasks, whole and then named, so
a task that runs twice does no harm.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorikeet.operators.embedding import hashed_vector
from lorikeet.session import scratch
from lorikeet.sources import files as S
from lorikeet.sources.tables import table
from lorikeet.streaming.ingest import ingest, upload_stream

MARK = "the stored file has the mark "
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def pdf_text(data: bytes) -> str:
    """The stand-in of a PDF parser: these files hold their text as it is."""
    return data.decode()


def docx(text: str) -> bytes:
    """A DOCX file of one paragraph a line."""
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _local(path: str) -> str:
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise NotImplementedError(f"files are written by path only, not to {at.scheme}")
    return at.path


def stored(spark: SparkSession, d: str) -> str:
    """The folder that holds a file for every upload."""
    base = _local(scratch(spark))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, name, mark in zip(*(c.to_pylist() for c in b.columns)):
                text = f"Summary\n{MARK}{mark}."
                os.makedirs(f"{base}/{place}", exist_ok=True)
                held = f"{base}/{place}/.{name}.{os.getpid()}"
                with open(held, "wb") as f:
                    f.write(docx(text) if name.lower().endswith(".docx") else text.encode())
                os.replace(held, f"{base}/{place}/{name}")
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    u = table(spark, d, "uploaded_files").where("scope = 'shared' or username is not null")
    place = F.when(F.col("scope") == "shared", "shared").otherwise(F.concat(F.lit("personal/"), "username"))
    u.select(place.alias("place"), "filename", F.md5("filename").alias("mark")).distinct().mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return base


def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """PDFs of the shared folder and their texts; suffixes are case-sensitive."""
    return S.with_text(S.scan_folder(spark, f"{stored(spark, d)}/shared"), pdf_text).select("doc_name", "kind", "text", F.coalesce("error", F.lit("")).alias("error"))


def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every file of the tree by kind; one without a parser has its error."""
    base = stored(spark, d)
    t = S.with_text(S.scan_folder(spark, base, "*", recursive=True))
    return t.select(F.substring_index("path", f"{base}/", -1).alias("place"), "doc_name", "kind", F.coalesce("text", F.lit("-")).alias("text"), F.coalesce("error", F.lit("")).alias("error"))


def tree_converted(spark: SparkSession, d: str) -> DataFrame:
    """The tree as texts in the same layout."""
    return S.converted_tree(spark, stored(spark, d), pdf_text)


def files_listed(spark: SparkSession, d: str) -> DataFrame:
    """PDFs of the shared folder in order of their names."""
    return S.list_pdfs(spark, f"{stored(spark, d)}/shared")


def files_picked(spark: SparkSession, d: str) -> DataFrame:
    """A list of two files, of which only the PDF is read, and single look-ups inside and outside the folder."""
    base = f"{stored(spark, d)}/shared"
    names = table(spark, d, "uploaded_files").where("scope = 'shared'").agg(F.min(F.when(F.col("filename").endswith(".pdf"), F.col("filename"))), F.min(F.when(F.col("filename").endswith(".png"), F.col("filename")))).first()
    own = [n for n in names if n]
    out = S.scan_files(spark, [f"{base}/{n}" for n in own]).select(F.lit("list").alias("how"), "doc_name", F.length("content").alias("size"))
    for n in [*own, "../personal", "no such file.pdf"]:
        out = out.unionByName(S.stored_file(spark, base, n).select(F.lit("one").alias("how"), "doc_name", F.length("content").alias("size")))
    return out


def files_ingested(spark: SparkSession, d: str) -> DataFrame:
    """The shared folder chunked, embedded and appended twice to a collection, read back."""
    base, path = f"{stored(spark, d)}/shared", scratch(spark)
    for _ in range(2):
        S.ingest_folder(spark, base, path, "shared", hashed_vector, pdf_text)
    c = S.collection_table(spark, path, ["shared"])
    return c.select("chunk_id", "metadata.document_name", "metadata.section_heading", "text", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("n_tokens"))


def files_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The shared folder as a file drop, ingested as a stream that is started twice."""
    base, path, state = f"{stored(spark, d)}/shared", scratch(spark), scratch(spark)
    for _ in range(2):
        ingest(upload_stream(spark, base, "dropped", pdf_text), path, state).awaitTermination()
    return S.collection_table(spark, path, ["dropped"]).select("collection", "chunk_id", "text")


def collection_admin(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table split into collections; two more are opened and one is dropped."""
    path = scratch(spark)
    c = table(spark, d, "chunk").where("chunk_id is not null and text is not null and collection is not null")
    S.append_chunks(c.groupBy("collection", "chunk_id").agg(F.min("text").alias("text")), path)
    S.open_or_create(spark, path, "new", "l2")
    S.open_or_create(spark, path, "gone")
    S.drop_collection(spark, path, "gone")
    held = spark.createDataFrame(sorted(S.collections(spark, path).items()), "collection string, metric string")
    n = spark.read.parquet(path).groupBy(F.col("collection").alias("c")).agg(F.count("*").alias("n"))
    return held.join(n, F.col("collection") == F.col("c"), "left").select("collection", "metric", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def chunks_as_json(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table written as JSON and read back."""
    path = f"{scratch(spark)}/chunks"
    c = table(spark, d, "chunk")
    S.write_chunk_json(c, path)
    back = spark.read.schema(c.select("chunk_id", "text", "metadata").schema).json(path)
    return back.select("chunk_id", F.md5("text").alias("text_md5"), "metadata.document_name", "metadata.section_heading")


QUERIES = {f.__name__: f for f in (folder_scan, folder_tree, tree_converted, files_listed, files_picked, files_ingested, files_streamed, collection_admin, chunks_as_json)}

_U = f"""with u as (select distinct case when scope = 'shared' then 'shared' else 'personal/' || username end as place, filename as doc_name, lower(regexp_extract(filename, '[.][^.]*$')) as suffix,
    'Summary' || chr(10) || '{MARK}' || md5(filename) || '.' as text, '{MARK}' || md5(filename) || '.' as body from uploaded_files where scope = 'shared' or username is not null)"""
_KIND = "case when suffix = '.pdf' then 'pdf' when suffix = '.docx' then 'docx' when suffix in ('.png', '.jpg', '.jpeg') then 'image' else 'other' end"

ORACLE = {
    "folder_scan": f"{_U} select doc_name, 'pdf' as kind, text, '' as error from u where place = 'shared' and suffix(doc_name, '.pdf')",
    "folder_tree": f"""{_U} select place || '/' || doc_name as place, doc_name, {_KIND} as kind, case when {_KIND} = 'docx' then text when {_KIND} = 'image' then '' else '-' end as text,
        case when {_KIND} = 'pdf' then 'no PDF parser is set' when {_KIND} = 'other' then 'this kind of file isn''t read' else '' end as error from u""",
    "tree_converted": f"{_U} select place || '/' || regexp_replace(doc_name, '[.][^./]*$', '') || '.txt' as out_path, case when {_KIND} = 'image' then '' else text end as text from u where {_KIND} <> 'other'",
    "files_listed": f"{_U} select doc_name from u where place = 'shared' and suffix(doc_name, '.pdf')",
    "files_picked": f"""{_U}, p as (select min(doc_name) as n from u where place = 'shared' and suffix(doc_name, '.pdf')), g as (select min(doc_name) as n from u where place = 'shared' and suffix(doc_name, '.png')),
        s as (select doc_name, length(text)::int as size from u where place = 'shared')
        select 'list' as how, doc_name, size from s join p on n = doc_name union all select 'one', doc_name, size from s join p on n = doc_name union all select 'one', doc_name, size from s join g on n = doc_name""",
    "files_ingested": f"""{_U} select doc_name || '_0' as chunk_id, doc_name as document_name, 'Summary' as section_heading, body as text, len(regexp_extract_all(lower(body), '[a-z0-9]+'))::double as n_tokens
        from u where place = 'shared' and suffix in ('.pdf', '.docx')""",
    "files_streamed": f"{_U} select 'dropped' as collection, doc_name || '_0' as chunk_id, body as text from u where place = 'shared' and suffix in ('.pdf', '.docx')",
    "collection_admin": """select collection, 'cosine' as metric, count(distinct chunk_id) as n_chunks from chunk where chunk_id is not null and text is not null and collection is not null group by collection union all select 'new', 'l2', 0""",
    "chunks_as_json": "select chunk_id, md5(text) as text_md5, metadata.document_name as document_name, metadata.section_heading as section_heading from chunk",
}
