"""Streaming ingest: documents that arrive, as rows or as files, are chunked and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorikeet.operators.chunking import chunks
from lorikeet.sources.files import append_chunks, file_name, with_text

SCHEMA = "doc_name string, collection string, text string"


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Documents of the Parquet files dropped into a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upload_stream(spark: SparkSession, folder: str, collection: str, pdf_text: Callable[[bytes], str] | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Documents of the files dropped into a folder; files without a text are left out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    texts = with_text(files.select(file_name("path").alias("doc_name"), "path", "content"), pdf_text)
    return texts.where("text is not null").select("doc_name", F.lit(collection).alias("collection"), "text")


def ingest(stream: DataFrame, table_path: str, checkpoint: str, embed: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """Chunks every micro-batch and appends it; repeated batches add nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        made = chunks(batch.withColumn("k", batch["collection"]), "k", "doc_name", "text").withColumnRenamed("key", "collection")
        append_chunks(made.dropDuplicates(["collection", "chunk_id"]), table_path, embed)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
