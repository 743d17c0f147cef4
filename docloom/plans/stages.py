"""The batch stages: pages to Markdown, Markdown to chunks, chunks to vectors, vectors to a collection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import urls
from docloom.functions.chunking import CHUNK, chunk_rows
from docloom.functions.html_md import page_attempt
from docloom.operators import dense

SUMMARY = ("has_code", "has_table", "has_list")
#: Bytes between Spark and Python at once; without it, 10,000 texts of any length and all that is made of them.
BATCH_BYTES, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded(rows: DataFrame) -> DataFrame:
    """rows, of which Python gets MOST bytes at once, unless the session says otherwise."""
    conf = rows.sparkSession.conf
    if BATCH_BYTES not in conf.getAll:
        conf.set(BATCH_BYTES, MOST)
    return rows


def dealt(rows: DataFrame, each: int) -> DataFrame:
    """rows in parts of about `each`. A file of short rows is one task, however long what is made of them takes."""
    return rows.repartition(max(1, -(-rows.count() // each)))


def struct_pages(pages: DataFrame) -> DataFrame:
    """url, md, status, chars, error: failures are rows, not the end of the job."""
    made = bounded(pages).select("url", page_attempt(F.col("html")).alias("__m")).select("url", "__m.md", "__m.error")
    return made.select("url", "md", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.char_length("md").cast("long").alias("chars"), "error")


def struct_totals(records: DataFrame) -> DataFrame:
    """One row about struct_pages(): total_inputs, converted_total, errors_total, chars_total."""
    ok = F.col("status") == "ok"
    return records.agg(F.count("*").alias("total_inputs"), F.count_if(ok).alias("converted_total"), F.count_if(~ok).alias("errors_total"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars_total"))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """One row about chunk(): docs_processed, chunks_total, chars_total."""
    return chunks.agg(F.count_distinct("version_bucket", "doc_key").alias("docs_processed"), F.count("*").alias("chunks_total"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars_total"))


def embed_totals(vectors: DataFrame) -> DataFrame:
    """One row about embed(): vectors_total, embedding_dim."""
    return vectors.agg(F.count("*").alias("vectors_total"), F.max("embedding_dim").alias("embedding_dim"))


def point_id(chunk_id: Column) -> Column:
    """The unsigned 64-bit number of the first half of the id's hash, as text."""
    return F.conv(F.substring(F.sha1(chunk_id.cast("binary")), 1, 16), 16, 10)


def content_hash(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def chunk_id(bucket: Column, source: Column, index: Column, digest: Column) -> Column:
    return F.sha1(F.concat_ws("|", bucket, source, index.cast("string"), digest).cast("binary"))


def chunk(docs: DataFrame, base_url: str = "https://docs.example.com") -> DataFrame:
    """The chunk records of docs(version_bucket, doc_key, text): no shuffle; keys are native columns."""
    source = F.concat_ws("/", "version_bucket", "doc_key")
    rows = chunk_rows(bounded(docs).select("version_bucket", source.alias("source_md"), "doc_key", "text"), "text", "source_md")
    rows = rows.select("version_bucket", "source_md", "doc_key", "chunk_index", "chunk_count_in_doc", *CHUNK.fieldNames())
    link = urls.source_url(base_url, F.col("version_bucket"), F.col("doc_key"))
    rows = rows.withColumns({"content_hash": content_hash(F.col("content")), "source_url": link, "source_url_with_anchor": urls.with_anchor(link, F.col("section_anchor")), "char_count": F.char_length("content").cast("long")})
    return rows.withColumn("id", chunk_id(F.col("version_bucket"), F.col("source_md"), F.col("chunk_index"), F.col("content_hash")))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Documents and chunks of each bucket."""
    return chunks.groupBy("version_bucket").agg(F.count_distinct("doc_key").alias("docs"), F.count("*").alias("chunks"), F.sum("char_count").alias("chars"), *[F.count_if(c).alias(c) for c in SUMMARY])


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector yet."""
    return chunks.join(vectors.select("id").distinct(), "id", "left_anti")


def embed(chunks: DataFrame, model: Callable[[list[str]], np.ndarray], name: str, batch: int = 16) -> DataFrame:
    rows = bounded(chunks).withColumn("vector", dense.embed(F.col("content"), model, batch))
    return rows.withColumns({"embedding_model": F.lit(name), "embedding_dim": F.size("vector").cast("long"), "point_id": point_id(F.col("id"))})


def dim_check(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row: how many vectors, the least and the largest dimension, and whether they agree."""
    n = F.size(vector_col)
    return vectors.agg(F.count("*").alias("vectors"), F.min(n).cast("long").alias("min_dim"), F.max(n).cast("long").alias("max_dim"), (F.min(n) == F.max(n)).alias("consistent"))
