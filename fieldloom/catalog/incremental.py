"""Streaming variants, run to completion on the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import sql as S
from fieldloom.catalog.sources import run_folder
from fieldloom.operators import pages
from fieldloom.sources import bindings
from fieldloom.sources.bindings import Tables
from fieldloom.sources.corpus import text_fingerprint
from fieldloom.streaming import status


PER_BATCH = 2  # files; tables of several part files run over several batches


def _stream(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = getattr(Tables(spark, path), table).schema
    return status.stream_parquet(spark, f"{path}/{table}.parquet", schema, per_batch=PER_BATCH)


def status_stream(spark: SparkSession, path: str) -> DataFrame:
    folder = run_folder(spark, "status")
    changes = _stream(spark, path, "events").select(
        F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status")
    )
    status.status_stream(changes, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return status.read_status(spark, f"{folder}/out").select("id", "status", "n_changes")


STATUS_SQL = """
SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_changes FROM events GROUP BY user_id
"""


def incremental_pages(spark: SparkSession, path: str) -> DataFrame:
    """Documents arrive as files; each is split into pages once."""
    folder = run_folder(spark, "pages")
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(bindings.page_header(i + 1), line))
    docs = _stream(spark, path, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    for _ in range(2):  # the second run finds nothing new
        status.incremental_pages(docs, f"{folder}/out", f"{folder}/checkpoint", pages.split_pages).awaitTermination()
    return status.read_batches(spark, f"{folder}/out", "doc_id long, page int, text string").drop("batch")


def dedup_uploads(spark: SparkSession, path: str) -> DataFrame:
    """The first document of each content, over several batches where the table has several files."""
    folder = run_folder(spark, "uploads")
    uploads = _stream(spark, path, "documents").select(
        text_fingerprint("text", 32).alias("fingerprint"), "doc_id", F.lit("2024-01-01").cast("timestamp").alias("ts"),
    )
    status.dedup_uploads(uploads, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return status.read_uploads(spark, f"{folder}/out").select("fingerprint", "doc_id")


QUERIES = {"status_stream": status_stream, "incremental_pages": incremental_pages, "dedup_uploads": dedup_uploads}
ORACLES = {
    "status_stream": STATUS_SQL,
    "incremental_pages": f"WITH {S.LINES} SELECT doc_id, page, text FROM pg",
    "dedup_uploads": "SELECT md5(text) AS fingerprint, min(doc_id) AS doc_id FROM documents GROUP BY 1",
}
