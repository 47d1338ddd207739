"""Reading documents, fingerprints, and the page cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import as_col

def load_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents as ``doc_id, text, …``. A missing path is an error, raised by Spark at once.

    ``parquet`` keeps its columns. ``text`` reads each file as one document, with the file path
    as ``source`` and a stable hash of it as ``doc_id``.
    """
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(
            F.xxhash64(F.input_file_name()).alias("doc_id"),
            F.col("value").alias("text"),
            F.input_file_name().alias("source"),
        )
    return spark.read.format(fmt).load(path)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files with their fingerprint, for the page cache."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", content_fingerprint("content").alias("fingerprint"))


def content_fingerprint(content: Column | str, digits: int = 10, head_bytes: int | None = None) -> Column:
    """MD5 of the content, or of its first ``head_bytes`` if given, shortened."""
    content = as_col(content)
    return F.substring(F.md5(content if head_bytes is None else F.substring(content, 1, head_bytes)), 1, digits)


def text_fingerprint(text: Column | str, digits: int = 10) -> Column:
    return content_fingerprint(F.encode(as_col(text), "UTF-8"), digits)


def cache_key(name: Column, fingerprint: Column, version: str) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat_ws("_", stem, fingerprint, F.lit(version))


def skip_processed(pages: DataFrame, cached: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split pages into (reused from the cache, still to run).

    A cache entry without a text counts as missing, repeated entries of a page as one (the
    greatest text, so that reruns agree). Both are joins on the page keys; the cache side
    carries only what is needed.
    """
    usable = cached.filter(F.col("cached_text").isNotNull()).groupBy(*keys).agg(F.max("cached_text").alias("cached_text"))
    return pages.join(usable, keys), pages.join(usable.select(*keys), keys, "left_anti")
