"""A training-corpus pipeline: reject toxic texts, drop near-duplicates and benchmark leaks, mask personal data, mix sources.

Every stage reads all columns of its input and, but for the last, returns them; helper columns are called ``__…`` so
that extra columns of the input cannot clash with them. Empty tables pass through. Nulls: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import contamination, jaccard, mixing, pii, shared, toxicity
from fieldloom.llm.shared import Scratch, table

TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; null and empty texts stay."""
    field = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, field, spark).filter(F.col("score") < TOXIC).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join: the one with the smallest doc_id.

    A document without doc_id or without words links with nothing and stays. Rows that repeat one another completely
    give one row; other rows of one doc_id are one document and stay or go together. Only the rows that may have to go
    are moved.
    """
    scratch = Scratch(spark, "pipeline")
    groups = scratch.keep(jaccard.jaccard_components(docs, spark))
    gone = scratch.keep(groups.filter("component_id != doc_id").select("doc_id").distinct())
    repeated = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    concerned = shared.may_be_in(scratch.keep(gone.unionByName(repeated).distinct()), F.col("doc_id"))
    left = docs.filter(concerned).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return docs.filter(~concerned).unionByName(left.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and short texts stay. Only rows that may hold one are moved."""
    leaks = contamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), spark)
    found = Scratch(spark, "pipeline").keep(leaks.select(F.col("row_hash").alias("__row")).distinct())
    concerned = shared.may_be_in(found, contamination.row_hash())
    clean = docs.filter(concerned).withColumn("__row", contamination.row_hash()).join(found, "__row", "left_anti")
    return docs.filter(~concerned).unionByName(clean.select(docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text. Null texts stay null."""
    found = pii.find_pii(docs, into="__pii").withColumn("text", pii.masked(F.col("text").cast("string"), F.col("__pii"))).drop("__pii")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as it is taken, numbered by ``copy`` from 1; documents not taken leave.

    Rows that repeat one another completely are numbered on their own, so a copy number may repeat among them.
    """
    taken = mixing.mix_sources(docs, spark).filter("copies > 0").groupBy(F.col("row_hash").alias("__row")).agg(F.max("copies").alias("__copies"))
    # Most rows have a part, so texts and copies meet by shuffle at any size.
    chosen = docs.withColumn("__row", mixing.row_hash()).hint("merge").join(Scratch(spark, "pipeline").keep(taken), "__row")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[c for c in docs.columns if c != "copy"], "copy")


STAGES = [
    ("reject_toxic", reject_toxic), ("deduplicate", deduplicate), ("decontaminate", decontaminate),
    ("mask_personal_data", mask_personal_data), ("mix", mix),
]
ORACLE_SQL = None  # the toxicity field and the rounding draws are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.keep(docs)
    return docs
