"""Quality figures and the document registry.

All figures are aggregates with map-side combining. Where an order within a document matters,
the window runs over bounded buckets of that order, never over all rows of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import formats
from fieldloom.functions import patterns as P
from fieldloom.functions.text import as_col

HIGH, MEDIUM = 0.8, 0.6
SLOW_SECONDS = 5.0


# --------------------------------------------------------------------------------- scores
def tier(score: Column | str, high: float = HIGH, medium: float = MEDIUM) -> Column:
    s = F.coalesce(as_col(score), F.lit(0.0))
    return F.when(s >= high, "high").when(s >= medium, "medium").otherwise("low")


def confidence_tiers(results: DataFrame, by: list[str] = (), high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    t = tier("score", high, medium)
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_keys"),
        *[F.count_if(t == name).alias(f"{name}_confidence") for name in ("high", "medium", "low")],
    )


def tier_percentages(tiers: DataFrame) -> DataFrame:
    def pct(name: str) -> Column:
        share = F.col(f"{name}_confidence") * 100 / F.col("total_keys")
        return F.when(F.col("total_keys") > 0, F.round(share)).otherwise(0).cast("int").alias(f"{name}_pct")

    keep = [c for c in tiers.columns if not c.endswith("_confidence")]
    return tiers.select(*keep, pct("high"), pct("medium"), pct("low"))


def avg_confidence(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Mean score per document, missing scores as zero, documents without results as zero."""
    per_doc = results.groupBy("doc_id").agg(F.avg(F.coalesce("score", F.lit(0))).alias("mean"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.round(F.coalesce("mean", F.lit(0.0)), 3).alias("avg_confidence")
    )


def model_call_stats(results: DataFrame, by: list[str] = ()) -> DataFrame:
    calls = F.coalesce("llm_calls", F.lit(0))
    return results.groupBy(*by).agg(
        F.sum(calls).alias("total_llm_calls"),
        F.count_if(calls == 0).alias("keys_no_llm"),
        F.round(F.sum(calls) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("avg_llm_per_key"),
    )


def registry_stats(registry: DataFrame) -> DataFrame:
    """One row of dashboard figures. Dates are ISO texts; unreadable ones are left out."""
    done = F.col("status") == "completed"
    begun = F.try_to_timestamp("created_at")
    ended = F.try_to_timestamp("completed_at")
    seconds = F.when(done, F.unix_micros(ended) / 1e6 - F.unix_micros(begun) / 1e6)
    fields = F.when(seconds.isNotNull(), F.coalesce("total_keys", F.lit(0)))
    total, completed = F.count(F.lit(1)), F.count_if(done)
    rate = F.when(total > 0, F.round(completed * 100 / total, 1)).otherwise(0.0)
    per_field = F.when(F.sum(fields) > 0, F.round(F.sum(seconds) / F.sum(fields), 2)).otherwise(0.0)
    return registry.agg(
        total.alias("total_documents"),
        completed.alias("completed_count"),
        F.count_if(F.col("status") == "processing").alias("processing_count"),
        F.coalesce(rate, F.lit(0.0)).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(done, F.col("avg_confidence"))), F.lit(0.0)), 3).alias("avg_confidence"),
        F.coalesce(per_field, F.lit(0.0)).alias("avg_processing_time"),
    )


def count_by_type(registry: DataFrame) -> DataFrame:
    return registry.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))


def step_timings(log: DataFrame, slow: float = SLOW_SECONDS) -> DataFrame:
    """``log``: run_id, step, ts. Neighbouring entries of one step are one interval, from the first to the last of them.

    A step that a run enters again after another one has a row for each time (``entry``, from 1) with the time of that
    interval alone. Entries are put in order once per run; sums and shares are taken over the few intervals.
    Entries of one time are ordered by step.
    """
    within = W.partitionBy("run_id").orderBy("ts", "step")
    goes_on = (F.row_number().over(within) > 1) & F.lag("step").over(within).eqNullSafe(F.col("step"))
    begun = log.select("run_id", "step", "ts", F.when(goes_on, 0).otherwise(1).alias("begins"))
    placed = begun.withColumn("nth", F.sum("begins").over(within.rowsBetween(W.unboundedPreceding, 0)))
    intervals = placed.groupBy("run_id", "nth", "step").agg(
        F.min("ts").alias("started"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration")
    )
    run = W.partitionBy("run_id")
    longest = F.max("duration").over(run)
    return intervals.select(
        "run_id", "step", F.row_number().over(W.partitionBy("run_id", "step").orderBy("nth")).alias("entry"), "started", "duration",
        F.sum("duration").over(run).alias("run_total"),
        F.when(longest > 0, F.round(F.col("duration") * 100 / longest)).otherwise(0).cast("int").alias("pct_of_max"),
        (F.col("duration") >= slow).alias("is_slow"),
    )


# ------------------------------------------------------------------------------- listings
def list_documents(
    registry: DataFrame, search: str = "", status: str = "", limit: int | None = None, match_id: bool = False
) -> DataFrame:
    """Newest first; all of them, or the first ``limit``: a listing's page size."""
    out = registry
    if search:
        hit = F.contains(F.lower("name"), F.lit(search.lower()))
        if match_id:
            hit = hit | F.contains(F.col("id").cast("string"), F.lit(search))
        out = out.filter(hit)
    if status and status != "all":
        out = out.filter(F.col("status") == status)
    out = out.orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def get_document(registry: DataFrame, doc_id) -> DataFrame:
    return registry.filter(F.col("id") == doc_id)


def filter_results(
    results: DataFrame, search: str = "", agent: str = "", fmt: str = "", confidence: str = "",
    high: float = 80, medium: float = 50,
) -> DataFrame:
    pct = formats.percent_of_score("score")
    out = results
    if search:
        needle = F.lit(search.lower())
        out = out.filter(
            F.contains(F.lower("key_name"), needle) | F.contains(F.lower(F.coalesce("value", F.lit(""))), needle)
        )
    if agent:
        out = out.filter(F.col("agent_used") == agent)
    if fmt:
        out = out.filter(F.col("expected_format") == fmt)
    bands = {"high": pct >= high, "medium": (pct >= medium) & (pct < high), "low": pct < medium}
    return out.filter(bands[confidence]) if confidence else out


def step_label(step: Column | str) -> Column:
    return formats._lookup(as_col(step), P.STEP_LABELS, as_col(step))


def status_view(registry: DataFrame) -> DataFrame:
    step = F.coalesce("pipeline_step", F.lit(""))
    zero = F.lit(0)
    return registry.select(
        "id", "status", step.alias("pipeline_step"), step_label(step).alias("step_label"),
        F.coalesce("progress", zero).alias("progress"), F.coalesce("total_keys", zero).alias("total_keys"),
        F.coalesce("processed_keys", zero).alias("processed_keys"), "error_msg",
    )


def registry_state(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Current registry from an append-only change log: id, ts, seq, op, fields.

    ``op`` is insert, update or delete; ``fields`` maps column names to new values (an explicit
    NULL clears). One aggregate per document id, so a document with very many changes is
    combined within each task before the shuffle.
    """
    at = F.struct("ts", "seq")
    is_insert = F.col("op") == "insert"

    def latest(c: str) -> Column:
        touched = (F.col("op") != "delete") & F.map_contains_key("fields", F.lit(c))
        moved = F.when(touched, F.struct(at.alias("at"), F.try_element_at("fields", F.lit(c)).alias("v")))
        return F.max_by(moved, F.when(touched, at)).alias(c)

    folded = changes.groupBy("id").agg(
        F.max(F.when(is_insert, at)).alias("born"),
        F.max(F.when(F.col("op") == "delete", at)).alias("gone"),
        *[latest(c) for c in columns],
    )
    alive = folded.filter(F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("born") > F.col("gone"))))
    return alive.select("id", *[
        F.when(F.col(f"{c}.at") >= F.col("born"), F.col(f"{c}.v")).alias(c) for c in columns
    ])


def running_count(
    rows: DataFrame, group: list[str], order: list[str], bucket: Column, name: str = "done", total: str | None = None
) -> DataFrame:
    """Position of each row in its group, one-based, without sorting a whole group in one task; on demand the group's size.

    ``bucket`` must grow with the order. Rows are ranked within their bucket; the sizes of the
    earlier buckets of the group, a far smaller table, are added.
    """
    cut = rows.withColumn("_bucket", bucket)
    inner = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order))
    sizes = cut.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           *([F.sum("_n").over(W.partitionBy(*group)).alias(total)] if total else []))
    return (
        cut.withColumn("_inner", inner)
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_inner") + F.col("_before"))
        .drop("_bucket", "_inner", "_before")
    )


def progress(results: DataFrame, bucket_size: int = 4096, bucket: Column | None = None) -> DataFrame:
    """Progress after each finished key: 50 plus 40 times the finished share.

    ``bucket`` replaces the share of ``key_id`` where keys are no numbers; it must grow with them.
    """
    done = running_count(results, ["doc_id"], ["key_id"], F.floor(F.col("key_id") / bucket_size) if bucket is None else bucket,
                         total="total_keys")
    share = F.col("done") * 40.0 / F.greatest(F.col("total_keys"), F.lit(1))
    return done.withColumn("progress", F.round(share + 50, 1))


def milestone(step: Column | str) -> Column:
    return formats._lookup(as_col(step), P.MILESTONES, F.lit(0.0))


# What the response says about each field.
RESPONSE_FIELDS = ["key_id", "key_name", "key_desc", "value", "score", "reason", "page", "expected_format", "format_valid", "found_in", "rule_context"]


def result_response(registry: DataFrame, results: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Registry row, its fields in key order and its text; a document that is not completed gets an empty shell.

    ``results``: doc_id and RESPONSE_FIELDS. ``texts``: doc_id, text. Only results of completed documents are
    collected, one struct per key of the template, within each task first.
    """
    done = F.col("status") == "completed"
    completed = registry.filter(done).select(F.col("id").alias("doc_id"))
    fields = results.join(completed, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(*RESPONSE_FIELDS))).alias("found"))
    kind = fields.schema["found"].dataType.simpleString()
    out = registry.join(fields, "id", "left")
    if texts is not None:
        out = out.join(texts.join(completed, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("text").alias("ocr_text")), "id", "left")
    else:
        out = out.withColumn("ocr_text", F.lit(None).cast("string"))
    subtype = F.col("doc_subtype") if "doc_subtype" in registry.columns else F.lit(None).cast("string")
    zero, found = F.lit(0), F.coalesce("found", F.array().cast(kind))
    return out.select(
        "id", "name", "document_type", subtype.alias("doc_subtype"), "status", "pipeline_step", "created_at",
        F.when(~done, F.coalesce("progress", zero)).cast("double").alias("progress"),
        F.size(found).alias("total_keys"),
        F.when(done, F.coalesce("avg_confidence", zero)).otherwise(zero).cast("double").alias("avg_confidence"),
        F.when(done, F.coalesce("total_pages", zero)).otherwise(zero).alias("total_pages"),
        F.when(~done, F.col("error_msg")).alias("error_msg"), found.alias("fields"), F.coalesce("ocr_text", F.lit("")).alias("ocr_text"),
    )


def result_fields(registry: DataFrame, results: DataFrame) -> DataFrame:
    """The field rows of completed documents."""
    done = registry.filter("status = 'completed'").select(F.col("id").alias("doc_id"))
    return results.join(done, "doc_id", "left_semi")
