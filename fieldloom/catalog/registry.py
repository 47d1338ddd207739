"""Quality figures and registry listings on orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import sql as S
from fieldloom.functions import formats
from fieldloom.functions import patterns as P
from fieldloom.operators import registry
from fieldloom.sources import bindings
from fieldloom.sources.bindings import Tables


def _res(spark: SparkSession, path: str) -> DataFrame:
    return bindings.lineitem_results(Tables(spark, path))


def _reg(spark: SparkSession, path: str) -> DataFrame:
    return bindings.order_registry(Tables(spark, path))


def confidence_tiers(spark: SparkSession, path: str) -> DataFrame:
    return registry.confidence_tiers(_res(spark, path), ["supplier"])


def tier_percentages(spark: SparkSession, path: str) -> DataFrame:
    return registry.tier_percentages(registry.confidence_tiers(_res(spark, path), ["supplier"]))


_TIERS = f"""
WITH {S.RESULTS},
t AS (SELECT supplier, count(*) AS total_keys, count(*) FILTER (coalesce(score, 0) >= 0.8) AS high_confidence,
  count(*) FILTER (coalesce(score, 0) >= 0.6 AND coalesce(score, 0) < 0.8) AS medium_confidence,
  count(*) FILTER (coalesce(score, 0) < 0.6) AS low_confidence FROM res GROUP BY supplier)
"""
_PCT = ", ".join(f"round({n}_confidence * 100 / total_keys)::INT AS {n}_pct" for n in ("high", "medium", "low"))


def avg_confidence(spark: SparkSession, path: str) -> DataFrame:
    docs = Tables(spark, path).orders.select(F.col("o_orderkey").alias("doc_id"))
    exact = _res(spark, path).withColumn("score", F.round("score", 2).cast("decimal(10,2)"))
    return registry.avg_confidence(docs, exact)


AVG_SQL = f"""
WITH {S.RESULTS},
s AS (SELECT doc_id, sum(round(coalesce(score, 0) * 100)::BIGINT) AS c, count(*) AS n FROM res GROUP BY doc_id),
a AS (SELECT doc_id, ((c * 20000 + n) // (n * 2) + 500) // 1000 AS m FROM s)
SELECT o_orderkey AS doc_id, (coalesce(m, 0) / 1000)::DOUBLE AS avg_confidence FROM orders LEFT JOIN a ON a.doc_id = o_orderkey
"""


def model_call_stats(spark: SparkSession, path: str) -> DataFrame:
    """Each event type stands for a number of calls."""
    kind = F.col("event_type")
    calls = F.when(kind == "click", 2).when(kind == "error", 1).when(kind == "view", 0)
    return registry.model_call_stats(Tables(spark, path).events.select("user_id", calls.alias("llm_calls")), ["user_id"])


CALLS_SQL = """
WITH c AS (SELECT user_id, CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS n FROM events)
SELECT user_id, sum(n) AS total_llm_calls, count(*) FILTER (n = 0) AS keys_no_llm,
       round(sum(n) / count(*), 1)::DOUBLE AS avg_llm_per_key FROM c GROUP BY user_id
"""


def registry_stats(spark: SparkSession, path: str) -> DataFrame:
    return registry.registry_stats(_reg(spark, path))


STATS_SQL = f"""
WITH {S.REGISTRY},
d AS (SELECT *, CASE WHEN ended IS NOT NULL THEN epoch(ended) - epoch(begun) END AS secs FROM reg)
SELECT count(*) AS total_documents, count(*) FILTER (status = 'completed') AS completed_count,
  count(*) FILTER (status = 'processing') AS processing_count,
  round(count(*) FILTER (status = 'completed') * 100 / count(*), 1)::DOUBLE AS success_rate,
  round(avg(avg_confidence) FILTER (status = 'completed'), 3)::DOUBLE AS avg_confidence,
  round(sum(secs) / sum(total_keys) FILTER (secs IS NOT NULL), 2)::DOUBLE AS avg_processing_time FROM d
"""


def count_by_type(spark: SparkSession, path: str) -> DataFrame:
    return registry.count_by_type(_reg(spark, path))


def step_timings(spark: SparkSession, path: str) -> DataFrame:
    """Users as runs, event types as steps; a user comes back to most of them."""
    log = Tables(spark, path).events.select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), F.col("ts").cast("timestamp").alias("ts")
    )
    return registry.step_timings(log, slow=36000.0).withColumns(
        {"duration": F.round("duration", 3), "run_total": F.round("run_total", 3), "started": F.unix_micros("started")}
    )


TIMINGS_SQL = """
WITH e AS (SELECT user_id AS run_id, event_type AS step, ts, lag(event_type) OVER w IS DISTINCT FROM event_type AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY run_id ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS nth FROM e),
s AS (SELECT run_id, step, nth, epoch_us(min(ts)) AS started, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM n GROUP BY ALL)
SELECT run_id, step, row_number() OVER (PARTITION BY run_id, step ORDER BY nth) AS entry, started, round(d, 3)::DOUBLE AS duration, round(sum(d) OVER w, 3)::DOUBLE AS run_total,
  CASE WHEN max(d) OVER w > 0 THEN round(d * 100 / max(d) OVER w) ELSE 0 END::INT AS pct_of_max, d >= 36000 AS is_slow
FROM s WINDOW w AS (PARTITION BY run_id)
"""

SEARCH, LIMIT = "0001", 50


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    found = registry.list_documents(_reg(spark, path), search=SEARCH, status="completed", limit=LIMIT)
    return found.select("id", "name", "status", "created_at")


def get_document(spark: SparkSession, path: str) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return registry.get_document(_reg(spark, path), 7).select("id", "name", "document_type", "status", "created_at")


def filter_results(spark: SparkSession, path: str) -> DataFrame:
    rows = _res(spark, path).withColumn("agent_used", F.col("found_in"))
    found = registry.filter_results(rows, search="a-", agent="table", fmt="percentage", confidence="medium")
    return found.select("doc_id", "key_id", "supplier", "key_name", "value", "score")


FILTER_SQL = f"""
WITH {S.RESULTS}
SELECT doc_id, key_id, supplier, key_name, value, score FROM res
WHERE (contains(lower(key_name), 'a-') OR contains(lower(value), 'a-')) AND found_in = 'table' AND expected_format = 'percentage'
  AND coalesce(score, 0) * 100 >= 50 AND coalesce(score, 0) * 100 < 80
"""


def status_view(spark: SparkSession, path: str) -> DataFrame:
    return registry.status_view(_reg(spark, path))


_LABEL = "CASE pipeline_step " + " ".join(
    "WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in P.STEP_LABELS.items()
) + " ELSE pipeline_step END"
STATUS_SQL = f"""
WITH {S.REGISTRY}
SELECT id, status, pipeline_step, {_LABEL} AS step_label, progress, coalesce(total_keys, 0) AS total_keys,
       coalesce(processed_keys, 0) AS processed_keys, error_msg FROM reg
"""


def registry_upsert(spark: SparkSession, path: str) -> DataFrame:
    return registry.registry_state(bindings.event_changes(Tables(spark, path)), ["status", "progress"])


UPSERT_SQL = """
WITH e AS (SELECT user_id AS id, event_type, ts, value, event_id,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT id, max(n) FILTER (event_type = 'signup') AS born, max(n) FILTER (event_type = 'error') AS gone FROM e GROUP BY id),
alive AS (SELECT * FROM b WHERE born IS NOT NULL AND (gone IS NULL OR born > gone)),
s AS (SELECT id, arg_max(CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' ELSE 'completed' END, n) AS status
      FROM e JOIN alive USING (id) WHERE n >= born AND event_type IN ('signup', 'click', 'purchase') GROUP BY id),
p AS (SELECT id, arg_max(event_type, n) AS k, arg_max(value, n) AS v
      FROM e JOIN alive USING (id) WHERE n >= born AND event_type IN ('signup', 'click', 'view') GROUP BY id)
SELECT id, status, CASE k WHEN 'signup' THEN '0' WHEN 'click' THEN v::VARCHAR END AS progress FROM s JOIN p USING (id)
"""


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Keys numbered by supplier and part within an order."""
    order = F.struct("l_suppkey", "l_partkey")
    rows = Tables(spark, path).lineitem.select(F.col("l_orderkey").alias("doc_id"), order.alias("key_id"))
    return registry.progress(rows, bucket=F.col("key_id.l_suppkey")).select("doc_id", "done", "total_keys", "progress")


PROGRESS_SQL = """
WITH n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey) AS done,
             count(*) OVER (PARTITION BY l_orderkey) AS total_keys FROM lineitem)
SELECT doc_id, done, total_keys, round(50 + done * 40.0::DOUBLE / total_keys, 1)::DOUBLE AS progress FROM n
"""


def result_response(spark: SparkSession, path: str) -> DataFrame:
    """Fields are shown as texts: key, name, value and where it was found."""
    t = Tables(spark, path)
    texts = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text"))
    shown = lambda f: F.concat_ws(":", f["key_id"].cast("string"), f["key_name"], f["value"], f["found_in"])
    return registry.result_response(_reg(spark, path), _res(spark, path), texts).withColumn("fields", F.array_join(F.transform("fields", shown), ";"))


RESPONSE_SQL = f"""
WITH {S.REGISTRY}, {S.RESULTS},
f AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws(':', key_id, key_name, value, found_in), ';' ORDER BY key_id, key_name, value) AS fields FROM res GROUP BY doc_id)
SELECT id, name, document_type, 'class ' || left(document_type, 1) AS doc_subtype, status, pipeline_step, created_at,
  CASE WHEN status <> 'completed' THEN progress END AS progress,
  CASE WHEN status = 'completed' THEN coalesce(n, 0) ELSE 0 END AS total_keys,
  CASE WHEN status = 'completed' THEN coalesce(avg_confidence, 0) ELSE 0 END::DOUBLE AS avg_confidence,
  CASE WHEN status = 'completed' THEN total_pages ELSE 0 END AS total_pages,
  CASE WHEN status <> 'completed' THEN error_msg END AS error_msg,
  CASE WHEN status = 'completed' THEN coalesce(fields, '') ELSE '' END AS fields,
  CASE WHEN status = 'completed' THEN 'order ' || id ELSE '' END AS ocr_text FROM reg LEFT JOIN f ON f.doc_id = id
"""


def result_fields(spark: SparkSession, path: str) -> DataFrame:
    """The field list of the response: every result row of a completed document."""
    return registry.result_fields(_reg(spark, path), _res(spark, path)).select("doc_id", "key_id", "key_name", "value", "score", "page", "found_in")


FIELDS_SQL = f"""
WITH {S.REGISTRY}, {S.RESULTS}
SELECT doc_id, key_id, key_name, value, score, page, found_in FROM res WHERE doc_id IN (SELECT id FROM reg WHERE status = 'completed')
"""


def format_display(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    shown = t.documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("part"),
        formats.size_text(F.col("n_chars") * 16).alias("shown"),
    )
    ratio = F.when(F.col("l_linenumber") < 3, F.col("l_quantity")).when(F.col("l_linenumber") < 7, F.col("l_quantity") / 50)
    scores = t.lineitem.select(
        F.lit("score").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("part"),
        formats.score_text(ratio).alias("shown"),
    )
    return shown.unionByName(scores)


DISPLAY_SQL = """
WITH d AS (SELECT doc_id, n_chars * 16 AS b FROM documents)
SELECT 'document' AS kind, doc_id AS id, 0 AS part, CASE WHEN b >= 1048576 THEN printf('%.2f MB', floor(b / 1048576 * 100 + 0.5) / 100) WHEN b >= 1024 THEN printf('%.2f KB', floor(b / 1024 * 100 + 0.5) / 100)
  WHEN b > 0 THEN printf('%.2f B', b::DOUBLE) ELSE '0 B' END AS shown FROM d
UNION ALL
SELECT 'score', l_orderkey, l_suppkey, CASE WHEN l_linenumber < 3 THEN
    CASE WHEN l_quantity > 1 THEN floor(l_quantity + 0.5)::INT ELSE floor(l_quantity * 100 + 0.5)::INT END || '%'
  WHEN l_linenumber < 7 THEN floor(l_quantity / 50 * 100 + 0.5)::INT || '%' ELSE '—' END FROM lineitem
"""

QUERIES = {
    "confidence_tiers": confidence_tiers, "tier_percentages": tier_percentages, "avg_confidence": avg_confidence,
    "model_call_stats": model_call_stats, "registry_stats": registry_stats, "count_by_type": count_by_type,
    "step_timings": step_timings, "list_documents": list_documents, "get_document": get_document,
    "filter_results": filter_results, "status_view": status_view, "registry_upsert": registry_upsert,
    "progress": progress, "result_response": result_response, "result_fields": result_fields, "format_display": format_display,
}
ORACLES = {
    "confidence_tiers": _TIERS + "SELECT * FROM t", "tier_percentages": _TIERS + f"SELECT supplier, total_keys, {_PCT} FROM t",
    "avg_confidence": AVG_SQL, "model_call_stats": CALLS_SQL, "registry_stats": STATS_SQL,
    "count_by_type": "SELECT o_orderpriority AS document_type, count(*) AS n FROM orders GROUP BY 1",
    "step_timings": TIMINGS_SQL,
    "list_documents": f"""WITH {S.REGISTRY} SELECT id, name, status, created_at FROM reg
        WHERE contains(lower(name), '{SEARCH}') AND status = 'completed' ORDER BY created_at DESC, id LIMIT {LIMIT}""",
    "get_document": f"WITH {S.REGISTRY} SELECT id, name, document_type, status, created_at FROM reg WHERE id = 7",
    "filter_results": FILTER_SQL, "status_view": STATUS_SQL, "registry_upsert": UPSERT_SQL, "progress": PROGRESS_SQL,
    "result_response": RESPONSE_SQL, "result_fields": FIELDS_SQL, "format_display": DISPLAY_SQL,
}
