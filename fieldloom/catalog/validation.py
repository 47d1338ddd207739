"""Validation on values rendered from orders, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import sql as S
from fieldloom.functions import formats
from fieldloom.operators import requests, validation
from fieldloom.sources import bindings
from fieldloom.sources.bindings import Tables, pct

FENCE = "```"


def normalize_date(spark: SparkSession, path: str) -> DataFrame:
    """Order dates rendered three ways; slash dates put their first number into the month."""
    at = F.col("o_orderdate")
    shown = F.when(F.col("o_orderstatus") == "F", F.date_format(at, "MMMM d, yyyy")).when(
        F.col("o_orderstatus") == "O", F.date_format(at, "MM/dd/yyyy")).otherwise(F.date_format(at, "yyyy/M/d"))
    return Tables(spark, path).orders.select("o_orderkey", formats.normalize_date(shown).alias("iso"))


def values(spark: SparkSession, path: str) -> DataFrame:
    """One value per line item; the line number decides its kind and expected format."""
    n = F.col("l_linenumber")
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    whole = cents.cast("string")
    value = (
        F.when(n == 1, pct(cents * 100)).when(n == 2, whole).when(n == 3, F.concat(F.lit("."), whole, F.lit("5%")))
        .when(n == 4, F.concat(whole, F.lit(".50 to 1.00"))).when(n == 5, F.concat(whole, F.lit(".00x")))
        .when(n == 6, F.date_format("l_shipdate", "MMMM d, yyyy"))
        .when((n == 7) & (F.col("l_returnflag") == "A"), F.concat(F.lit("USD "), F.floor("l_extendedprice").cast("string")))
        .when((n == 7) & (F.col("l_returnflag") == "N"), "N/A")
    )
    fmt = F.when(n <= 3, "percentage").when(n <= 5, "ratio").when(n == 6, "date").otherwise("currency")
    return Tables(spark, path).lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", value.alias("value"), fmt.alias("expected_format"),
        (F.col("l_quantity") / 50).alias("confidence"),
        F.concat(whole, F.lit(".50 to 1.00")).alias("value_hint"),
        F.concat(F.lit("Loan "), F.when(F.col("l_linestatus") == "F", "Currency").otherwise("Amount")).alias("key_name"),
        F.lit("Amounts expressed in eur thousands").alias("page_text"),
    )


IDS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
_C = "round(l_discount * 100)::BIGINT"
VALUES_SQL = f"""
v AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity / 50 AS confidence, {_C} AS c, l_linestatus,
  CASE l_linenumber WHEN 1 THEN {S.pct(_C + ' * 100')} WHEN 2 THEN {_C}::VARCHAR WHEN 3 THEN '.' || {_C} || '5%'
    WHEN 4 THEN {_C} || '.50 to 1.00' WHEN 5 THEN {_C} || '.00x' WHEN 6 THEN strftime(l_shipdate, '%B %-d, %Y')
    WHEN 7 THEN CASE l_returnflag WHEN 'A' THEN 'USD ' || floor(l_extendedprice)::BIGINT WHEN 'N' THEN 'N/A' END END AS value,
  CASE WHEN l_linenumber <= 3 THEN 'percentage' WHEN l_linenumber <= 5 THEN 'ratio' WHEN l_linenumber = 6 THEN 'date' ELSE 'currency' END AS expected_format,
  strftime(l_shipdate, '%Y-%m-%d') AS iso FROM lineitem),
chk AS (SELECT *, l_linenumber IN (1, 2, 4, 6) OR coalesce(starts_with(value, 'USD'), false) AS valid,
  CASE WHEN value IS NULL OR value = 'N/A' THEN NULL WHEN l_linenumber = 2 THEN value || '%' WHEN l_linenumber = 6 THEN iso ELSE value END AS normalized,
  CASE WHEN value IS NULL OR value = 'N/A' THEN 'null or empty value'
       WHEN l_linenumber = 3 THEN 'format mismatch — expected percentage (e.g. 2.25%), got ''' || value || ''''
       WHEN l_linenumber = 5 THEN 'format mismatch — expected ratio (e.g. 4.50 to 1.00), got ''' || value || ''''
       ELSE '' END AS issue FROM v)
"""


def format_check(spark: SparkSession, path: str) -> DataFrame:
    rows = values(spark, path).withColumn("c", formats.format_check("value", "expected_format"))
    return rows.select(*IDS, "value", "c.valid", "c.normalized", "c.issue")


def sanity_check(spark: SparkSession, path: str) -> DataFrame:
    """Currency is unknown to the scoring rules and counts as text."""
    rows = values(spark, path).withColumn("c", formats.sanity_check("value", "expected_format", F.col("value_hint")))
    return rows.select(*IDS, "value", "c.valid", "c.normalized", "c.score_adj")


# A ratio of the form "c.50 to 1.00" always equals its hint.
_SANITY = f"""
WITH {VALUES_SQL},
sane AS (SELECT *, value IS NOT NULL AND value <> 'N/A' AND l_linenumber NOT IN (3, 5) AS ok,
  CASE WHEN value IS NULL OR value = 'N/A' THEN -1.0 WHEN l_linenumber IN (3, 5) THEN -0.5 ELSE 0.0 END::DOUBLE AS score_adj,
  CASE WHEN value = 'N/A' THEN NULL WHEN l_linenumber = 2 THEN value || '%' WHEN l_linenumber = 6 THEN iso ELSE value END AS norm FROM v)
"""


def currency_rescue(spark: SparkSession, path: str) -> DataFrame:
    """Agreements state their currency before the amount; only currency keys are rescued."""
    docs = bindings.agreements(Tables(spark, path))
    key = F.explode(F.array(F.lit("Loan Currency"), F.lit("Devise"), F.lit("Loan Amount")))
    rows = docs.select("doc_id", "text", key.alias("key_name"))
    null = F.lit(None).cast("string")
    return rows.select(
        "doc_id", "key_name", formats.currency_rescue(F.col("key_name"), null, F.col("text")).alias("code")
    )


RESCUE_SQL = f"""
WITH {S.FACTS}
SELECT doc_id, k AS key_name, CASE WHEN k <> 'Loan Amount' AND currency IN ('EUR', 'USD', 'GBP', 'CHF', 'JPY') THEN currency END AS code
FROM facts CROSS JOIN (SELECT unnest(['Loan Currency', 'Devise', 'Loan Amount']) AS k)
"""


def accept_or_escalate(spark: SparkSession, path: str) -> DataFrame:
    return validation.accept_or_escalate(values(spark, path)).select(
        *IDS, "final_value", "score", "format_valid", "needs_model"
    )


# Values are missing on line 7 only; a currency key then takes the code from the page text.
ACCEPT_SQL = f"""
WITH {VALUES_SQL},
r AS (SELECT *, value IS NULL AND l_linestatus = 'F' AS rescued FROM chk)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
       CASE WHEN rescued THEN 'EUR' ELSE coalesce(normalized, value) END AS final_value,
       CASE WHEN rescued THEN 0.75 WHEN valid AND confidence >= 0.7 THEN round(least(1.0, confidence + 0.05), 2)
            ELSE round(greatest(0.0, confidence - 0.2), 2) END::DOUBLE AS score,
       valid OR rescued AS format_valid, NOT rescued AND NOT (valid AND confidence >= 0.7) AS needs_model FROM r
"""


def embedding_score_validation(spark: SparkSession, path: str) -> DataFrame:
    rows = values(spark, path).withColumn("embedding_score", F.col("confidence"))
    return validation.embedding_score_validation(rows).select(*IDS, "final_value", "score", "format_valid", "needs_model")


EMBEDDING_SQL = _SANITY + """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(norm, value) AS final_value,
  round(CASE WHEN NOT ok THEN greatest(0.0, confidence + score_adj) WHEN confidence >= 0.85 THEN least(1.0, confidence)
             ELSE least(confidence, 0.75) END, 2)::DOUBLE AS score,
  ok AS format_valid, ok AND confidence < 0.85 AS needs_model FROM sane
"""


def confidence_to_score(spark: SparkSession, path: str) -> DataFrame:
    kind = F.col("event_type")
    word = (
        F.when(kind == "click", "High").when(kind == "error", "low").when(kind == "purchase", F.col("value").cast("string"))
        .when(kind == "signup", "sure")
    )
    return Tables(spark, path).events.select("event_id", F.round(formats.confidence_score(word), 6).alias("score"))


CONFIDENCE_SQL = """
SELECT event_id, CASE event_type WHEN 'click' THEN 0.85 WHEN 'error' THEN 0.35 WHEN 'purchase' THEN round(value, 6)
  WHEN 'signup' THEN 0.5 ELSE 0.6 END::DOUBLE AS score FROM events
"""


def _answers(spark: SparkSession, path: str) -> DataFrame:
    """Event properties as model answers: clean, fenced, inside prose, nested in prose, broken."""
    kind, props = F.col("event_type"), F.col("props")
    raw = (
        F.when(kind == "click", props).when(kind == "error", F.concat(F.lit(f"{FENCE}json\n"), props, F.lit(f"\n{FENCE}")))
        .when(kind == "purchase", F.concat(F.lit("Here it is: "), props, F.lit(" as asked")))
        .when(kind == "signup", F.concat(F.lit('Nested: {"a": '), props, F.lit("} done")))
        .otherwise(F.rtrim(F.replace(props, F.lit("}"), F.lit(""))))
    )
    return Tables(spark, path).events.select("event_id", raw.alias("raw"), "event_type", "value")


def parse_model_json(spark: SparkSession, path: str) -> DataFrame:
    parsed = validation.parse_model_json(_answers(spark, path), "k int")
    return parsed.select("event_id", "parse_ok", F.col("parsed.k").alias("k"))


JSON_SQL = """
SELECT event_id, event_type IN ('click', 'error', 'purchase') AS parse_ok,
       CASE WHEN event_type IN ('click', 'error', 'purchase') THEN json_extract_string(props, '$.k')::INT END AS k FROM events
"""


def coalesce_model_result(spark: SparkSession, path: str) -> DataFrame:
    """Table results with rule answers for some; an answer without value or page hides nothing."""
    t = Tables(spark, path)
    kind = F.col("event_type")
    amount = F.col("value").cast("decimal(12,2)").cast("string")
    tables = t.events.select(
        "event_id", F.concat(F.lit("key "), kind).alias("key_name"), F.when(kind != "view", amount).alias("value"),
        F.lit(1).alias("page"), F.lit("medium").alias("confidence"),
    )
    null = F.lit(None).cast("string")
    rules = t.events.filter(kind.isin("click", "error")).select(
        "event_id", F.when(kind == "click", F.lit("rule value")).otherwise(null).alias("value"),
        F.when(kind == "error", F.lit(7)).alias("page"), F.lit("high").alias("confidence"),
        F.lit("a rule").alias("rule_context"),
    )
    return validation.coalesce_rule_result(tables, rules, ["event_id"])


COALESCE_SQL = """
WITH e AS (SELECT event_id, event_type, value::DECIMAL(12, 2)::VARCHAR AS amount FROM events)
SELECT event_id,
  CASE WHEN event_type = 'click' THEN 'rule value' WHEN event_type <> 'view' THEN amount END AS value,
  CASE WHEN event_type = 'error' THEN 7 ELSE 1 END AS page,
  CASE WHEN event_type IN ('click', 'error') THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN event_type IN ('click', 'error') THEN 'a rule' WHEN event_type <> 'view' THEN 'key ' || event_type || ': ' || amount END AS rule_context
FROM e
"""


def error_rows(spark: SparkSession, path: str) -> DataFrame:
    """Error events are failed keys."""
    failed = F.when(F.col("event_type") == "error", F.concat(F.lit("boom "), F.repeat(F.lit("x"), 120)))
    rows = Tables(spark, path).events.select(
        "event_id", F.col("props").alias("value"), F.lit(0.9).alias("score"), F.lit("fine").alias("reason"),
        F.lit("table").alias("found_in"), failed.alias("error"),
    )
    return validation.error_rows(rows)


ERROR_SQL = """
WITH e AS (SELECT *, event_type = 'error' AS failed FROM events)
SELECT event_id, CASE WHEN NOT failed THEN props END AS value, CASE WHEN failed THEN 0.0 ELSE 0.9 END::DOUBLE AS score,
  CASE WHEN failed THEN 'Error: ' || 'boom ' || repeat('x', 120) ELSE 'fine' END AS reason,
  CASE WHEN failed THEN 'error' ELSE 'table' END AS found_in FROM e
"""


def build_requests(spark: SparkSession, path: str) -> DataFrame:
    """Validation requests for the rows the rules leave open."""
    rows = validation.accept_or_escalate(values(spark, path)).filter("needs_model").withColumn(
        "definition_text", F.lit("")
    )
    return requests.build_requests(rows, "validator").select(*IDS, "agent", "prompt")


_EXAMPLE = "CASE expected_format WHEN 'percentage' THEN '2.25%' WHEN 'ratio' THEN '4.50 to 1.00' WHEN 'date' THEN '2015-11-02' ELSE 'EUR 1,000,000' END"
REQUESTS_SQL = f"""
WITH {VALUES_SQL}
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 'validator' AS agent,
  'Check the value against the text and answer as JSON.' || chr(10) || 'Key: Loan ' || CASE l_linestatus WHEN 'F' THEN 'Currency' ELSE 'Amount' END
  || chr(10) || 'Value: ' || coalesce(value, 'null') || chr(10) || 'Format: ' || expected_format || chr(10) || 'Example: ' || {_EXAMPLE}
  || chr(10) || 'Issue: ' || coalesce(nullif(issue, ''), 'none') || chr(10) || 'Definition: Not available'
  || chr(10) || 'Text: Amounts expressed in eur thousands' AS prompt
FROM chk WHERE NOT (value IS NULL AND l_linestatus = 'F') AND NOT (valid AND confidence >= 0.7)
"""


def with_inference(spark: SparkSession, path: str) -> DataFrame:
    """A stand-in model answers each request with the prompt's length; odd lengths fail."""
    def model(prompt: str) -> str:
        if len(prompt) % 2:
            raise ValueError("odd prompt")
        return f'{{"k": {len(prompt)}}}'

    asked = _answers(spark, path).select("event_id", F.col("raw").alias("prompt"))
    return requests.with_inference(asked, model).drop("seconds")  # a measured time


INFERENCE_SQL = f"""
WITH p AS (SELECT event_id, CASE event_type WHEN 'click' THEN props
  WHEN 'error' THEN '{FENCE}json' || chr(10) || props || chr(10) || '{FENCE}' WHEN 'purchase' THEN 'Here it is: ' || props || ' as asked'
  WHEN 'signup' THEN 'Nested: {{"a": ' || props || '}} done' ELSE rtrim(replace(props, '}}', '')) END AS prompt FROM events)
SELECT event_id, prompt, CASE WHEN length(prompt) % 2 = 0 THEN '{{"k": ' || length(prompt) || '}}' END AS raw,
       CASE WHEN length(prompt) % 2 = 1 THEN 'odd prompt' END AS error FROM p
"""

QUERIES = {
    "normalize_date": normalize_date, "format_check": format_check, "sanity_check": sanity_check,
    "currency_rescue": currency_rescue, "accept_or_escalate": accept_or_escalate,
    "embedding_score_validation": embedding_score_validation, "confidence_to_score": confidence_to_score,
    "parse_model_json": parse_model_json, "coalesce_model_result": coalesce_model_result, "error_rows": error_rows,
    "build_requests": build_requests, "with_inference": with_inference,
}
ORACLES = {
    "normalize_date": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    "format_check": f"WITH {VALUES_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, value, valid, normalized, issue FROM chk",
    "sanity_check": _SANITY + "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, value, ok AS valid, norm AS normalized, score_adj FROM sane",
    "currency_rescue": RESCUE_SQL, "accept_or_escalate": ACCEPT_SQL, "embedding_score_validation": EMBEDDING_SQL,
    "confidence_to_score": CONFIDENCE_SQL, "parse_model_json": JSON_SQL, "coalesce_model_result": COALESCE_SQL,
    "error_rows": ERROR_SQL, "build_requests": REQUESTS_SQL, "with_inference": INFERENCE_SQL,
}
