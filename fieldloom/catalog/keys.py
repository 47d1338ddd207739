"""Key classification on finance-style key names made from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import formats
from fieldloom.functions import patterns as P
from fieldloom.operators import keys
from fieldloom.sources.bindings import Tables

PHRASES = [
    "LIBOR Rate - Leverage Ratio", "Commitment Fee", "Leverage Ratio Covenant", "Maturity Date",
    "Total Commitment Amount", "Borrowing Base", "Borrowing Base Utilization", "Ratio < 3.00x grid",
    "Effective Date of Amendment", "Spread %", "Net Debt multiple 2.50x", "Bank Authorized Representative",
    "Borrower Representative", "Loan Currency", "Number of datasets", "Closing deadline", "Governing Law",
]
DESCRIPTIONS = [
    "", "the first payment date", "Applicable margin for the facility", "what the Borrower shall deliver",
    "minimum ratio to be kept", "plain words",
]


def finance_keys(spark: SparkSession, path: str) -> DataFrame:
    """Every part with one of the phrases after its name."""
    def pick(texts: list[str], by: Column) -> Column:
        return F.get(F.array(*map(F.lit, texts)), (by % len(texts)).cast("int"))

    return Tables(spark, path).part.select(
        F.col("p_partkey").alias("key_id"), F.col("p_size"),
        F.concat("p_name", F.lit(" "), pick(PHRASES, F.col("p_size"))).alias("key_name"),
        pick(DESCRIPTIONS, F.col("p_partkey")).alias("key_desc"),
        F.when(F.col("p_type") == "PROMO", "number").otherwise("").alias("expected_format"),
        F.when(F.col("p_type") == "SMALL", "currency").when(F.col("p_type") == "MEDIUM", "text").alias("model_format"),
    )


def _list(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


KEYS_SQL = f"""
k AS (SELECT p_partkey AS key_id, p_size, p_name || ' ' || {_list(PHRASES)}[1 + p_size % {len(PHRASES)}] AS key_name,
             {_list(DESCRIPTIONS)}[1 + p_partkey % {len(DESCRIPTIONS)}] AS key_desc,
             CASE p_type WHEN 'PROMO' THEN 'number' ELSE '' END AS expected_format,
             CASE p_type WHEN 'SMALL' THEN 'currency' WHEN 'MEDIUM' THEN 'text' END AS model_format FROM part)
"""
_TEXT = "lower(key_name || ' ' || key_desc)"


def _matches(expr: str, pattern: str) -> str:
    """RE2 has no lookahead: ``base(?!a)(?!b)`` becomes base, and not base-a, and not base-b."""
    base, *tails = pattern.split("(?!")
    tests = [f"regexp_matches({expr}, '(?i){base}')"]
    tests += [f"NOT regexp_matches({expr}, '(?i){base}{tail[:-1]}')" for tail in tails]
    return "(" + " AND ".join(tests) + ")"


def _cascade(expr: str, cascade) -> str:
    whens = []
    for fmt, pats in cascade:
        pats = [pats] if isinstance(pats, str) else pats
        whens.append(f"WHEN {' OR '.join(_matches(expr, p) for p in pats)} THEN '{fmt}'")
    return "CASE " + " ".join(whens) + " ELSE 'text' END"


def _any(expr: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


DETECT = _cascade(_TEXT, P.KEY_FORMAT_CASCADE)
_LOW = "lower(key_name)"
TERMS = f"""CASE WHEN {_any(_LOW, P.DATE_TERMS)} AND NOT {_any(_LOW, P.PERCENTAGE_TERMS + P.RATIO_TERMS)} THEN 'date'
  WHEN {_any(_LOW, P.PERCENTAGE_TERMS)} THEN 'percentage' WHEN {_any(_LOW, P.RATIO_TERMS)} THEN 'ratio'
  WHEN contains(key_name, '%') THEN 'percentage' WHEN regexp_matches(key_name, '(?i)\\d+\\.\\d+x\\b') THEN 'ratio'
  WHEN contains({_LOW}, 'covenant') THEN 'ratio' ELSE 'text' END"""
MERGE = f"""CASE WHEN regexp_matches(key_name, '(?i){P.ALWAYS_PERCENTAGE}') THEN 'percentage'
  WHEN regexp_matches(key_name, '(?i){P.ALWAYS_RATIO}') THEN 'ratio'
  WHEN {DETECT} <> 'text' THEN {DETECT} ELSE coalesce(model_format, 'text') END"""
HINT = f"""concat_ws('+', CASE WHEN contains({_LOW}, 'bank') AND contains({_LOW}, 'representative') THEN 'bank_signer'
  WHEN contains({_LOW}, 'borrower') AND contains({_LOW}, 'representative') THEN 'borrower_signer' END,
  CASE WHEN contains({_LOW}, 'currency') AND contains({_LOW}, 'loan') THEN 'loan_currency' END)"""
FORMAT_TEXT = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.FORMAT_TEXTS.items()) + f" ELSE '{P.UNKNOWN_FORMAT_TEXT}' END"


def _with(name: str, column) -> tuple:
    def query(spark: SparkSession, path: str) -> DataFrame:
        return finance_keys(spark, path).select("key_id", "key_name", column().alias(name))
    return query


def validate_keys(spark: SparkSession, path: str) -> DataFrame:
    """Small parts get a blank name."""
    named = F.when(F.col("p_size") < 10, F.lit(" \t ")).otherwise(F.col("p_name"))
    return keys.validate_keys(Tables(spark, path).part.select("p_partkey", named.alias("key_name"))).drop("key_name")


def _k(expr: str, name: str) -> str:
    return f"WITH {KEYS_SQL} SELECT key_id, key_name, {expr} AS {name} FROM k"


QUERIES = {
    "detect_format": _with("fmt", lambda: formats.detect_format("key_name", "key_desc")),
    "infer_format_terms": _with("fmt", lambda: formats.infer_format_terms("key_name")),
    "infer_format_name": _with("fmt", lambda: formats.infer_format_name("key_name")),
    "merge_format": _with("fmt", lambda: formats.merge_format(
        formats.detect_format("key_name", "key_desc"), F.col("model_format"), F.col("key_name"))),
    "effective_format": _with("fmt", lambda: formats.effective_format(
        F.col("expected_format"), F.col("key_name"), F.col("key_desc"))),
    "format_pattern_text": _with("pattern_text", lambda: formats.format_text(formats.effective_format(
        F.col("expected_format"), F.col("key_name"), F.col("key_desc")))),
    "needs_terms": _with("needs", lambda: formats.needs_terms("key_desc")),
    "party_hint": _with("hint", lambda: formats.party_hint("key_name")),
    "validate_keys": validate_keys,
}
EFFECTIVE = f"coalesce(nullif(expected_format, ''), {DETECT})"
ORACLES = {
    "detect_format": _k(DETECT, "fmt"), "infer_format_terms": _k(TERMS, "fmt"),
    "infer_format_name": _k(_cascade("key_name", P.NAME_FORMAT_CASCADE), "fmt"),
    "merge_format": _k(MERGE, "fmt"), "effective_format": _k(EFFECTIVE, "fmt"),
    "format_pattern_text": f"WITH {KEYS_SQL}, e AS (SELECT key_id, key_name, {EFFECTIVE} AS f FROM k) SELECT key_id, key_name, {FORMAT_TEXT} AS pattern_text FROM e",
    "needs_terms": _k(_any("lower(key_desc)", P.OBLIGATION_TERMS), "needs"), "party_hint": _k(HINT, "hint"),
    "validate_keys": "SELECT p_partkey, p_size >= 10 AS accepted FROM part",
}
