"""Key lists: loading, templates, merging, checking, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import formats
from fieldloom.functions import patterns as P
from fieldloom.functions.text import blank_to_null, strip

_KEY = "struct<keyName:string,keyNameDescription:string,searchType:string,expectedFormat:string>"
KEY_COLUMNS = ["key_name", "key_desc", "search_type", "expected_format"]


def key_array(payload: Column) -> Column:
    """Keys of a JSON text that is either a list or ``{"keys": [...]}``; NULL for anything else."""
    listed = F.from_json(payload, f"array<{_KEY}>")
    wrapped = F.from_json(payload, f"struct<keys:array<{_KEY}>>")["keys"]
    starts = F.substring(strip(payload), 1, 1)
    return F.when(starts == "[", listed).when(starts == "{", wrapped)


def parse_keys(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per key; absent and null optional fields become empty."""
    keep = [c for c in payloads.columns if c != payload]
    keys = payloads.select(*keep, F.posexplode(key_array(F.col(payload))).alias("pos", "k"))
    blank = lambda c: F.coalesce(F.col(f"k.{c}"), F.lit(""))
    return keys.select(
        *keep, "pos",
        F.col("k.keyName").alias("key_name"),
        blank("keyNameDescription").alias("key_desc"),
        blank("searchType").alias("search_type"),
        blank("expectedFormat").alias("expected_format"),
    )


def load_keys(spark: SparkSession, path: str) -> DataFrame:
    """Key list from a JSON file; an empty list is an error."""
    keys = parse_keys(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))
    if keys.isEmpty():
        raise ValueError(f"no keys in {path}")
    return keys


def template_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        P.TEMPLATE_CATALOG,
        "role string, subtype string, display_name string, template_file string, "
        "prompt_terms string, prompt_rules string",
    )


def check_templates(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests with their template, ``allowed`` telling whether the role may use the subtype.

    The catalog is a fixed eight-row table, so Spark joins it without moving the requests.
    """
    return requests.join(catalog, ["role", "subtype"], "left").withColumn(
        "allowed", F.col("template_file").isNotNull()
    )


def disallowed(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    return requests.join(catalog, ["role", "subtype"], "left_anti")


def attach_keys(docs: DataFrame, keys: DataFrame, on: str = "subtype") -> DataFrame:
    """Each document with each key of its template.

    An equi-join on the template name, without hints: a template-sized key list is joined in
    place, a larger one by shuffle with adaptive splitting of hot templates.
    """
    return docs.join(keys, on)


def resolve_keys(docs: DataFrame, template_keys: DataFrame, user_keys: DataFrame, on: str = "subtype") -> DataFrame:
    """A document's own keys if it has any, else those of its template."""
    without_own = docs.join(user_keys.select("doc_id"), "doc_id", "left_anti")
    own = user_keys.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("origin", F.lit("user"))
    shared = attach_keys(without_own, template_keys, on).withColumn("origin", F.lit("template"))
    columns = ["doc_id", *[c for c in user_keys.columns if c != "doc_id"], "origin"]
    return own.select(*columns).unionByName(shared.select(*columns))


def merge_extra_keys(template_keys: DataFrame, extra_keys: DataFrame) -> DataFrame:
    """Template keys as they are, plus extras whose trimmed lower-case name is new.

    Both need ``doc_id, pos, key_name, key_desc, search_type, expected_format``. The extras are
    reduced to one per name by an aggregate before they meet the template names.
    """
    name = F.lower(strip("key_name"))
    values = ["pos", "key_name", "key_desc", "search_type", "expected_format"]
    first_extra = (
        extra_keys.filter(strip("key_name") != "")
        .withColumn("norm", name)
        .withColumn("key_name", strip("key_name"))
        .withColumn("key_desc", F.coalesce("key_desc", F.lit("")))
        .withColumn("search_type", F.coalesce("search_type", F.lit("")))
        .withColumn("expected_format", F.coalesce("expected_format", F.lit("text")))
        .groupBy("doc_id", "norm")
        .agg(F.min(F.struct(*values)).alias("k"))
    )
    known = template_keys.select("doc_id", name.alias("norm")).distinct()
    fresh = first_extra.join(known, ["doc_id", "norm"], "left_anti").select(
        "doc_id", *[F.col(f"k.{v}").alias(v) for v in values]
    )
    return template_keys.select("doc_id", *values, F.lit("template").alias("origin")).unionByName(
        fresh.withColumn("origin", F.lit("extra"))
    )


def validate_keys(keys: DataFrame) -> DataFrame:
    """Flag keys with a usable name."""
    return keys.withColumn("accepted", blank_to_null(strip("key_name")).isNotNull())


def classify_keys(keys: DataFrame) -> DataFrame:
    """All scalar key rules side by side."""
    name, desc = F.col("key_name"), F.col("key_desc")
    return keys.withColumns({
        "rule_format": formats.detect_format(name, desc),
        "terms_format": formats.infer_format_terms(name),
        "name_format": formats.infer_format_name(name),
        "needs_terms": formats.needs_terms(desc),
        "party_hint": formats.party_hint(name),
    })
