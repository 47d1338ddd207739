"""Sources and sinks on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import sql as S
from fieldloom.functions import patterns as P
from fieldloom.operators import extractors, keys, pages, retrieval, tables
from fieldloom.session import shared_dir
from fieldloom.sources import bindings, corpus, sinks
from fieldloom.sources.bindings import Tables


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus.load_corpus(spark, f"{path}/documents.parquet")


def load_keys(spark: SparkSession, path: str) -> DataFrame:
    """Key lists as JSON texts, one per part, in both accepted shapes."""
    item = F.concat(F.lit('{"keyName":"'), "p_name", F.lit('","expectedFormat":"'), F.lower("p_type"), F.lit('"}'))
    payload = F.when(F.col("p_size") > 25, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]"))).otherwise(
        F.concat(F.lit('{"keys":['), item, F.lit("]}"))
    )
    return keys.parse_keys(Tables(spark, path).part.select("p_partkey", payload.alias("payload")))


def _requests(spark: SparkSession, path: str) -> DataFrame:
    role = F.col("c_mktsegment")
    n = F.col("c_nationkey")
    return Tables(spark, path).customer.select(
        "c_custkey",
        F.when(role == "HOUSEHOLD", "banking").when(role == "MACHINERY", "insurance")
        .when(role == "FURNITURE", "compliance").when(role == "BUILDING", "admin").otherwise("guest").alias("role"),
        F.when(n < 7, "loan").when(n < 13, "isda").when(n < 19, "invoice").otherwise("compliance_report").alias("subtype"),
    )


def template_catalog(spark: SparkSession, path: str) -> DataFrame:
    checked = keys.check_templates(_requests(spark, path), keys.template_catalog(spark))
    return checked.select("c_custkey", "role", "subtype", "display_name", "template_file", "allowed")


_CATALOG_ROWS = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}')" for r in P.TEMPLATE_CATALOG)
TEMPLATE_SQL = f"""
WITH cat(role, subtype, display_name, template_file) AS (VALUES {_CATALOG_ROWS}),
r AS (SELECT c_custkey,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'banking' WHEN 'MACHINERY' THEN 'insurance'
       WHEN 'FURNITURE' THEN 'compliance' WHEN 'BUILDING' THEN 'admin' ELSE 'guest' END AS role,
  CASE WHEN c_nationkey < 7 THEN 'loan' WHEN c_nationkey < 13 THEN 'isda'
       WHEN c_nationkey < 19 THEN 'invoice' ELSE 'compliance_report' END AS subtype FROM customer)
SELECT r.c_custkey, r.role, r.subtype, display_name, template_file, template_file IS NOT NULL AS allowed
FROM r LEFT JOIN cat USING (role, subtype)
"""


def resolve_keys(spark: SparkSession, path: str) -> DataFrame:
    """Labelled documents bring their own keys, the others use those of their source."""
    t = Tables(spark, path)
    docs = t.documents.select("doc_id", F.col("source").alias("subtype"))
    own = t.labels.select("doc_id", F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("key_name"))
    return keys.resolve_keys(docs, bindings.benchmark_keys(t).select("subtype", "key_name"), own)


RESOLVE_SQL = f"""
WITH {S.BENCHMARK_KEYS}
SELECT d.doc_id, bk.key_name, 'template' AS origin FROM documents d JOIN bk ON bk.subtype = d.source
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT doc_id, unnest(['quality', 'toxic']), 'user' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
"""


def merge_extra_keys(spark: SparkSession, path: str) -> DataFrame:
    brand = F.substring("p_brand", 7, 10).cast("int").alias("doc_id")
    blank = [F.lit("").alias("key_desc"), F.lit("").alias("search_type"), F.lit("text").alias("expected_format")]
    part = Tables(spark, path).part
    extra = F.when(F.col("p_size") > 25, F.concat(F.upper("p_name"), F.lit("  "))).otherwise(
        F.concat(F.lit(" "), "p_name", F.lit(" "), "p_type")
    )
    merged = keys.merge_extra_keys(
        part.select(brand, F.col("p_partkey").alias("pos"), F.col("p_name").alias("key_name"), *blank),
        part.select(brand, F.col("p_partkey").alias("pos"), extra.alias("key_name"), *blank),
    )
    return merged.select("doc_id", "pos", "key_name", "origin")


MERGE_SQL = """
WITH t AS (SELECT substr(p_brand, 7)::INT AS doc_id, p_partkey AS pos, p_name AS key_name FROM part),
e AS (SELECT substr(p_brand, 7)::INT AS doc_id, p_partkey AS pos,
             CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name || ' ' || p_type END AS key_name FROM part)
SELECT doc_id, pos, key_name, 'template' AS origin FROM t
UNION ALL
SELECT doc_id, min(pos), arg_min(key_name, pos), 'extra' FROM e
WHERE (doc_id, lower(key_name)) NOT IN (SELECT doc_id, lower(key_name) FROM t)
GROUP BY doc_id, lower(key_name)
"""

_RESULT_VIEW = ["doc_id", "key_id", "key_name", "value", "score", "page", "expected_format", "found_in"]


def write_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Written, then read back."""
    results = bindings.lineitem_results(Tables(spark, path)).withColumn(
        "debug", F.struct(F.lit(1).alias("llm_calls"))
    )
    results = sinks.with_run_columns(results)
    folder = run_folder(spark, "results")
    sinks.write_results_json(results, folder, "r1")
    schema = results.drop("debug").schema
    return spark.read.schema(schema).json(f"{folder}/latest").select(*_RESULT_VIEW, "agent_used", "llm_calls", "section")


WRITE_SQL = f"""
WITH {S.RESULTS}
SELECT {', '.join(_RESULT_VIEW)}, found_in AS agent_used, 1 AS llm_calls, '' AS section FROM res
"""


def export_csv(spark: SparkSession, path: str) -> DataFrame:
    results = bindings.lineitem_results(Tables(spark, path))
    folder = run_folder(spark, "export")
    sinks.export_csv(results, folder)
    schema = sinks.export_view(results).schema
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)


EXPORT_SQL = f"""
WITH {S.RESULTS}
SELECT key_name AS "keyName", value, score, page, expected_format, true AS format_valid, 'from line item' AS reason,
       found_in, NULL::VARCHAR AS rule_context FROM res
"""


def persist_index(spark: SparkSession, path: str) -> DataFrame:
    """An index saved and read back: its cells, definitions and vectors, and the vectors found nearest to each label's first one."""
    t = Tables(spark, path)
    folder = run_folder(spark, "index")
    cells = tables.oriented(tables.grid_cells(bindings.grid_documents(t)))
    sinks.persist_index(cells, extractors.extract_definitions(bindings.agreements(t)), folder, t.embeddings)
    saved, definitions = sinks.load_index(spark, folder)
    vectors = sinks.load_vectors(spark, folder)
    firsts = t.embeddings.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    blank = F.lit("")
    return (
        saved.select("table_title", "row_label", "col_label", "value", "snippet")
        .unionByName(definitions.select(
            F.lit("definitions").alias("table_title"), F.col("term").alias("row_label"), F.col("kind").alias("col_label"),
            F.col("expected_format").alias("value"), F.col("doc_id").cast("string").alias("snippet")))
        .unionByName(vectors.select(F.explode("ids").alias("id"), "dims").select(
            F.lit("vectors").alias("table_title"), F.col("id").cast("string").alias("row_label"), blank.alias("col_label"),
            F.col("dims").cast("string").alias("value"), blank.alias("snippet")))
        .unionByName(retrieval.search_packed(vectors, firsts).select(
            F.lit("nearest").alias("table_title"), F.col("query_id").cast("string").alias("row_label"), F.col("rank").cast("string").alias("col_label"),
            F.col("vec_id").cast("string").alias("value"), blank.alias("snippet")))
    )


PERSIST_SQL = f"""
WITH {S.RATES}, {S.FACTS},
firsts AS (SELECT label::BIGINT AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label),
near AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, embedding::DOUBLE[]), 12) DESC, vec_id) AS rank FROM firsts CROSS JOIN embeddings),
c AS (SELECT 'Rates of part ' || doc_id AS table_title, row_label, 'Mean Discount' AS col_label, {S.pct('dis')} AS value FROM rates
      UNION ALL SELECT 'Rates of part ' || doc_id, row_label, 'Mean Tax', {S.pct('tax')} FROM rates)
SELECT table_title, row_label, col_label, value,
       table_title || ' | ' || row_label || ' | ' || col_label || ' | value: ' || value AS snippet FROM c
UNION ALL
SELECT table_title, row_label, col_label, value,
       table_title || ' | ' || col_label || ' | ' || row_label || ' | value: ' || value FROM c
UNION ALL SELECT 'definitions', 'Commitment Fee', 'definition', 'percentage', doc_id::VARCHAR FROM facts
UNION ALL SELECT 'definitions', 'Leverage Ratio', 'definition', 'ratio', doc_id::VARCHAR FROM facts
UNION ALL SELECT 'vectors', vec_id::VARCHAR, '', len(embedding)::VARCHAR, '' FROM embeddings
UNION ALL SELECT 'nearest', query_id::VARCHAR, rank::VARCHAR, vec_id::VARCHAR, '' FROM near WHERE rank <= 3
"""


def content_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    docs = Tables(spark, path).documents
    fp = corpus.text_fingerprint("text")
    return docs.select(
        "doc_id", fp.alias("fingerprint"),
        corpus.cache_key(F.concat("source", F.lit(".pdf")), fp, "v1").alias("cache_key"),
    )


FINGERPRINT_SQL = """
SELECT doc_id, substr(md5(text), 1, 10) AS fingerprint, source || '_' || substr(md5(text), 1, 10) || '_v1' AS cache_key
FROM documents
"""


def skip_processed(spark: SparkSession, path: str) -> DataFrame:
    """The labels table plays the cache of finished documents."""
    t = Tables(spark, path)
    docs = t.documents.select("doc_id", F.length("text").alias("n"))
    cached = t.labels.select("doc_id", F.col("quality").cast("string").alias("cached_text"))
    reused, todo = corpus.skip_processed(docs, cached, ["doc_id"])
    return reused.withColumn("reused", F.lit(True)).unionByName(
        todo.withColumn("cached_text", F.lit(None).cast("string")).withColumn("reused", F.lit(False))
    )


SKIP_SQL = """
SELECT d.doc_id, length(d.text) AS n, l.quality::VARCHAR AS cached_text, l.doc_id IS NOT NULL AS reused
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def page_range(spark: SparkSession, path: str) -> DataFrame:
    first, last = pages.parse_page_range("2-4")
    return pages.page_range(bindings.conversation_pages(Tables(spark, path)), first, last)


def assemble_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages.assemble_pages(bindings.conversation_pages(Tables(spark, path)))


ASSEMBLE_SQL = f"""
WITH {S.CONVERSATION_PAGES}
SELECT doc_id, string_agg('── Page ' || page || ' ──' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text
FROM cp GROUP BY doc_id
"""


def split_batch_response(spark: SparkSession, path: str) -> DataFrame:
    """Documents rendered as one multi-page answer; one page more is asked for than there is."""
    lines = F.split("text", "\n", -1)
    body = F.array_join(F.transform(lines, lambda line, i: F.concat(
        F.lit("=== PAGE "), (i + 1).cast("string"), F.lit(" ===\n"), line)), "\n")
    answers = Tables(spark, path).documents.select("doc_id", (F.size(lines) + 1).alias("n"), body.alias("text"))
    return pages.split_batch_response(answers, F.col("n")).select(
        "doc_id", F.posexplode("texts").alias("slot", "page_text")
    )


SPLIT_BATCH_SQL = f"""
WITH {S.LINES}
SELECT doc_id, (page - 1)::INT AS slot, text AS page_text FROM pg
UNION ALL SELECT doc_id, max(page), '' FROM pg GROUP BY doc_id
"""

QUERIES = {
    "load_corpus": load_corpus, "load_keys": load_keys, "template_catalog": template_catalog,
    "resolve_keys": resolve_keys, "merge_extra_keys": merge_extra_keys, "write_results_json": write_results_json,
    "export_csv": export_csv, "persist_index": persist_index, "content_fingerprint": content_fingerprint,
    "skip_processed": skip_processed, "page_range": page_range, "assemble_pages": assemble_pages,
    "split_batch_response": split_batch_response,
}
ORACLES = {
    "load_corpus": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "load_keys": """
SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [0, 1] ELSE [0] END) AS pos, p_name AS key_name, '' AS key_desc,
       '' AS search_type, lower(p_type) AS expected_format FROM part""",
    "template_catalog": TEMPLATE_SQL, "resolve_keys": RESOLVE_SQL, "merge_extra_keys": MERGE_SQL,
    "write_results_json": WRITE_SQL, "export_csv": EXPORT_SQL, "persist_index": PERSIST_SQL,
    "content_fingerprint": FINGERPRINT_SQL, "skip_processed": SKIP_SQL,
    "page_range": f"WITH {S.CONVERSATION_PAGES} SELECT doc_id, page, text, role FROM cp WHERE page BETWEEN 2 AND 4",
    "assemble_pages": ASSEMBLE_SQL, "split_batch_response": SPLIT_BATCH_SQL,
}
