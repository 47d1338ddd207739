"""Routing and search on documents (lines as pages), embeddings and benchmark keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import sql as S
from fieldloom.catalog.sources import run_folder
from fieldloom.functions import patterns as P
from fieldloom.functions.text import words
from fieldloom.operators import retrieval
from fieldloom.sources import bindings
from fieldloom.sources.bindings import Tables


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return bindings.line_pages(Tables(spark, path))


# ------------------------------------------------------------------------------- routing
def route_key_to_section(spark: SparkSession, path: str) -> DataFrame:
    """Every line is a section; benchmark items are the keys."""
    t = Tables(spark, path)
    sections = F.transform("pages", lambda p: F.struct(
        p["text"].alias("topic"), F.array(p["page"]).alias("pages"), F.lit("paragraph").alias("type"),
        F.array().cast("array<string>").alias("keywords"),
    ))
    docs = _lines(spark, path).select(
        "doc_id", "subtype", sections.alias("sections"), F.col("pages")["page"].alias("page_numbers")
    )
    routed = retrieval.route_keys(docs, bindings.benchmark_keys(t))
    return routed.select(
        "doc_id", "key_id", "section_idx", "overlap", F.array_join("pages", ",").alias("pages"),
        (F.col("topic") == "Full Document").alias("nowhere"),
    )


ROUTE_SQL = f"""
WITH {S.LINES}, {S.BENCHMARK_KEYS},
kw AS (SELECT key_id, subtype, {S.words("key_name || ' ' || key_desc")} AS ws FROM bk),
lw AS (SELECT doc_id, source, page, {S.words('raw')} AS ws FROM ln),
sc AS (SELECT doc_id, key_id, page, len(list_intersect(lw.ws, kw.ws)) AS overlap FROM lw JOIN kw ON kw.subtype = lw.source),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, key_id ORDER BY overlap DESC, page) = 1),
firsts AS (SELECT doc_id, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM ln GROUP BY doc_id)
SELECT doc_id, key_id, CASE WHEN overlap > 0 THEN page - 1 END AS section_idx, overlap,
       CASE WHEN overlap > 0 THEN page::VARCHAR ELSE firsts.pages END AS pages, overlap = 0 AS nowhere
FROM best JOIN firsts USING (doc_id)
"""


def _table_context(spark: SparkSession, path: str) -> DataFrame:
    """Page 1 plays the table; its longer words are the terms."""
    first = F.get("pages", F.lit(0))["text"]
    return _lines(spark, path).select(
        "doc_id", "pages", F.array(F.lit(1)).alias("table_pages"), words(first, 5).alias("terms")
    )


_CONTEXT = f"""
WITH {S.LINES},
tt AS (SELECT doc_id, {S.words('raw', 5)} AS terms FROM ln WHERE page = 1),
para AS (SELECT doc_id, page, raw FROM ln WHERE page <> 1 AND {S.count_char('raw', '│')} < 3 AND {S.count_char('raw', '|')} < 6),
sc AS (SELECT doc_id, page, len(list_filter(terms, lambda t: contains(lower(raw), t))) AS score FROM para JOIN tt USING (doc_id))
"""


def context_by_terms(spark: SparkSession, path: str) -> DataFrame:
    return retrieval.context_by_terms(_table_context(spark, path))


TERMS_SQL = _CONTEXT + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page) AS rank, page, score
FROM sc WHERE score > 0 QUALIFY rank <= 3
"""


def context_by_proximity(spark: SparkSession, path: str) -> DataFrame:
    return retrieval.context_by_proximity(_table_context(spark, path))


NEAR_SQL = _CONTEXT + """
SELECT doc_id, 0 AS pos, page FROM para
WHERE page = 2 AND doc_id NOT IN (SELECT doc_id FROM sc WHERE score > 0)
"""


# ------------------------------------------------------------------------------- vectors
def _queries(spark: SparkSession, path: str, how=F.avg) -> DataFrame:
    """One query vector per label: the mean (or maximum) of its vectors, dimension by dimension."""
    vectors = Tables(spark, path).embeddings
    dims = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    per_dim = dims.groupBy("label", "dim").agg(how(F.col("x").cast("double")).alias("x"))
    return per_dim.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("embedding")
    )


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return Tables(spark, path).embeddings


def _rounded(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.round("score", 6))


def vector_topk(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(retrieval.vector_topk(_vectors(spark, path), _queries(spark, path), 3))


def vector_topk_cells(spark: SparkSession, path: str) -> DataFrame:
    return _rounded(retrieval.vector_topk_cells(_vectors(spark, path), _queries(spark, path), ["label"], 5))


def _query_sql(name: str, fn: str) -> str:
    return f"""
{name}_d AS (SELECT label, i, {fn}(x) AS x FROM (
  SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i),
{name}_q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS e FROM {name}_d GROUP BY label),
{name} AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(e, embedding::DOUBLE[]), 12) AS score
  FROM {name}_q CROSS JOIN embeddings),
{name}_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {name})
"""


_CELLS = f"""
{_query_sql('m', 'avg')},
near AS (SELECT query_id, vec_id, label, score, rank AS place FROM m_top WHERE rank <= 10),
once AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY place) = 1),
numbered AS (SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM once),
cells AS (SELECT * FROM numbered WHERE rank <= 5)
"""


def router_decision(spark: SparkSession, path: str) -> DataFrame:
    """Labels as keys; cells by mean vector, definitions by maximum vector."""
    vectors = _vectors(spark, path)
    label = F.col("query_id")
    keys = vectors.select(F.col("label").cast("long").alias("query_id")).distinct().withColumn(
        "key_name", F.when(label < 3, F.concat(F.lit("fee rate "), label)).when(label < 6, F.concat(F.lit("closing date "), label))
        .otherwise(F.concat(F.lit("party "), label))
    )
    cells = retrieval.vector_topk_cells(vectors, _queries(spark, path), ["label"], 5).withColumn(
        "value", F.col("vec_id").cast("string"))
    definitions = retrieval.vector_topk(vectors, _queries(spark, path, F.max), 2).withColumns({
        "expected_format": F.when(label > 7, "ratio").otherwise("text"),
        "value_hint": F.col("vec_id").cast("string"), "definition": F.concat(F.lit("vector "), F.col("vec_id")),
    })
    out = retrieval.router_decision(keys, cells, definitions, high=0.5)
    return out.withColumn("confidence", F.round("confidence", 6)).drop("page_hint")


ROUTER_SQL = f"""
WITH {_CELLS}, {_query_sql('x', 'max')},
k AS (SELECT DISTINCT label::BIGINT AS query_id FROM embeddings),
j AS (SELECT k.query_id, c.score AS cs, c.vec_id AS cv, d.score AS ds, d.vec_id AS dv,
        CASE WHEN query_id < 3 THEN 'fee rate ' WHEN query_id < 6 THEN 'closing date ' ELSE 'party ' END || query_id AS key_name,
        CASE WHEN query_id < 3 THEN 'percentage' WHEN query_id < 6 THEN 'date' ELSE 'text' END AS named
      FROM k LEFT JOIN (FROM cells WHERE rank = 1) c USING (query_id) LEFT JOIN (FROM x_top WHERE rank = 1) d USING (query_id))
SELECT query_id, key_name, round(cs, 6) AS confidence, cs < 0.5 AS needs_llm,
       CASE WHEN cs >= 0.5 THEN cv::VARCHAR END AS best_value,
       CASE WHEN ds > 0.4 AND query_id > 7 AND named = 'text' THEN 'ratio' ELSE named END AS expected_format,
       CASE WHEN ds > 0.4 THEN dv::VARCHAR END AS value_hint, CASE WHEN ds > 0.4 THEN 'vector ' || dv END AS definition_text
FROM j
"""
ALIAS_FLOOR = 0.7


def alias_research(spark: SparkSession, path: str) -> DataFrame:
    """Mean vectors as first queries, maximum vectors as aliases; only weak keys are searched again."""
    vectors, folder = _vectors(spark, path), run_folder(spark, "aliases")
    retrieval.vector_topk(vectors, _queries(spark, path), 3).write.parquet(folder)
    own = spark.read.parquet(folder)  # searched once, read by the choice and by the result
    other = retrieval.vector_topk(vectors, retrieval.alias_queries(own, _queries(spark, path, F.max), ALIAS_FLOOR), 3)
    return _rounded(retrieval.alias_research(own, other, floor=ALIAS_FLOOR))


ALIAS_SQL = f"""
WITH {_query_sql('m', 'avg')}, {_query_sql('x', 'max')},
b AS (SELECT m.query_id, m.s < {ALIAS_FLOOR} AND x.s > m.s AS use_alias FROM
  (SELECT query_id, max(score) AS s FROM m GROUP BY 1) m JOIN (SELECT query_id, max(score) AS s FROM x GROUP BY 1) x USING (query_id))
SELECT query_id, rank, vec_id, round(score, 6) AS score, use_alias FROM m_top JOIN b USING (query_id) WHERE rank <= 3 AND NOT use_alias
UNION ALL SELECT query_id, rank, vec_id, round(score, 6), use_alias FROM x_top JOIN b USING (query_id) WHERE rank <= 3 AND use_alias
"""


# ------------------------------------------------------------------------------- keywords
def keyword_search(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    return retrieval.keyword_search(bindings.paged_documents(t), bindings.benchmark_keys(t), on="subtype")


# Alternating runs of word and other characters cover the text, so their lengths give offsets.
KEYWORD_SQL = f"""
WITH {S.RENDERED}, {S.BENCHMARK_KEYS},
ch AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS chunk FROM (
  SELECT doc_id, regexp_extract_all(text, '{S.WORD}+|[^\\p{{L}}\\p{{N}}_]+') AS c FROM rendered)),
placed AS (SELECT doc_id, chunk, (sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY i) - length(chunk))::BIGINT AS position FROM ch),
src AS (SELECT doc_id, source FROM documents),
hit AS (SELECT placed.doc_id, key_id, key_name, chunk, position FROM placed JOIN src USING (doc_id)
        JOIN bk ON bk.subtype = src.source AND lower(chunk) = lower(key_name)),
h AS (SELECT hit.*, m.page FROM hit ASOF JOIN marks m ON hit.doc_id = m.doc_id AND m.start <= hit.position)
SELECT h.doc_id, key_id, key_name, row_number() OVER (PARTITION BY h.doc_id, key_id ORDER BY position) - 1 AS match_idx,
       page, chunk AS text, position,
       {S.trim("replace(substr(r.text, greatest(position - 100, 0) + 1, position + length(chunk) + 100 - greatest(position - 100, 0)), chr(10), ' ')")} AS context
FROM h JOIN rendered r ON r.doc_id = h.doc_id
"""


def definition_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Page 2 plays the definitions page."""
    t = Tables(spark, path)
    docs = _lines(spark, path).withColumn("definition_pages", F.array(F.lit(2)))
    return retrieval.definition_candidates(docs, bindings.benchmark_keys(t))


def _boundaries(pattern: str) -> str:
    """Unicode-wide word boundaries for RE2, as one-character alternatives."""
    edge = r"[^\p{L}\p{N}_]"
    out = []
    for alt in pattern.removeprefix("(?iU)").split("|"):
        if alt.startswith(r"\b"):
            alt = f"(^|{edge})" + alt[2:]
        if alt.endswith(r"\b"):
            alt = alt[:-2] + f"($|{edge})"
        out.append(alt)
    return "(?i)" + "|".join(out)


_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+"
DEFINITION_SQL = f"""
WITH {S.LINES}, {S.BENCHMARK_KEYS},
cut AS (SELECT doc_id, source, page, generate_subscripts(x, 1) AS i, {S.trim('unnest(x)')} AS snippet FROM (
  SELECT doc_id, source, page, string_split(regexp_replace(raw, '([.!?]){_WS}', '\\1' || chr(1), 'g'), chr(1)) AS x FROM ln)),
kw AS (SELECT key_id, key_name, subtype, {S.words('key_name')} AS ws FROM bk),
sc AS (SELECT doc_id, key_id, page, i, snippet,
         CASE WHEN page = 2 THEN 3 ELSE 1 END + CASE WHEN regexp_matches(snippet, '{_boundaries(P.DEFINITION_SIGNAL)}') THEN 2 ELSE 0 END
         + CASE WHEN contains(lower(snippet), lower(key_name)) THEN 1 ELSE 0 END AS score
       FROM cut JOIN kw ON kw.subtype = cut.source
       WHERE length(snippet) >= 1 AND (len(ws) = 0 OR len(list_filter(ws, lambda w: contains(lower(snippet), w))) > 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key_id ORDER BY score DESC, page <> 2, page, i) AS n FROM sc),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, key_id, snippet ORDER BY n) = 1)
SELECT doc_id, key_id, row_number() OVER (PARTITION BY doc_id, key_id ORDER BY n) AS rank, score, page, snippet
FROM u QUALIFY rank <= 8
"""


# -------------------------------------------------------------------------- wider contexts
def broader_search(spark: SparkSession, path: str) -> DataFrame:
    docs = _lines(spark, path).withColumn("used_pages", F.array(F.lit(1), F.lit(2)))
    found = retrieval.broader_search(docs)
    return found.select("doc_id", F.array_join("next_pages", ",").alias("next_pages"), "page_text")


BROADER_SQL = f"""
WITH {S.LINES}
SELECT d.doc_id, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page), '') AS next_pages,
       coalesce(string_agg('[Page ' || page || ']' || chr(10) || raw, chr(10) || chr(10) ORDER BY page), '') AS page_text
FROM documents d LEFT JOIN ln ON ln.doc_id = d.doc_id AND page >= 3 GROUP BY d.doc_id
"""


def validator_context(spark: SparkSession, path: str) -> DataFrame:
    return retrieval.validator_context(bindings.paged_documents(Tables(spark, path)), F.array(F.lit(1)))


VALIDATOR_SQL = f"""
WITH {S.RENDERED}
SELECT r.doc_id, '[Page 1]' || chr(10) || pg.text || chr(10) || chr(10) || r.text AS context
FROM rendered r JOIN pg ON pg.doc_id = r.doc_id AND page = 1
"""


def page_snippet(spark: SparkSession, path: str) -> DataFrame:
    return retrieval.page_snippet(bindings.paged_documents(Tables(spark, path)), F.lit(2))


SNIPPET_SQL = f"""
WITH {S.RENDERED},
s AS (SELECT doc_id, text, string_split_regex(text, '(?i)PAGE\\s+2\\b') AS p FROM rendered)
SELECT doc_id, CASE WHEN len(p) > 1 THEN substr(text, length(p[1]) + 1) ELSE text END AS snippet FROM s
"""


def embed_snippets(spark: SparkSession, path: str) -> DataFrame:
    """Sparse TF-IDF of every document, and its dot product with its own first three entries."""
    docs = Tables(spark, path).documents.select("doc_id", F.col("text").alias("snippet"))
    first = retrieval.sparse_dot(F.col("indices"), F.col("weights"), F.slice("indices", 1, 3), F.slice("weights", 1, 3))
    vectors = retrieval.embed_snippets(docs).withColumn("first_three", F.round(first, 6))
    return vectors.select("doc_id", "indices", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), "first_three")


EMBED_SQL = f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{S.WORD}+')) AS word FROM documents),
c AS (SELECT doc_id, ('0x' || left(md5(word), 8))::BIGINT AS i, count(*) AS tf FROM w GROUP BY ALL),
idf AS (SELECT i, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM c GROUP BY i),
x AS (SELECT doc_id, i, tf * idf AS w FROM c JOIN idf USING (i)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id),
u AS (SELECT doc_id, i, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS u, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM x JOIN n USING (doc_id)),
v AS (SELECT doc_id, list(i ORDER BY i) AS indices, list(round(u, 6) ORDER BY i) AS weights, round(sum(u * u) FILTER (nth <= 3), 6) AS first_three FROM u GROUP BY doc_id)
SELECT doc_id, coalesce(indices, []) AS indices, coalesce(weights, []) AS weights, coalesce(first_three, 0) AS first_three FROM documents LEFT JOIN v USING (doc_id)
"""


QUERIES = {
    "route_key_to_section": route_key_to_section, "context_by_terms": context_by_terms,
    "context_by_proximity": context_by_proximity, "vector_topk_cells": vector_topk_cells, "vector_topk": vector_topk,
    "router_decision": router_decision, "alias_research": alias_research, "keyword_search": keyword_search,
    "definition_candidates": definition_candidates, "broader_search": broader_search,
    "validator_context": validator_context, "page_snippet": page_snippet, "embed_snippets": embed_snippets,
}
ORACLES = {
    "route_key_to_section": ROUTE_SQL, "context_by_terms": TERMS_SQL, "context_by_proximity": NEAR_SQL,
    "vector_topk_cells": f"WITH {_CELLS} SELECT query_id, rank, vec_id, round(score, 6) AS score, label FROM cells",
    "vector_topk": f"WITH {_query_sql('m', 'avg')} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM m_top WHERE rank <= 3",
    "router_decision": ROUTER_SQL, "alias_research": ALIAS_SQL, "keyword_search": KEYWORD_SQL,
    "definition_candidates": DEFINITION_SQL, "broader_search": BROADER_SQL, "validator_context": VALIDATOR_SQL,
    "page_snippet": SNIPPET_SQL, "embed_snippets": EMBED_SQL,
}
