"""Page operators on documents whose lines are pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import sql as S
from fieldloom.operators import pages
from fieldloom.sources import bindings
from fieldloom.sources.bindings import Tables

STEP = 250
LONG_LINE = 200


def _docs(spark: SparkSession, path: str) -> DataFrame:
    return bindings.paged_documents(Tables(spark, path))


def split_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages.split_pages(_docs(spark, path))


def page_of_position(spark: SparkSession, path: str) -> DataFrame:
    positions = F.sequence(F.lit(0), F.length("text") - 1, F.lit(STEP))
    return pages.page_of_position(_docs(spark, path), positions)


PAGE_OF_POSITION_SQL = f"""
WITH {S.RENDERED},
pos AS (SELECT doc_id, unnest(generate_series(0, length(text) - 1, {STEP})) AS position FROM rendered)
SELECT p.doc_id, p.position, m.page FROM pos p ASOF JOIN marks m ON p.doc_id = m.doc_id AND m.start <= p.position
"""


def page_summary(spark: SparkSession, path: str) -> DataFrame:
    return pages.page_summary(_docs(spark, path))


PAGE_SUMMARY_SQL = f"""
WITH {S.LINES}
SELECT doc_id, string_agg('[Page ' || page || ']' ||
  CASE WHEN {S.count_char('text', '|')} >= 6 OR {S.count_char('text', '+')} >= 4 OR {S.count_char('text', '│')} >= 3
            OR {S.count_char('text', '─')} >= 10 THEN ' [TABLE DETECTED]' ELSE '' END
  || ' ' || {S.trim("left(text, 350)")}, chr(10) ORDER BY page) AS summary
FROM pg GROUP BY doc_id
"""


def router_summary(spark: SparkSession, path: str) -> DataFrame:
    return pages.router_summary(_docs(spark, path))


ROUTER_SUMMARY_SQL = f"""
WITH {S.RENDERED}
SELECT doc_id, string_agg('[Page ' || page || '] ' || replace(left({S.trim('body')}, 300), chr(10), ' '),
                          chr(10) ORDER BY page) AS summary
FROM part GROUP BY doc_id
"""


def detect_table_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages.detect_table_pages(pages.split_pages(_docs(spark, path)))


DETECT_SQL = f"""
WITH {S.LINES}
SELECT doc_id, page, ({S.count_char('text', '│')} >= 3 OR {S.count_char('text', '|')} >= 6
       OR {S.count_char('text', '─')} >= 10) AS is_table FROM pg
"""


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    wanted = F.array(F.lit(2), F.lit(1), F.lit(9999))
    return pages.page_texts(_docs(spark, path), wanted)


PAGE_TEXTS_SQL = f"""
WITH {S.LINES}
SELECT doc_id, string_agg('[Page ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page DESC) AS page_text
FROM pg WHERE page IN (1, 2) GROUP BY doc_id
"""


def fallback_section_map(spark: SparkSession, path: str) -> DataFrame:
    sections = pages.fallback_section_map(
        _docs(spark, path), is_table=lambda p: F.length(p["text"]) >= LONG_LINE
    )
    return sections.select(
        "doc_id", "section_idx", "topic", "type", F.array_join("pages", ",").alias("pages"),
        F.array_join("parties_pages", ",").alias("parties_pages"), "total_pages",
    )


SECTION_SQL = f"""
WITH {S.LINES},
k AS (SELECT doc_id, page, length(text) >= {LONG_LINE} AS tab FROM pg),
e AS (SELECT *, CASE WHEN tab IS DISTINCT FROM lag(tab) OVER (PARTITION BY doc_id ORDER BY page) THEN 1 ELSE 0 END AS new,
             max(page) OVER (PARTITION BY doc_id) AS total_pages FROM k),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM e)
SELECT doc_id, (run - 1)::INT AS section_idx,
       CASE WHEN any_value(tab) THEN 'Table' ELSE 'Section' END || ' (pages ' || min(page) || '-' || max(page) || ')' AS topic,
       CASE WHEN any_value(tab) THEN 'table' ELSE 'paragraph' END AS type,
       string_agg(page::VARCHAR, ',' ORDER BY page) AS pages, '1' AS parties_pages, any_value(total_pages) AS total_pages
FROM r GROUP BY doc_id, run
"""


def validate_map(spark: SparkSession, path: str) -> DataFrame:
    """A raw map per document: page entries of all sorts, odd types, absent keywords."""
    n = F.size(F.split("text", "\n", -1))
    text = lambda c: c.cast("string")
    maps = Tables(spark, path).documents.select(
        "doc_id", n.alias("total_pages"),
        F.array(
            F.struct(F.col("source").alias("topic"),
                     F.array(F.lit("1"), F.lit("two"), text(n), text(n + 1), F.lit("-1")).alias("pages"),
                     F.col("lang").alias("type"), F.lit(None).cast("array<string>").alias("keywords")),
            F.struct(F.lit("Rates").alias("topic"), F.lit(None).cast("array<string>").alias("pages"),
                     F.lit("table").alias("type"), F.array(F.lit("fee")).alias("keywords")),
        ).alias("sections"),
        F.array(text(n), F.lit("0"), F.lit(None).cast("string")).alias("definitions_pages"),
        F.array(F.lit("x")).alias("parties_pages"),
    )
    fixed = pages.validate_map(maps)
    return fixed.select(
        "doc_id", F.array_join("definitions_pages", ",").alias("definitions_pages"),
        F.size("parties_pages").alias("n_parties_pages"), F.posexplode("sections").alias("section_idx", "s"),
    ).select(
        "doc_id", "definitions_pages", "n_parties_pages", "section_idx", F.col("s.topic").alias("topic"),
        F.array_join("s.pages", ",").alias("pages"), F.col("s.type").alias("type"),
        F.array_join("s.keywords", ",").alias("keywords"),
    )


VALIDATE_SQL = """
WITH d AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, n::VARCHAR AS definitions_pages, 0 AS n_parties_pages, 0 AS section_idx, source AS topic,
       '1,' || n AS pages, 'paragraph' AS type, '' AS keywords FROM d
UNION ALL SELECT doc_id, n::VARCHAR, 0, 1, 'Rates', '', 'table', 'fee' FROM d
"""


def total_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages.total_pages(_docs(spark, path))


TOTAL_SQL = f"""
WITH {S.LINES}
SELECT doc_id, max(page) AS max_page, (count(*) + count(*) FILTER (starts_with(raw, 'PAGE ')))::INT AS page_lines
FROM ln GROUP BY doc_id
"""


def page_chunks(spark: SparkSession, path: str) -> DataFrame:
    return pages.page_chunks(_docs(spark, path)).select("doc_id", "page", "start", "chunk")


CHUNKS_SQL = f"""
WITH {S.LINES},
s AS (SELECT doc_id, page, text, unnest(generate_series(0, greatest(length(text) - 400, 0), 200)) AS start FROM pg),
c AS (SELECT doc_id, page, start, {S.trim('substr(text, start + 1, 400)')} AS chunk FROM s)
SELECT doc_id, page, start, chunk FROM c WHERE length(chunk) >= 40
"""

QUERIES = {
    "split_pages": split_pages, "page_of_position": page_of_position, "page_summary": page_summary,
    "router_summary": router_summary, "detect_table_pages": detect_table_pages, "page_texts": page_texts,
    "fallback_section_map": fallback_section_map, "validate_map": validate_map, "total_pages": total_pages,
    "page_chunks": page_chunks,
}
ORACLES = {
    "split_pages": f"WITH {S.LINES} SELECT doc_id, page, text FROM pg",
    "page_of_position": PAGE_OF_POSITION_SQL, "page_summary": PAGE_SUMMARY_SQL, "router_summary": ROUTER_SUMMARY_SQL,
    "detect_table_pages": DETECT_SQL, "page_texts": PAGE_TEXTS_SQL, "fallback_section_map": SECTION_SQL,
    "validate_map": VALIDATE_SQL, "total_pages": TOTAL_SQL, "page_chunks": CHUNKS_SQL,
}
