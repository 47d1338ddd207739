"""Grid operators on grids made from line items, and on agreements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.catalog import sql as S
from fieldloom.functions import patterns as P
from fieldloom.operators import tables
from fieldloom.sources import bindings
from fieldloom.sources.bindings import Tables, pct


def _grids(spark: SparkSession, path: str) -> DataFrame:
    return bindings.grid_documents(Tables(spark, path))


def locate_tables(spark: SparkSession, path: str) -> DataFrame:
    return tables.locate_tables(_grids(spark, path)).select("doc_id", "page", "table_idx", "table_title")


def parse_grid_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = tables.parse_grid_rows(_grids(spark, path))
    return rows.select("doc_id", "page", "table_idx", "row_idx", F.array_join("cells", "|").alias("cells"))


def classify_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = tables.classify_rows(_grids(spark, path))
    return rows.select("doc_id", "table_idx", "row_idx", "kind", F.array_join("cells", "|").alias("cells"))


_ROWS = f"""
WITH {S.RATES},
rws AS (
  SELECT DISTINCT doc_id, 0 AS row_idx, 'title' AS kind, 'Rates of part ' || doc_id AS cells FROM rates
  UNION ALL SELECT DISTINCT doc_id, 1, 'header', 'Flag|Mean Discount|Mean Tax' FROM rates
  UNION ALL SELECT doc_id, row_idx + 2, 'data', row_label || '|' || {S.pct('dis')} || '|' || {S.pct('tax')} FROM rate_rows
)
"""


def expand_threshold_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header rows with one merged threshold cell per part."""
    n = F.col("p_size").cast("string")
    merged = F.concat(F.lit("< "), n, F.lit(".50 and < "), n, F.lit(".75 and"))
    headers = Tables(spark, path).part.select(
        F.col("p_partkey").alias("doc_id"), F.array(F.lit("Ratio"), merged, F.col("p_name")).alias("cells")
    )
    return tables.expand_threshold_headers(headers).select("doc_id", F.posexplode("cells").alias("col_idx", "cell"))


THRESHOLD_SQL = """
SELECT p_partkey AS doc_id, generate_subscripts(c, 1) - 1 AS col_idx, unnest(c) AS cell FROM (
  SELECT p_partkey, ['Ratio', '< ' || p_size || '.50 and', '< ' || p_size || '.75 and', p_name] AS c FROM part)
"""


def column_headers(spark: SparkSession, path: str) -> DataFrame:
    return tables.column_headers(_grids(spark, path))


COLUMN_SQL = f"""
WITH {S.RATES}
SELECT doc_id, 1 AS page, 0 AS table_idx, generate_subscripts(c, 1) - 1 AS col_idx, unnest(c) AS col_label
FROM (SELECT DISTINCT doc_id, ['Flag', 'Mean Discount', 'Mean Tax'] AS c FROM rates)
"""


def grid_cells(spark: SparkSession, path: str) -> DataFrame:
    return tables.oriented(tables.grid_cells(_grids(spark, path)))


def stitch_cross_page(spark: SparkSession, path: str) -> DataFrame:
    return tables.stitch_cross_page(bindings.split_grid_documents(Tables(spark, path)))


def _cells_sql(page: int) -> str:
    return f"""
    WITH {S.RATES},
    cells AS (
      SELECT doc_id, {page} AS page, 0 AS table_idx, row_idx, 1 AS col_idx, 'Rates of part ' || doc_id AS table_title,
             row_label, 'Mean Discount' AS col_label, {S.pct('dis')} AS value FROM rate_rows
      UNION ALL
      SELECT doc_id, {page}, 0, row_idx, 2, 'Rates of part ' || doc_id, row_label, 'Mean Tax', {S.pct('tax')} FROM rate_rows
    )
    """


GRID_SQL = _cells_sql(1) + """
SELECT *, 'horizontal' AS orientation,
       table_title || ' | ' || row_label || ' | ' || col_label || ' | value: ' || value AS snippet FROM cells
UNION ALL
SELECT *, 'vertical', table_title || ' | ' || col_label || ' | ' || row_label || ' | value: ' || value FROM cells
"""


def split_merged_value(spark: SparkSession, path: str) -> DataFrame:
    """Discount and tax run together; the column label sometimes names the tax."""
    d, x = F.round(F.col("l_discount") * 10000).cast("bigint"), F.round(F.col("l_tax") * 10000).cast("bigint")
    label = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Above "), F.regexp_replace(pct(x), "%", "x")))
    cells = Tables(spark, path).lineitem.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.concat(pct(d), pct(x)).alias("value"),
        F.coalesce(label, F.lit("Plain")).alias("col_label"),
    )
    return tables.split_merged_value(cells)


MERGED_SQL = f"""
WITH v AS (SELECT *, {S.pct('round(l_discount * 10000)::BIGINT')} AS d, {S.pct('round(l_tax * 10000)::BIGINT')} AS x FROM lineitem),
w AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'Above ' || replace(x, '%', 'x') ELSE 'Plain' END AS col_label FROM v)
SELECT l_orderkey, l_linenumber, l_suppkey, col_label,
       CASE WHEN contains(lower(col_label), replace(d, '%', '')) THEN d
            WHEN contains(lower(col_label), replace(x, '%', '')) THEN x ELSE d END AS value FROM w
"""


def known_grid(spark: SparkSession, path: str) -> DataFrame:
    return tables.known_grid(bindings.agreements(Tables(spark, path)))


_KNOWN_LABELS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(P.KNOWN_GRID_COLUMNS, 1))
KNOWN_SQL = f"""
WITH {S.FACTS},
r(row_idx, row_label, step) AS (VALUES (0, 'LIBOR Loans', 0), (1, 'ABR Loans', 100), (2, 'Commitment Fee Rate', 200)),
c(col_idx, col_label) AS (VALUES {_KNOWN_LABELS}),
v AS (SELECT doc_id, 3 AS page, row_idx, '{P.KNOWN_GRID_TITLE}' AS table_title, row_label, col_idx, col_label,
             rate + step + col_idx - 1 AS h FROM facts CROSS JOIN r CROSS JOIN c)
SELECT doc_id, page, row_idx, table_title, row_label, col_idx, col_label,
       CASE WHEN col_idx = 3 THEN replace({S.pct('h')}, '%', '') ELSE {S.pct('h')} END AS value FROM v
"""


def table_terms(spark: SparkSession, path: str) -> DataFrame:
    text = F.concat(
        F.lit("[Table 7]\n│ "), "p_name", F.lit(" "), "p_type", F.lit(" │\nSection "), F.col("p_size").cast("string"),
        F.lit("\n│ 12.50% │ "), F.col("p_size").cast("string"), F.lit(" │\nsee THE EUR rules\n"),
    )
    return tables.table_terms(Tables(spark, path).part.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


TERMS_SQL = """
SELECT DISTINCT doc_id, unnest(['Table 7', 'Section ' || p_size, p_name || ' ' || p_type, p_type, 'EUR']) AS term
FROM (SELECT p_partkey AS doc_id, * FROM part)
"""


def html_table_cells(spark: SparkSession, path: str) -> DataFrame:
    """Web tables of the rates of every part."""
    cells = tables.html_table_cells(bindings.html_documents(Tables(spark, path)))
    return cells.select("doc_id", "page", "table_idx", "table_title", "row_idx", "row_label", "col_idx", "col_label", "value")


HTML_TABLE_SQL = f"""
WITH {S.RATES},
v AS (SELECT *, unnest([1, 2]) AS col_idx FROM rate_rows)
SELECT doc_id, 1 AS page, 0 AS table_idx, 'Rates of part ' || doc_id AS table_title, row_idx, row_label, col_idx,
       CASE col_idx WHEN 1 THEN 'Mean Discount' ELSE 'Mean Tax' END AS col_label,
       CASE col_idx WHEN 1 THEN {S.pct('dis')} ELSE {S.pct('tax')} END AS value FROM v
"""


def html_cells(spark: SparkSession, path: str) -> DataFrame:
    """The web pages hold lists rather than tables: lists read as rows, items as cells."""
    docs = Tables(spark, path).pages.select(F.col("page_id").alias("doc_id"), "html")
    return tables.html_cells(docs, row_tag="ul", cell_tags="li")


HTML_SQL = f"""
WITH r AS (SELECT page_id AS doc_id, generate_subscripts(u, 1) - 1 AS row_idx, unnest(u) AS body
           FROM (SELECT page_id, regexp_extract_all(html, '(?is)<ul\\b[^>]*>(.*?)</ul>', 1) AS u FROM pages)),
c AS (SELECT doc_id, row_idx, generate_subscripts(l, 1) - 1 AS col_idx, unnest(l) AS cell
      FROM (SELECT doc_id, row_idx, regexp_extract_all(body, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS l FROM r))
SELECT doc_id, row_idx, col_idx, 1 AS span, {S.trim(
    "replace(replace(replace(replace(replace(regexp_replace(cell, '</?[A-Za-z][^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), "
    "'&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')")} AS text FROM c
"""

QUERIES = {
    "locate_tables": locate_tables, "parse_grid_rows": parse_grid_rows, "classify_rows": classify_rows,
    "expand_threshold_headers": expand_threshold_headers, "column_headers": column_headers,
    "grid_cells": grid_cells, "split_merged_value": split_merged_value, "stitch_cross_page": stitch_cross_page,
    "known_grid": known_grid, "table_terms": table_terms, "html_table_cells": html_table_cells, "html_cells": html_cells,
}
ORACLES = {
    "locate_tables": f"WITH {S.RATES} SELECT DISTINCT doc_id, 1 AS page, 0 AS table_idx, 'Rates of part ' || doc_id AS table_title FROM rates",
    "parse_grid_rows": _ROWS + "SELECT doc_id, 1 AS page, 0 AS table_idx, row_idx, cells FROM rws",
    "classify_rows": _ROWS + "SELECT doc_id, 0 AS table_idx, row_idx, kind, cells FROM rws",
    "expand_threshold_headers": THRESHOLD_SQL, "column_headers": COLUMN_SQL, "grid_cells": GRID_SQL,
    "split_merged_value": MERGED_SQL, "stitch_cross_page": _cells_sql(2) + "SELECT * FROM cells",
    "known_grid": KNOWN_SQL, "table_terms": TERMS_SQL, "html_table_cells": HTML_TABLE_SQL, "html_cells": HTML_SQL,
}
