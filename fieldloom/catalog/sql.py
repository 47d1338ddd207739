"""Shared pieces of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

from fieldloom.functions.text import BLANKS
from fieldloom.sources.bindings import CURRENCIES, RULE

WORD = r"[\p{L}\p{N}_]"


def trim(expr: str) -> str:
    return f"trim({expr}, '{BLANKS}')"


def words(expr: str, n: int = 3) -> str:
    return f"list_distinct(regexp_extract_all(lower({expr}), '{WORD}{{{n},}}'))"


def count_char(expr: str, ch: str) -> str:
    return f"(length({expr}) - length(replace({expr}, '{ch}', '')))"


def pct(h: str) -> str:
    return f"((({h}) // 100)::VARCHAR || '.' || lpad((({h}) % 100)::VARCHAR, 2, '0') || '%')"


def letters(expr: str) -> str:
    return f"translate(lpad(({expr})::VARCHAR, 9, '0'), '0123456789', 'ABCDEFGHIJ')"


# Lines of documents as pages; ``text`` is the stripped line.
LINES = f"""
ln AS (
  SELECT doc_id, source, generate_subscripts(l, 1)::INT AS page, unnest(l) AS raw
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)
),
pg AS (SELECT doc_id, source, page, {trim('raw')} AS text FROM ln)
"""

_HEADER = f"'{RULE}' || chr(10) || 'PAGE ' || page || chr(10) || '{RULE}' || chr(10)"

# The same documents with page markers, and where each marker starts.
RENDERED = LINES + f""",
part AS (SELECT doc_id, page, {_HEADER} || raw AS body FROM ln),
rendered AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY page) AS text FROM part GROUP BY doc_id),
marks AS (
  SELECT doc_id, page,
         coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY page
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM part
)
"""

CONVERSATION_PAGES = "cp AS (SELECT conv_id AS doc_id, (turn + 1)::INT AS page, role, text FROM conversations)"

BENCHMARK_KEYS = """
bk AS (
  SELECT item_id::INT AS key_id, 'src' || (item_id % 20) AS subtype,
         regexp_extract(text, '([A-Za-z]+)', 1) AS key_name, text AS key_desc
  FROM benchmark
)
"""

_LEVEL = "substr(o_orderpriority, 1, 1)"
_CURRENCY = "CASE " + _LEVEL + "".join(f" WHEN '{d}' THEN '{c}'" for d, c in CURRENCIES.items()) + " END"

FACTS = f"""
facts AS (
  SELECT o_orderkey AS doc_id, o_orderstatus AS st, strftime(o_orderdate, '%B %-d, %Y') AS signed,
         strftime(o_orderdate, '%Y-%m-%d') AS iso_signed,
         'CUSTOMER ' || {letters('o_custkey')} AS borrower, 'BANK OF ' || c_mktsegment AS bank,
         {_CURRENCY} AS currency, format('{{:,}}', floor(o_totalprice)::BIGINT) AS amount,
         upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS segment,
         {letters('o_custkey')} AS letters, {_LEVEL} AS level,
         CASE o_orderstatus WHEN 'F' THEN 'Investment Grade Period'
              WHEN 'O' THEN 'Borrowing Base Trigger Period' ELSE '' END AS period,
         floor(o_totalprice)::BIGINT % 400 AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey
)
"""

# Mean rates per part and flag in integer hundredths of a percent.
RATES = """
rates AS (
  SELECT l_partkey AS doc_id, 'Flag ' || l_returnflag AS row_label,
         (sum(round(l_discount * 100)::BIGINT) * 200 + count(*)) // (count(*) * 2) AS dis,
         (sum(round(l_tax * 100)::BIGINT) * 200 + count(*)) // (count(*) * 2) AS tax
  FROM lineitem GROUP BY ALL
),
rate_rows AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY row_label) - 1)::INT AS row_idx FROM rates
)
"""

RESULTS = """
res AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS key_id, 'Rate ' || l_returnflag || '-' || l_linestatus AS key_name,
         round(l_discount * 100)::INT || '%' AS value,
         CASE WHEN l_quantity > 3 THEN l_quantity / 50 END AS score,
         l_linenumber::VARCHAR AS page,
         CASE l_linestatus WHEN 'F' THEN 'percentage' ELSE 'text' END AS expected_format,
         CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'paragraph' ELSE 'clause' END AS found_in,
         l_suppkey AS supplier
  FROM lineitem
)
"""

REGISTRY = """
lines AS (
  SELECT l_orderkey AS id, count(*)::INT AS total_keys, max(l_shipdate) AS shipped,
         round((sum(round(l_quantity)::BIGINT) / (count(*) * 50))::DECIMAL(18, 9), 3)::DOUBLE AS avg_confidence
  FROM lineitem GROUP BY 1
),
reg AS (
  SELECT o_orderkey AS id, c_name AS name, o_orderpriority AS document_type,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'extracting_fields' ELSE 'queued' END AS pipeline_step,
         CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE 50.0 END::DOUBLE AS progress,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, o_orderdate AS begun,
         CASE WHEN o_orderstatus = 'F' AND shipped IS NOT NULL THEN
              CASE WHEN o_orderpriority = '5-LOW' THEN 'not a date' ELSE strftime(shipped, '%Y-%m-%dT%H:%M:%S') END
         END AS completed_at,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN shipped END AS ended,
         total_keys, CASE WHEN o_orderstatus = 'F' THEN total_keys ELSE 0 END AS processed_keys,
         avg_confidence, 3 AS total_pages,
         CASE WHEN o_orderstatus = 'P' THEN 'waiting' END AS error_msg
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON lines.id = o_orderkey
)
"""

# The three pages of an agreement, as its corpus renders them.
COVENANT = """CASE period WHEN '' THEN 'The ' ELSE 'During any ' || period || ', the ' END
  || 'Borrower shall not permit the Leverage Ratio to be greater than ' || level || ' to 1 at the end of each quarter.'"""
LENDER = """'LOAN NUMBER LN-' || doc_id || chr(10) || 'The lender provides ' || currency || ' ' || amount || ' in total' || chr(10)
  || 'in support of the Borrower''s ' || segment || ' Sector Reform Program'"""
PRICES = f"""'[Table 1]' || chr(10) || '│ Pricing Grid │' || chr(10) || '│ Level │ Base Margin │ Peak Margin │' || chr(10)
  || '│ LIBOR Loans │ ' || {pct('rate')} || ' │ ' || {pct('rate + 50')} || ' │' || chr(10) || '│ ABR Loans │ ' || {pct('rate + 100')} || ' │ ' || {pct('rate + 150')} || ' │'"""
_FEES = " || chr(10) || ".join(
    f"'│ {name} │ ' || {pct(f'rate + {step}')} || ' │ ' || {pct(f'rate + {step + 1}')} || ' │ ' || replace({pct(f'rate + {step + 2}')}, '%', '') || ' │ ' || {pct(f'rate + {step + 3}')} || ' │'"
    for name, step in (("LIBOR Loans", 0), ("ABR Loans", 100), ("Commitment Fee Rate", 200))
)
AGREEMENT_PAGES = f"""
agreement_pages AS (
  SELECT doc_id, 1 AS page, 'LOAN AGREEMENT' || chr(10) || chr(10) || 'dated as of ' || signed || chr(10) || chr(10) || 'between' || chr(10) || borrower
    || chr(10) || 'and' || chr(10) || bank || chr(10) || '(the parties)' || chr(10) || chr(10)
    || CASE st WHEN 'P' THEN '' ELSE borrower || ' ("Borrower") and ' || bank || ' ("Bank") agree as follows.' || chr(10) END || {LENDER} AS body FROM facts
  UNION ALL SELECT doc_id, 2, '"Commitment Fee" means a fee equal to ' || {pct('rate + 25')} || ' per annum on the undrawn amount.' || chr(10) || chr(10)
    || '"Leverage Ratio" means the ratio of total debt to earnings for the period.' || chr(10) || chr(10) || {COVENANT} || chr(10) || chr(10) || {PRICES} FROM facts
  UNION ALL SELECT doc_id, 3, '[Table 2]' || chr(10) || '│ Level │ One │ Two │ Three │ Four │' || chr(10) || {_FEES} || chr(10) || chr(10)
    || 'FOR THE BORROWER' || chr(10) || 'Name: Nadia ' || letters || chr(10) || 'Title: Minister of ' || segment || chr(10) || chr(10)
    || 'FOR THE BANK' || chr(10) || 'By: Omar ' || letters || chr(10) || 'Title: Country Director' FROM facts
)
"""
