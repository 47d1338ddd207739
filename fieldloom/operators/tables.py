"""Text grids → cells.

Locating, classifying and reading a grid only ever needs the document it sits in, so the
whole chain is array expressions on the document row followed by one ``inline``: a scan
stage, no shuffle, whatever the number of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.text import BLANKS, LINE_BREAK_CHAR, as_col, blank_to_null, bound, cut, let, strip

UNKNOWN_TITLE = "Unknown Table"


# ------------------------------------------------------------------------------ locating
def table_blocks(text: Column | str) -> Column:
    """All labelled blocks in text order: ``array<struct<page, block>>``.

    A block runs from the line after its label to the next label, page rule or the end.
    ``page`` is NULL before the first page marker.
    """
    text = as_col(text)

    def blocks(page: Column, body: Column) -> Column:
        parts = let(cut(body, P.TABLE_LABEL), lambda ps: F.slice(ps, F.lit(2), F.size(ps)))
        return F.transform(
            parts,
            lambda part: F.struct(
                page.alias("page"), F.get(cut(part, P.TABLE_END), F.lit(0)).alias("block")
            ),
        )

    def of_segments(numbers: Column) -> Column:
        return F.flatten(F.transform(
            cut(text, P.LOOSE_PAGE_MARKER),
            lambda body, i: blocks(F.get(numbers, i - 1).try_cast("int"), body),
        ))

    return let(F.regexp_extract_all(text, F.lit(P.LOOSE_PAGE_MARKER), F.lit(1)), of_segments)


def border_lines(block: Column) -> Column:
    """Lines that hold a cell border character; an empty line between two line breaks holds none."""
    return F.filter(cut(block, LINE_BREAK_CHAR), lambda line: F.contains(line, F.lit(P.CELL_BORDER)))


def _filled(line: Column) -> Column:
    """Is there more than rules and blanks?"""
    return line.rlike(f"[^{P.BORDER_CHARS}{BLANKS}]")


def split_cells(line: Column, keep_empty: bool = False) -> Column:
    parts = F.transform(F.split(line, P.CELL_BORDER, -1), strip)
    if keep_empty:
        return let(parts, lambda ps: F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 2, F.lit(0))))
    return F.filter(parts, lambda c: c != "")


def grid_rows(block: Column, keep_empty: bool = False) -> Column:
    """Rows of a grid as ``array<array<string>>``; rules and blank rows drop out.

    Empty cells are dropped before alignment unless ``keep_empty`` is set.
    """
    return _rows_of_lines(border_lines(block), keep_empty)


def _rows_of_lines(lines: Column, keep_empty: bool = False) -> Column:
    rows = F.transform(F.filter(lines, _filled), lambda line: split_cells(line, keep_empty))
    return F.filter(rows, lambda r: F.size(r) > 0)


def first_lone_cell(block: Column, min_len: int = 1) -> Column:
    """First row with a single filled cell, as a title."""
    return _lone_cell(border_lines(block), min_len)


def _lone_cell(lines: Column, min_len: int = 1) -> Column:
    rows = F.transform(lines, lambda line: split_cells(line))
    lone = F.filter(rows, lambda r: (F.size(r) == 1) & (F.length(F.get(r, F.lit(0))) >= min_len))
    return F.coalesce(F.get(F.get(lone, F.lit(0)), F.lit(0)), F.lit(UNKNOWN_TITLE))


def locate_tables(docs: DataFrame) -> DataFrame:
    """One row per labelled block that holds a grid."""
    return (
        docs.select("doc_id", F.posexplode_outer(table_blocks("text")).alias("table_idx", "t"))
        .filter(F.col("t").isNotNull())
        .select("doc_id", "table_idx", F.coalesce(F.col("t.page"), F.lit(1)).alias("page"),
                F.col("t.block").alias("block"))
        .filter(F.contains("block", F.lit(P.CELL_BORDER)))
        .withColumn("table_title", first_lone_cell(F.col("block")))
    )


# --------------------------------------------------------------------------- classifying
def is_value(cell: Column) -> Column:
    return cell.rlike(P.ANY_DIGIT) & cell.rlike(P.GRID_VALUE)


def is_stitch_value(line: Column) -> Column:
    return line.rlike(P.ANY_DIGIT) & line.rlike(P.STITCH_VALUE)


def row_kinds(rows: Column, header_rows: int | None = None) -> Column:
    """``title`` / ``header`` / ``data`` per row.

    By default a row without any value-like cell is a header. ``header_rows=n`` overrides that:
    the first n rows after the title are headers, all others data.
    """
    titled = F.size(F.get(rows, F.lit(0))) == 1

    def kind(row: Column, i: Column) -> Column:
        if header_rows is None:
            header = ~F.exists(row, is_value)
        else:
            header = i < F.when(titled, header_rows + 1).otherwise(header_rows)
        return F.when((i == 0) & titled, "title").when(header, "header").otherwise("data")

    return F.transform(rows, kind)


def expand_thresholds(cells: Column) -> Column:
    """A header cell holding several thresholds becomes several columns."""
    return F.flatten(F.transform(cells, lambda c: _threshold_parts(c)))


def _threshold_parts(cell: Column) -> Column:
    return let(
        F.regexp_extract_all(cell, F.lit(P.THRESHOLD), F.lit(0)),
        lambda tokens: F.when(F.size(tokens) > 1, F.transform(tokens, strip)).otherwise(F.array(cell)),
    )


def generic_names(n: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("col_"), i.cast("string"))
    )


def header_names(headers: Column, first_data: Column) -> Column:
    """Combine header rows position by position; ``col_i`` where there is nothing."""
    width = F.array_max(F.transform(headers, lambda h: F.size(h)))

    def name(c: Column) -> Column:
        parts = F.filter(F.transform(headers, lambda h: blank_to_null(F.get(h, c))), lambda p: p.isNotNull())
        return let(parts, lambda ps: F.when(F.size(ps) > 0, F.array_join(ps, " ")).otherwise(
            F.concat(F.lit("col_"), c.cast("string"))
        ))

    return F.when(
        F.size(headers) > 0, F.transform(F.sequence(F.lit(0), width - 1), name)
    ).otherwise(generic_names(F.size(first_data)))


def with_grid(tables: DataFrame, keep_empty: bool = False, header_rows: int | None = None) -> DataFrame:
    """Located tables plus ``rows``, ``kinds``, ``headers``, ``data`` and ``columns``.

    A grid of fewer than two rows gives no table.
    """
    made = tables.withColumn("_grid", F.explode_outer(F.array(
        _parsed(grid_rows(F.col("block"), keep_empty), header_rows)))).filter(F.size("_grid.rows") >= 2)
    return made.select(*tables.columns, "_grid.*")


def _parsed(rows: Column, header_rows: int | None = None) -> Column:
    """``rows``, ``kinds``, ``headers``, ``data`` and ``columns`` of a grid's rows as one bound struct.

    As columns of their own, kinds would be copied into the lambdas that read them, and run once per row.
    """
    def of_kind(rows: Column, kinds: Column, kind: str) -> Column:
        return F.filter(rows, lambda r, i: F.get(kinds, i) == kind)

    def parsed(rows: Column, kinds: Column) -> Column:
        headers, data = F.transform(of_kind(rows, kinds, "header"), expand_thresholds), of_kind(rows, kinds, "data")
        return let(F.struct(headers.alias("headers"), data.alias("data")), lambda g: F.struct(
            rows.alias("rows"), kinds.alias("kinds"), g["headers"].alias("headers"), g["data"].alias("data"),
            header_names(g["headers"], F.get(g["data"], F.lit(0))).alias("columns"),
        ))

    return let(rows, lambda rows: let(row_kinds(rows, header_rows), lambda kinds: parsed(rows, kinds)))


def parse_grid_rows(docs: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per grid row with its cells."""
    return (
        locate_tables(docs)
        .withColumn("rows", grid_rows(F.col("block"), keep_empty))
        .filter(F.size("rows") >= 2)
        .select("doc_id", "page", "table_idx", F.posexplode("rows").alias("row_idx", "cells"))
    )


def classify_rows(docs: DataFrame, header_rows: int | None = None) -> DataFrame:
    return with_grid(locate_tables(docs), header_rows=header_rows).select(
        "doc_id", "page", "table_idx",
        F.posexplode(F.arrays_zip(F.col("rows").alias("cells"), F.col("kinds").alias("kind"))).alias("row_idx", "r"),
    ).select("doc_id", "page", "table_idx", "row_idx", "r.cells", "r.kind")


def expand_threshold_headers(headers: DataFrame, cells: str = "cells") -> DataFrame:
    return headers.withColumn(cells, expand_thresholds(F.col(cells)))


def column_headers(docs: DataFrame, header_rows: int | None = None) -> DataFrame:
    return (
        with_grid(locate_tables(docs), header_rows=header_rows)
        .filter(F.size("data") > 0)
        .select("doc_id", "page", "table_idx", F.posexplode("columns").alias("col_idx", "col_label"))
    )


# ----------------------------------------------------------------------------------- cells
def merged_value(value: Column, col_label: Column) -> Column:
    """Pick one token of a merged cell: the one whose number the column names, else the first."""
    def pick(tokens: Column, label: Column) -> Column:
        named = F.filter(tokens, lambda t: F.contains(label, F.regexp_extract(t, P.MERGED_NUMBER, 0)))
        return F.when(F.size(tokens) <= 1, value).otherwise(
            strip(F.coalesce(F.get(named, F.lit(0)), F.get(tokens, F.lit(0))))
        )

    found = F.regexp_extract_all(value, F.lit(P.MERGED_TOKEN), F.lit(0))
    return let(found, lambda tokens: pick(tokens, F.lower(col_label)))


def split_merged_value(cells: DataFrame, value: str = "value", col_label: str = "col_label") -> DataFrame:
    return cells.withColumn(value, merged_value(F.col(value), F.col(col_label)))


def row_cells(rows: Column, columns: Column, value_test) -> Column:
    """``array<struct<row_idx, col_idx, row_label, col_label, value>>`` of the value cells."""
    def cells_of(row: Column, r: Column) -> Column:
        values = F.slice(row, F.lit(2), F.size(row))
        return F.transform(
            values,
            lambda v, i: F.struct(
                r.alias("row_idx"),
                (i + 1).alias("col_idx"),
                F.get(row, F.lit(0)).alias("row_label"),
                F.coalesce(F.get(columns, i + 1), F.concat(F.lit("col_"), (i + 1).cast("string"))).alias("col_label"),
                v.alias("value"),
            ),
        )

    found = F.filter(F.flatten(F.transform(rows, cells_of)), lambda c: value_test(c["value"]))
    return F.transform(found, lambda c: F.struct(
        c["row_idx"].alias("row_idx"), c["col_idx"].alias("col_idx"), c["row_label"].alias("row_label"),
        c["col_label"].alias("col_label"), merged_value(c["value"], c["col_label"]).alias("value"),
    ))


CELL_COLUMNS = ["doc_id", "page", "table_idx", "row_idx", "col_idx", "table_title", "row_label", "col_label", "value"]


CELL = "struct<page:int,table_idx:int,row_idx:int,col_idx:int,table_title:string,row_label:string,col_label:string,value:string>"


def _cells_of_tables(tables: Column) -> Column:
    """The cells of several tables in one array; a table may be NULL."""
    none = F.array().cast(f"array<{CELL}>")
    return F.flatten(F.transform(tables, lambda cells: F.coalesce(cells, none)))


def _placed(cells: Column, page: Column, table_idx: Column, title: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(
        page.alias("page"), table_idx.alias("table_idx"), c["row_idx"].alias("row_idx"), c["col_idx"].alias("col_idx"),
        title.alias("table_title"), c["row_label"].alias("row_label"), c["col_label"].alias("col_label"), c["value"].alias("value"),
    ))


def grid_cell_array(blocks: Column, keep_empty: bool = False, header_rows: int | None = None) -> Column:
    """The cells of `grid_cells` as an array, from a document's `table_blocks`. A block is cut into lines once."""
    def of_grid(t: Column, i: Column, lines: Column, g: Column) -> Column:
        first = F.get(g["rows"], F.lit(0))
        title = F.when(F.size(first) == 1, F.get(first, F.lit(0))).otherwise(_lone_cell(lines))
        return F.when(F.size(g["rows"]) >= 2, let(title, lambda title: _placed(
            row_cells(g["data"], g["columns"], is_value), F.coalesce(t["page"], F.lit(1)), i, title)))

    def of_block(t: Column, i: Column) -> Column:
        return F.when(F.contains(t["block"], F.lit(P.CELL_BORDER)), let(border_lines(t["block"]), lambda lines: let(
            _parsed(_rows_of_lines(lines, keep_empty), header_rows), lambda g: of_grid(t, i, lines, g))))

    return _cells_of_tables(F.transform(blocks, of_block))


def _rows_of_cells(docs: DataFrame, cells: Column) -> DataFrame:
    return docs.select("doc_id", F.inline_outer(cells)).select(*CELL_COLUMNS).filter(F.col("value").isNotNull())


def grid_cells(docs: DataFrame, keep_empty: bool = False, header_rows: int | None = None) -> DataFrame:
    """Every row × column value cell of every grid."""
    return _rows_of_cells(docs, grid_cell_array(table_blocks("text"), keep_empty, header_rows))


def oriented(cells: DataFrame) -> DataFrame:
    """Each cell read along its row and along its column."""
    def snippet(first: str, second: str) -> Column:
        return F.concat_ws(" | ", "table_title", first, second, F.concat(F.lit("value: "), F.col("value")))

    return cells.select(
        "*",
        F.inline(F.array(
            F.struct(F.lit("horizontal").alias("orientation"), snippet("row_label", "col_label").alias("snippet")),
            F.struct(F.lit("vertical").alias("orientation"), snippet("col_label", "row_label").alias("snippet")),
        )),
    )


# -------------------------------------------------------------------- tables over two pages
def _rows_of(lines: Column) -> Column:
    return F.transform(lines, lambda line: split_cells(line))


def stitched_cell_array(blocks: Column, reach: int = 2) -> Column:
    """The cells of `stitch_cross_page` as an array, from a document's `table_blocks`."""
    def with_lines(t: Column) -> Column:
        return let(border_lines(t["block"]), lambda lines: F.struct(
            t["page"].alias("page"), lines.alias("lines"), F.filter(lines, is_stitch_value).alias("data"),
            F.filter(lines, lambda line: ~is_stitch_value(line)).alias("plain"),
        ))

    def names_in(t: Column) -> Column:
        rest = _rows_of(F.slice(t["plain"], F.lit(2), F.size(t["plain"])))
        return F.get(F.filter(rest, lambda r: F.size(r) > 1), F.lit(0))

    def with_data_below(ts: Column, i: Column) -> Column:
        nxt = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: F.get(ts, i + k))
        return F.get(F.filter(nxt, lambda t: F.size(t["data"]) > 0), F.lit(0))

    def joined(t: Column, i: Column, names: Column, below: Column) -> Column:
        data = F.filter(_rows_of(below["data"]), lambda r: F.size(r) >= 2)
        n_values = F.size(split_cells(F.get(below["data"], F.lit(0)))) - 1
        columns = let(n_values, lambda n: F.when(F.size(names) >= n, names).otherwise(generic_names(n + 1)))
        return let(_lone_cell(t["lines"], 4), lambda title: let(columns, lambda columns: _placed(
            row_cells(data, columns, is_stitch_value), below["page"], i, title)))

    def of_table(ts: Column, t: Column, i: Column) -> Column:
        header_only = (F.size(t["data"]) == 0) & (F.size(t["plain"]) > 0)
        return F.when(header_only, let(F.struct(names_in(t).alias("names"), with_data_below(ts, i).alias("below")), lambda s: F.when(
            s["names"].isNotNull() & s["below"].isNotNull(), joined(t, i, s["names"], s["below"]))))

    cells = let(F.transform(blocks, with_lines), lambda ts: _cells_of_tables(F.transform(ts, lambda t, i: of_table(ts, t, i))))
    return F.when(F.size(blocks) > 1, cells)


def stitch_cross_page(docs: DataFrame, reach: int = 2) -> DataFrame:
    """A header-only grid takes its data from the first of the next ``reach`` tables with any."""
    return _rows_of_cells(docs, let(table_blocks("text"), lambda blocks: stitched_cell_array(blocks, reach)))


def known_cell_array(
    text: Column | str, row_pattern: str = P.KNOWN_GRID_ROW, columns: list[str] = P.KNOWN_GRID_COLUMNS, title: str = P.KNOWN_GRID_TITLE,
    marker: str = P.LOOSE_PAGE_MARKER,
) -> Column:
    """The cells of `known_grid` as an array; NULL without a matching row."""
    from fieldloom.operators.pages import marked_matches, page_at

    groups = {"row_label": 1, **{f"v{i}": i + 1 for i in range(1, len(columns) + 1)}}
    value = lambda raw: let(strip(raw), lambda v: F.coalesce(
        F.get(F.regexp_extract_all(v, F.lit(P.KNOWN_GRID_TOKEN), F.lit(0)), F.lit(0)), v))

    def cells(markers: Column, m: Column, row_idx: Column) -> Column:
        place = F.struct(page_at(markers, m["start"]).alias("page"), strip(m["row_label"]).alias("row_label"))
        return let(place, lambda at: F.array(*[F.struct(
            at["page"].alias("page"), row_idx.alias("row_idx"), F.lit(title).alias("table_title"), at["row_label"].alias("row_label"),
            F.lit(i).alias("col_idx"), F.lit(name).alias("col_label"), value(m[f"v{i}"]).alias("value"),
        ) for i, name in enumerate(columns, 1)]))

    return let(marked_matches(text, row_pattern, groups, marker), lambda r: F.flatten(
        F.transform(r["found"], lambda m, i: cells(r["markers"], m, i))))


def known_grid(
    docs: DataFrame,
    row_pattern: str = P.KNOWN_GRID_ROW,
    columns: list[str] = P.KNOWN_GRID_COLUMNS,
    title: str = P.KNOWN_GRID_TITLE,
    marker: str = P.LOOSE_PAGE_MARKER,
) -> DataFrame:
    """Rows of a fixed layout: group 1 is the row label, the next groups the column values."""
    cells = known_cell_array("text", row_pattern, columns, title, marker)
    return docs.select("doc_id", F.inline_outer(cells)).filter(F.col("table_title").isNotNull())


def with_cells(docs: DataFrame) -> DataFrame:
    """Texts with the cells of all their grids as the array ``cells``: source (grid, stitched, known), page, title, labels, value.

    The blocks of tables are cut once for plain grids and those continued on the next page.
    """
    kept = ["page", "table_title", "row_label", "col_label", "value"]
    none = F.array().cast("array<struct<source:string,page:int,table_title:string,row_label:string,col_label:string,value:string>>")

    def of(source: str) -> Column:
        return F.coalesce(F.transform(f"_{source}", lambda c: F.struct(F.lit(source).alias("source"), *[c[k].alias(k) for k in kept])), none)

    gridded = F.contains("text", F.lit(P.CELL_BORDER))
    cut_up = bound(docs, _blocks=F.when(gridded, table_blocks("text")))
    found = bound(cut_up, _grid=grid_cell_array(F.col("_blocks")), _stitched=stitched_cell_array(F.col("_blocks")),
                  _known=F.when(gridded, known_cell_array("text")))
    return bound(found, cells=F.concat(of("grid"), of("stitched"), of("known"))).select(*docs.columns, "cells")


def table_term_array(text: Column | str) -> Column:
    """Search terms a table suggests: codes, leading phrases of cells, acronyms. Sorted."""
    text = as_col(text)

    def every(pattern: str, group: int = 0, of: Column = text) -> Column:
        return F.regexp_extract_all(of, F.lit(pattern), F.lit(group))

    cells = F.filter(
        F.transform(every(P.TERM_CELL, 1), strip), lambda c: ~c.rlike(P.TERM_NUMERIC_CELL)
    )
    cell_words = F.filter(
        F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(P.TERM_WORD), F.lit(0))),
        lambda ws: F.size(ws) >= 2,
    )
    phrases = F.transform(cell_words, lambda ws: F.array_join(F.slice(ws, 1, 3), " "))
    cell_acronyms = F.flatten(
        F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(P.TERM_CELL_ACRONYM), F.lit(0)))
    )
    acronyms = F.filter(every(P.TERM_ACRONYM), lambda a: ~a.isin(P.TERM_STOP))
    parts = [F.transform(every(P.TERM_CODE), strip), phrases, cell_acronyms, acronyms]
    return F.array_sort(F.array_distinct(reduce(F.concat, parts)))


def table_terms(tables: DataFrame, text: str = "text") -> DataFrame:
    return tables.select("doc_id", F.explode(table_term_array(text)).alias("term"))


# ------------------------------------------------------------------------------------ HTML
def html_rows(html: Column | str, row_tag: str = "tr", cell_tags: str = "t[dh]") -> Column:
    """Rows of marked-up cells as ``array<array<struct<text, span>>>``."""
    rows = F.regexp_extract_all(
        as_col(html), F.lit(rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), F.lit(1)
    )
    cell = rf"(?is)<(?:{cell_tags})\b([^>]*)>(.*?)</(?:{cell_tags})>"

    def plain(body: Column) -> Column:
        text = F.regexp_replace(body, r"</?[A-Za-z][^>]*>", "")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(char))
        return strip(text)

    return F.transform(
        rows,
        lambda r: F.zip_with(
            F.regexp_extract_all(r, F.lit(cell), F.lit(1)),
            F.regexp_extract_all(r, F.lit(cell), F.lit(2)),
            lambda attrs, body: F.struct(
                plain(body).alias("text"),
                F.coalesce(
                    blank_to_null(F.regexp_extract(attrs, r'(?i)colspan\s*=\s*"?(\d+)', 1)).try_cast("int"), F.lit(1)
                ).alias("span"),
            ),
        ),
    )


def html_cells(docs: DataFrame, html: str = "html", row_tag: str = "tr", cell_tags: str = "t[dh]") -> DataFrame:
    """Raw cells: one row per (document, row, column)."""
    rows = docs.select("doc_id", F.posexplode(html_rows(html, row_tag, cell_tags)).alias("row_idx", "cells"))
    return rows.select("doc_id", "row_idx", F.posexplode("cells").alias("col_idx", "c")).select(
        "doc_id", "row_idx", "col_idx", F.col("c.text").alias("text"), F.col("c.span").alias("span")
    )


def html_table_cells(docs: DataFrame, html: str = "html") -> DataFrame:
    """Title row (one spanning cell), header row, then row × column value cells, per table."""
    tables = docs.select(
        "doc_id",
        F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1)))
        .alias("table_idx", "body"),
    ).withColumn("rows", html_rows("body"))
    first = F.get("rows", F.lit(0))
    titled = F.size(first) == 1
    tables = (
        tables.withColumn("table_title", F.when(titled, F.get(first, F.lit(0))["text"]).otherwise(UNKNOWN_TITLE))
        .withColumn("body_rows", F.when(titled, F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows")))
        .withColumn("names", F.get("body_rows", F.lit(0))["text"])
        .withColumn("data", F.transform(
            F.slice("body_rows", F.lit(2), F.size("body_rows")), lambda r: F.transform(r, lambda c: c["text"])
        ))
    )
    return tables.select(
        "doc_id", F.lit(1).alias("page"), "table_idx", "table_title",
        F.inline(row_cells(F.col("data"), F.col("names"), is_value)),
    ).select(*CELL_COLUMNS)
