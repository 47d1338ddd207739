"""Pages of a document: splitting, lookups, summaries, section runs, chunks.

A document is one row, so everything that concerns one document is an array expression on
that row: no shuffle, and a long document costs its own length only. Operators that start
from page rows (``page_range``, ``assemble_pages``) are separate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.text import as_col, clip, count_char, cut, let, match_spans, span, strip

PAGES = "array<struct<page:int,text:string>>"


def page_array(text: Column | str, marker: str = P.PAGE_MARKER) -> Column:
    """``array<struct<page, text>>`` of a marked-up text.

    No marker: one page 1 holding the untouched text. Text before the first marker is dropped.
    A repeated page number keeps its first position and its last text.
    """
    text = as_col(text)
    whole = F.array(F.struct(F.lit(1).alias("page"), text.alias("text")))

    def last_wins(pages: Column, distinct: Column) -> Column:
        return F.transform(distinct, lambda n: F.try_element_at(F.filter(pages, lambda p: p["page"] == n), F.lit(-1)))

    def unique(pages: Column) -> Column:
        return let(F.array_distinct(pages["page"]), lambda distinct: F.when(
            F.size(distinct) < F.size(pages), last_wins(pages, distinct)).otherwise(pages))

    return F.when(text.rlike(marker), let(_marked_pages(text, marker), unique)).otherwise(whole)


def _marked_pages(text: Column, marker: str) -> Column:
    """Pages as marked, repeats included; empty without a marker. Numbers beyond an int are no page numbers: such pages leave."""
    def numbered(numbers: Column) -> Column:
        bodies = F.slice(cut(text, marker), F.lit(2), F.size(numbers))
        pages = F.zip_with(
            numbers, bodies, lambda n, body: F.struct(n.try_cast("int").alias("page"), strip(body).alias("text"))
        )
        return F.filter(pages, lambda p: p["page"].isNotNull())

    return let(F.regexp_extract_all(text, F.lit(marker), F.lit(1)), numbered)


def with_pages(docs: DataFrame, marker: str = P.PAGE_MARKER, text: str = "text") -> DataFrame:
    return docs.withColumn("pages", page_array(text, marker))


def split_pages(docs: DataFrame, marker: str = P.PAGE_MARKER) -> DataFrame:
    """One row per page."""
    return docs.select("doc_id", F.inline_outer(page_array("text", marker))).filter(F.col("text").isNotNull())


# ------------------------------------------------------------------------ page of an offset
def marker_array(text: Column | str, marker: str = P.PAGE_MARKER) -> Column:
    """Markers in text order: ``array<struct<start, stop, page>>``."""
    found = match_spans(text, marker, {"page": 1}, whole=marker in P.WHOLE)
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            (m["start"] + F.length(m["hit"])).alias("stop"),
            m["page"].try_cast("int").alias("page"),
        ),
    )


def marked_matches(
    text: Column | str, pattern: str, groups: dict[str, int] | None = None, marker: str = P.PAGE_MARKER, tail: str = ""
) -> Column:
    """``struct<found, markers>`` of a text, NULL without a match; one search serves as test and as result."""
    return let(match_spans(text, pattern, groups, tail), lambda found: F.when(
        F.size(found) > 0, F.struct(found.alias("found"), marker_array(text, marker).alias("markers"))))


def page_at(markers: Column, position: Column, default: int | None = None, by: str = "start") -> Column:
    """Page of the last marker that starts (or, ``by='stop'``, ends) at or before an offset."""
    before = F.filter(markers, lambda m: m[by] <= position)
    page = F.try_element_at(before, F.lit(-1))["page"]
    return page if default is None else F.coalesce(page, F.lit(default))


def page_of_position(
    docs: DataFrame,
    positions: Column,
    marker: str = P.PAGE_MARKER,
    default: int | None = None,
    by: str = "start",
) -> DataFrame:
    """Look up the page of every offset in the array column ``positions``."""
    looked_up = let(marker_array("text", marker), lambda markers: F.transform(
        positions,
        lambda at: F.struct(at.cast("int").alias("position"), page_at(markers, at, default, by).alias("page")),
    ))
    return docs.select("doc_id", F.inline_outer(looked_up)).filter(F.col("position").isNotNull())


# ------------------------------------------------------------------------------- summaries
def has_grid(
    text: Column | str, borders: int = 3, pipes: int = 6, rules: int = 10, pluses: int | None = None
) -> Column:
    """Does a page look like it holds a text grid?"""
    text = as_col(text)
    found = (
        (count_char(text, "│") >= borders)
        | (count_char(text, "|") >= pipes)
        | (count_char(text, "─") >= rules)
    )
    return found if pluses is None else found | (count_char(text, "+") >= pluses)


def summary_line(page: Column, text: Column, max_chars: int = 350) -> Column:
    tag = F.when(has_grid(text, pluses=4), " [TABLE DETECTED]").otherwise("")
    preview = strip(F.replace(clip(text, max_chars), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("[Page "), page.cast("string"), F.lit("]"), tag, F.lit(" "), preview)


def page_summary(docs: DataFrame, max_chars: int = 350, marker: str = P.PAGE_MARKER) -> DataFrame:
    """One summary text per document, a line per page in page order."""
    ordered = F.array_sort(F.col("pages"))
    lines = F.transform(ordered, lambda p: summary_line(p["page"], p["text"], max_chars))
    return with_pages(docs, marker).select("doc_id", F.array_join(lines, "\n").alias("summary"))


def router_summary(
    docs: DataFrame, max_chars: int = 300, max_pages: int | None = None, unpaged_chars: int | None = None
) -> DataFrame:
    """Shorter summary, each preview starting at its marker; on demand of the first pages or characters only."""
    text = F.col("text")

    def lines(markers: Column) -> Column:
        def line(m: Column, i: Column) -> Column:
            following = F.get(markers, i + 1)["start"]
            body = span(text, m["start"], F.coalesce(following, F.length(text)) - m["start"])
            preview = F.replace(clip(strip(body), max_chars), F.lit("\n"), F.lit(" "))
            return F.concat(F.lit("[Page "), m["page"].cast("string"), F.lit("] "), preview)

        return F.array_join(F.transform(markers if max_pages is None else F.slice(markers, 1, max_pages), line), "\n")

    summary = F.when(text.rlike(P.PAGE_MARKER), let(marker_array("text"), lines)).otherwise(text if unpaged_chars is None else clip(text, unpaged_chars))
    return docs.select("doc_id", summary.alias("summary"))


def detect_table_pages(
    pages: DataFrame, borders: int = 3, pipes: int = 6, rules: int = 10
) -> DataFrame:
    """Page rows → flag; a per-row test, so it stays in the scan stage."""
    return pages.select("doc_id", "page", has_grid("text", borders, pipes, rules).alias("is_table"))


def page_text(pages: Column, wanted: Column) -> Column:
    """Texts of the wanted pages in list order, labelled; missing pages are skipped."""
    def joined(by_page: Column) -> Column:
        labelled = F.transform(
            wanted, lambda p: F.concat(F.lit("[Page "), p.cast("string"), F.lit("]\n"), F.try_element_at(by_page, p))
        )
        return F.array_join(F.filter(labelled, lambda t: t.isNotNull()), "\n\n")

    return let(F.map_from_arrays(pages["page"], pages["text"]), joined)


def page_texts(docs: DataFrame, wanted: Column, marker: str = P.PAGE_MARKER) -> DataFrame:
    return with_pages(docs, marker).select("doc_id", page_text(F.col("pages"), wanted).alias("page_text"))


# ---------------------------------------------------------------------------- section maps
SECTION = "struct<topic:string,pages:array<int>,type:string,keywords:array<string>>"


def section_runs(pages: Column, is_table=None) -> Column:
    """Consecutive pages of one kind form a section.

    The run starts are found by comparing neighbours; each section is then a slice between
    two starts, so the cost is linear in the number of pages.
    """
    is_table = is_table or (lambda p: has_grid(p["text"]))
    def section(ordered: Column, first: Column, last: Column) -> Column:
        kind = F.get(ordered, first - 1)["tab"]

        def named(numbers: Column) -> Column:
            topic = F.concat(
                F.when(kind, "Table").otherwise("Section"),
                F.lit(" (pages "), F.get(numbers, F.lit(0)).cast("string"),
                F.lit("-"), F.try_element_at(numbers, F.lit(-1)).cast("string"), F.lit(")"),
            )
            return F.struct(
                topic.alias("topic"), numbers.alias("pages"),
                F.when(kind, "table").otherwise("paragraph").alias("type"),
                F.array().cast("array<string>").alias("keywords"),
            )

        return let(F.slice(ordered, first, last - first + 1)["page"], named)

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == 1) | (F.get(ordered, i - 1)["tab"] != F.get(ordered, i - 2)["tab"]),
        )
        return let(starts, lambda at: F.zip_with(
            at,
            F.concat(F.transform(F.slice(at, F.lit(2), F.size(at)), lambda s: s - 1), F.array(F.size(ordered))),
            lambda first, last: section(ordered, first, last),
        ))

    flagged = F.transform(
        F.array_sort(pages), lambda p: F.struct(p["page"].alias("page"), is_table(p).alias("tab"))
    )
    return let(flagged, runs)


def fallback_section_map(docs: DataFrame, marker: str = P.PAGE_MARKER, is_table=None) -> DataFrame:
    """Section rows plus the document-level lists, for documents without a model-made map."""
    paged = with_pages(docs, marker).select(
        "doc_id",
        section_runs(F.col("pages"), is_table).alias("sections"),
        F.array_max(F.col("pages")["page"]).alias("total_pages"),
        F.when(F.array_contains(F.col("pages")["page"], 1), F.array(F.lit(1)))
        .otherwise(F.array().cast("array<int>"))
        .alias("parties_pages"),
    )
    return paged.select(
        "doc_id", "total_pages", "parties_pages", F.posexplode("sections").alias("section_idx", "s")
    ).select(
        "doc_id", "section_idx", F.col("s.topic").alias("topic"), F.col("s.pages").alias("pages"),
        F.col("s.type").alias("type"), F.col("s.keywords").alias("keywords"),
        F.array().cast("array<int>").alias("definitions_pages"), "parties_pages", "total_pages",
    )


def valid_pages(raw: Column, total: Column) -> Column:
    """Keep entries that are integers within 1..total, in list order."""
    cast = F.transform(raw, lambda p: p.try_cast("int"))
    return F.coalesce(
        F.filter(cast, lambda p: p.isNotNull() & (p >= 1) & (p <= total)),
        F.array().cast("array<int>"),
    )


def validate_map(maps: DataFrame) -> DataFrame:
    """Clean a model-made map: ``sections`` (raw page lists), page lists and ``total_pages``."""
    total = F.col("total_pages")
    fixed = F.transform(
        "sections",
        lambda s: F.struct(
            s["topic"].alias("topic"),
            valid_pages(s["pages"], total).alias("pages"),
            F.when(s["type"].isin("table", "paragraph"), s["type"]).otherwise("paragraph").alias("type"),
            F.coalesce(s["keywords"], F.array().cast("array<string>")).alias("keywords"),
        ),
    )
    return maps.withColumns({
        "sections": fixed,
        "definitions_pages": valid_pages(F.col("definitions_pages"), total),
        "parties_pages": valid_pages(F.col("parties_pages"), total),
    })


def total_pages(docs: DataFrame, marker: str = P.PAGE_MARKER) -> DataFrame:
    """Both page counts in use: highest page number, and number of ``PAGE`` lines."""
    text = F.col("text")
    lines = F.regexp_count(text, F.lit("\nPAGE ")) + F.when(F.startswith(text, F.lit("PAGE ")), 1).otherwise(0)
    return with_pages(docs, marker).select(
        "doc_id",
        F.array_max(F.col("pages")["page"]).alias("max_page"),
        lines.cast("int").alias("page_lines"),
    )


def page_chunks(
    docs: DataFrame, size: int = 400, stride: int = 200, max_pages: int | None = None, min_chars: int = 40,
    unpaged: bool = True, marker: str = P.PAGE_MARKER,
) -> DataFrame:
    """Overlapping windows over the marked pages, on demand over the first ones only.

    ``unpaged=True`` also chunks a document without markers (as page 1).
    """
    text = F.col("text")
    marked = _marked_pages(text, marker)
    if unpaged:
        lone = F.array(F.struct(F.lit(1).alias("page"), strip(text).alias("text")))
        marked = F.when(text.rlike(marker), marked).otherwise(lone)
    starts = F.sequence(F.lit(0), F.greatest(F.length("body") - size, F.lit(0)), F.lit(stride))
    return (
        docs.select("doc_id", F.posexplode_outer(marked if max_pages is None else F.slice(marked, 1, max_pages)).alias("page_idx", "p"))
        .filter(F.col("p").isNotNull())
        .select("doc_id", "page_idx", F.col("p.page").alias("page"), F.col("p.text").alias("body"))
        .select("doc_id", "page_idx", "page", "body", F.explode(starts).alias("start"))
        .select("doc_id", "page_idx", "page", "start",
                strip(span(F.col("body"), F.col("start"), F.lit(size))).alias("chunk"))
        .filter(F.length("chunk") >= min_chars)
    )


# ------------------------------------------------------------------- operators on page rows
def page_range(pages: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """One-based inclusive slice, clamped; ``page_range(p, 5)`` keeps page 5 only."""
    return pages.filter(F.col("page").between(max(1, first), first if last is None else last))


def parse_page_range(spec: str) -> tuple[int, int]:
    """``"3-7"`` or ``"5"``."""
    first, _, last = spec.partition("-")
    return int(first), int(last or first)


def assemble_pages(pages: DataFrame, block: int = 512) -> DataFrame:
    """Page rows → one text per document, pages in order under ruled headers.

    Built in two steps: pages are first joined within blocks of page numbers, so the shuffle
    and the sorting of even a very long document spread over many tasks; the second step only
    concatenates the block texts, which is the result value itself.
    """
    header = F.concat(F.lit("── Page "), F.col("page").cast("string"), F.lit(" ──\n"), F.col("text"))

    def joined(rows: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.col(rows)), lambda r: r["part"]), "\n\n")

    blocks = (
        pages.groupBy("doc_id", F.floor(F.col("page") / block).alias("block"))
        .agg(F.collect_list(F.struct(F.col("page").alias("at"), header.alias("part"))).alias("rows"))
        .select("doc_id", "block", joined("rows").alias("part"))
    )
    return (
        blocks.groupBy("doc_id")
        .agg(F.collect_list(F.struct(F.col("block").alias("at"), "part")).alias("rows"))
        .select("doc_id", joined("rows").alias("text"))
    )


def split_batch_response(responses: DataFrame, n: Column | int, text: str = "text") -> DataFrame:
    """Split a multi-page answer back into exactly ``n`` page texts."""
    n = F.lit(n) if isinstance(n, int) else n
    def texts(parts: Column) -> Column:
        return F.when(F.size(parts) == 1, parts).otherwise(
            F.transform(F.slice(parts, F.lit(2), F.size(parts)), strip)
        )

    def fitted(found: Column) -> Column:
        padded = F.concat(found, F.array_repeat(F.lit(""), F.greatest(n - F.size(found), F.lit(0))))
        return F.slice(padded, F.lit(1), n)

    split = let(F.split(strip(text), P.BATCH_MARKER, -1), texts)
    return responses.withColumn("texts", let(split, fitted))
