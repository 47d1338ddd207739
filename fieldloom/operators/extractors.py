"""Typed values out of running text: definitions, covenants, dates, parties, amounts, …

Each family is an array expression over one document's text, so any set of families is one pass
over the corpus. Matches are taken from the whole document, so one that runs over a page break
is still found; pages are assigned by offset. "First occurrence wins" is an aggregate
(``min_by`` over the offset), which combines within each task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.text import bound, clip, contains_any, group1, let, match_spans, span, squash, strip
from fieldloom.operators.pages import marked_matches, marker_array, page_at

MATCH = (
    "array<struct<source:string,rank:int,pos:int,page:int,table_title:string,row_label:string,"
    "col_label:string,value:string,suffix:string>>"
)
MATCH_COLUMNS = ["source", "rank", "pos", "page", "table_title", "row_label", "col_label", "value"]
# Families in which every match counts; in the others the first of equal values wins.
REPEATED = ["signer", "id"]


def matches(text: Column, pattern: str, groups: dict[str, int], to_row) -> Column:
    """``to_row`` over all matches; a text without a match costs one failed search."""
    whole = "\n" if pattern in P.WHOLE_LINES else pattern in P.WHOLE
    return F.transform(match_spans(text, pattern, groups, whole=whole), to_row)


def _row(source: str, rank: int, pos, page, title, row, col, value, suffix=None) -> Column:
    """One match. ``suffix`` is added to the value after equal values have been merged."""
    title, row, col = [F.lit(c) if isinstance(c, str) else c for c in (title, row, col)]
    return F.struct(
        F.lit(source).alias("source"), F.lit(rank).alias("rank"), pos.cast("int").alias("pos"),
        page.cast("int").alias("page"), title.alias("table_title"), row.alias("row_label"),
        col.alias("col_label"), value.alias("value"),
        (F.lit(None).cast("string") if suffix is None else suffix).alias("suffix"),
    )


def _joined(*arrays: Column) -> Column:
    empty = F.array().cast(MATCH)
    return F.concat(*[F.coalesce(a, empty) for a in arrays])


def _page(markers: Column, pos: Column) -> Column:
    return page_at(markers, pos)


# ------------------------------------------------------------------------------- families
def date_matches(text: Column, markers: Column) -> Column:
    def of(pattern: str, rank: int) -> Column:
        def to_row(m: Column) -> Column:
            return _row("date", rank, m["start"], _page(markers, m["start"]), "Document Metadata", "Agreement Date",
                        "effective date", strip(m["v"]))
        return matches(text, pattern, {"v": 1}, to_row)

    return _joined(*[of(p, i) for i, p in enumerate(P.AGREEMENT_DATES)])


def party_matches(text: Column, markers: Column) -> Column:
    def named(m: Column) -> Column:
        return _row("party", 0, m["start"], _page(markers, m["start"]), "Parties", strip(m["role"]), "name",
                    squash(m["name"]))

    def paired(m: Column) -> Column:
        return F.array(*[
            _row("party", rank, m["start"], _page(markers, m["start"]), "Parties", role, "name", squash(m[group]))
            for rank, (group, role) in enumerate((("a", "Borrower"), ("b", "Bank")), 1)
        ])

    first_pair = F.slice(match_spans(text, P.BETWEEN_PARTIES, {"a": 1, "b": 2}), 1, 1)

    return _joined(
        matches(text, P.NAMED_PARTY, {"name": 1, "role": 2}, named),
        F.flatten(F.transform(first_pair, paired)),
    )


def _amount_value(m: Column) -> Column:
    return F.concat(F.upper(m["code"]), F.lit(" "), strip(m["number"]))


def _amounts(text: Column) -> Column:
    return match_spans(text, P.AMOUNT, {"code": 1, "number": 2}, whole=True)


def amount_matches(text: Column, markers: Column, found: Column | None = None) -> Column:
    """``found``: the amounts of the text, where they have been sought."""
    def to_row(m: Column) -> Column:
        return _row("amount", 0, m["start"], _page(markers, m["start"]), "Loan Terms", "Loan Amount",
                    F.upper(m["code"]), _amount_value(m))
    return _joined(F.transform(_amounts(text) if found is None else found, to_row))


def currency_matches(text: Column, markers: Column, found: Column | None = None) -> Column:
    def to_row(m: Column) -> Column:
        return _row("currency", 0, m["start"], _page(markers, m["start"]), "Loan Terms", "Loan Principal Currency",
                    "principal denomination currency code", F.upper(m["code"]))
    return _joined(F.transform(_amounts(text) if found is None else found, to_row))


def nearest_side(text: Column, pos: Column) -> Column:
    """Which party's marker comes last within the look-back window; Borrower by default.

    One search from the window's end: the greedy start gives way until a marker of either side follows.
    """
    begin = F.greatest(pos - P.PARTY_LOOKBACK, F.lit(0))
    bank = F.regexp_extract(span(text, begin, pos - begin), P.LAST_SIDE, 1)
    return F.when(bank != "", "Bank").otherwise("Borrower")


def signer_matches(text: Column, markers: Column) -> Column:
    def of(pattern: str, what: str, rank: int) -> Column:
        def to_row(m: Column) -> Column:
            role = F.concat(nearest_side(text, m["start"]), F.lit(" Authorized Representative"))
            return _row("signer", rank, m["start"], _page(markers, m["start"]), "Signatures", role, what, squash(m["v"]))
        return matches(text, pattern, {"v": 1}, to_row)

    names = F.filter(of(P.SIGNER_NAME, "name", 0), lambda r: F.length(r["value"]) >= 4)
    return _joined(names, of(P.SIGNER_TITLE, "title", 1))


def program_matches(text: Column, markers: Column) -> Column:
    def of(pattern: str, rank: int) -> Column:
        # The words are sought in the bytes, at a small part of a search's time; so is an end that begins with a word.
        held = contains_any(text, P.PROGRAM_WORDS[rank])
        if rank in P.PROGRAM_ENDS:
            held = text.rlike(P.PROGRAM_ENDS[rank]) & held

        def to_row(m: Column) -> Column:
            after = span(text, m["start"] + F.length(m["hit"]) - 1, F.lit(41))
            suffix = F.coalesce(strip(group1(after, P.PROGRAM_SUFFIX, 0)), F.lit("Program"))
            return _row("program", rank, m["start"], _page(markers, m["start"]), "Document Metadata",
                        "Program Name", "title", squash(m["v"]), suffix)
        found = F.when(held, matches(text, pattern, {"v": 1}, to_row))
        return F.filter(found, lambda r: (F.length(r["value"]) >= 5) & r["value"].rlike(r"^\p{Lu}"))

    return _joined(F.when(F.contains(text, F.lit("Program")), _joined(*[of(p, i) for i, p in enumerate(P.PROGRAMS)])))


def id_matches(text: Column, markers: Column) -> Column:
    def to_row(m: Column) -> Column:
        return _row("id", 0, m["start"], _page(markers, m["start"]), "Document Metadata", "Loan Number", "id", strip(m["v"]))
    return _joined(matches(text, P.REFERENCE_NUMBER, {"v": 1}, to_row))


FAMILIES = {
    "date": date_matches, "party": party_matches, "amount": amount_matches,
    "currency": currency_matches, "signer": signer_matches, "program": program_matches, "id": id_matches,
}


def with_families(docs: DataFrame, families: list[str]) -> DataFrame:
    """Texts with the matches of each family as a column; they share the page markers, amounts and currencies one search."""
    text, shared = F.col("text"), {"amount", "currency"}.issubset(families)
    sought = bound(docs, _markers=marker_array(text, P.LOOSE_PAGE_MARKER), **({"_amounts": _amounts(text)} if shared else {}))
    amounts = lambda f: [F.col("_amounts")] if shared and f in ("amount", "currency") else []
    return bound(sought, **{f: FAMILIES[f](text, F.col("_markers"), *amounts(f)) for f in families}).select(*docs.columns, *families)


def text_matches(docs: DataFrame, families: list[str] | None = None, merge: bool = True) -> DataFrame:
    """All matches of the chosen families in one pass, first occurrence per document and value.

    ``merge=False`` keeps repeats; nothing is shuffled then.
    """
    families = families or list(FAMILIES)
    rows = with_families(docs.select("doc_id", "text"), families).select("doc_id", F.inline_outer(F.concat(*families))).filter(F.col("source").isNotNull())
    full_value = F.concat_ws(" ", "value", "suffix").alias("value")
    if not merge:
        return rows.select("doc_id", *[c for c in MATCH_COLUMNS if c != "value"], full_value)
    key = (
        F.when(F.col("source").isin(REPEATED), F.concat_ws(":", "rank", "pos"))
        .when(F.col("source") == "program", F.lower("value"))
        .otherwise(F.col("value"))
    )
    rest = [c for c in MATCH_COLUMNS if c != "source"]
    first = F.min_by(F.struct(*rest, "suffix"), F.struct("rank", "pos")).alias("m")
    return rows.groupBy("doc_id", "source", key.alias("key")).agg(first).select(
        "doc_id", "source", *[F.col(f"m.{c}").alias(c) for c in rest if c != "value"],
        F.concat_ws(" ", "m.value", "m.suffix").alias("value"),
    )


def snippet_columns(rows: DataFrame) -> DataFrame:
    """Texts for search: each value read along its row and along its column.

    A date stands in the middle of its own snippet, under its name instead of the title.
    """
    dated = F.col("source") == "date"
    title, row, col, value = F.col("table_title"), F.col("row_label"), F.col("col_label"), F.col("value")
    first = F.when(dated, row).otherwise(title)
    label = F.when(dated, value).otherwise(row)
    tail = F.concat(F.lit("value: "), value)
    return rows.withColumns({
        "snippet_h": F.concat_ws(" | ", first, label, col, tail),
        "snippet_v": F.concat_ws(" | ", first, col, label, tail),
    })


def extract_dates(docs: DataFrame) -> DataFrame:
    return text_matches(docs, ["date"]).select("doc_id", "value", "rank", "pos", "page")


def extract_parties(docs: DataFrame) -> DataFrame:
    """Named parties, then the two names of the first ``between … and …``, each name once."""
    return text_matches(docs, ["party"]).select(
        "doc_id", F.col("value").alias("name"), F.col("row_label").alias("role"), "pos", "page"
    )


def extract_amounts(docs: DataFrame) -> DataFrame:
    return text_matches(docs, ["amount"]).select(
        "doc_id", F.col("col_label").alias("currency"), "value", "pos", "page"
    )


def principal_currency(docs: DataFrame) -> DataFrame:
    return text_matches(docs, ["currency"]).select("doc_id", F.col("value").alias("currency"), "pos", "page")


def extract_signatories(docs: DataFrame) -> DataFrame:
    return text_matches(docs, ["signer"]).select(
        "doc_id", F.col("col_label").alias("what"), F.col("row_label").alias("role"), "value", "pos", "page"
    )


def nearest_party(docs: DataFrame, positions: Column) -> DataFrame:
    """Party side for every offset in the array column ``positions``."""
    return docs.select("doc_id", "text", F.explode(positions).alias("position")).select(
        "doc_id", F.col("position").cast("int").alias("position"),
        nearest_side(F.col("text"), F.col("position")).alias("party"),
    )


def extract_programs(docs: DataFrame) -> DataFrame:
    return text_matches(docs, ["program"]).select("doc_id", "value", "rank", "pos", "page")


def extract_ids(docs: DataFrame) -> DataFrame:
    return text_matches(docs, ["id"]).select("doc_id", "value", "pos", "page")


# ------------------------------------------------------------------ definitions, covenants
def find_all(
    docs: DataFrame, pattern: str, groups: dict[str, int] | None = None, marker: str = P.LOOSE_PAGE_MARKER,
    default_page: int | None = None, by: str = "start", keep_text: bool = False, tail: str = "",
) -> DataFrame:
    """One row per match of any pattern: ``doc_id, pos, hit, *groups, page``.

    Documents without a match end after one failed search.
    """
    kept = ["doc_id", *(["text"] if keep_text else [])]
    found = docs.select(*kept, F.inline_outer(F.array(marked_matches("text", pattern, groups, marker, tail)))).select(
        *kept, "markers", F.explode_outer("found").alias("m")).filter(F.col("m").isNotNull())
    return found.select(
        *kept, F.col("m.start").alias("pos"), F.col("m.hit").alias("hit"),
        *[F.col(f"m.{name}").alias(name) for name in (groups or {})],
        page_at(F.col("markers"), F.col("m.start"), default_page, by).alias("page"),
    )


def definition_format(definition: Column) -> Column:
    low = F.lower(definition)
    return (
        F.when(definition.rlike(P.RATIO_VALUE), "ratio")
        .when(F.contains(low, F.lit("ratio of")) | F.contains(low, F.lit("divided by")), "ratio")
        .when(F.contains(low, F.lit("percentage")) | F.contains(definition, F.lit("%")), "percentage")
        .when(F.contains(low, F.lit("date")), "date")
        .otherwise("text")
    )


DEFINITION_COLUMNS = ["doc_id", "kind", "pos", "term", "definition", "expected_format", "page", "value_hint", "snippet"]


def extract_definitions(docs: DataFrame) -> DataFrame:
    found = find_all(
        docs, P.DEFINITION, {"term": 1, "body": 2}, marker=P.ANY_PAGE_LABEL, default_page=1, by="stop"
    )
    return (
        found.withColumn("term", strip("term"))
        .withColumn("definition", squash("body"))
        .withColumn("expected_format", definition_format(F.col("definition")))
        .withColumn("kind", F.lit("definition"))
        .withColumn("value_hint", F.lit(None).cast("string"))
        .withColumn("snippet", F.concat(
            F.lit("DEFINITION | "), "term", F.lit(" | "), clip("definition", 200), F.lit(" | format: "),
            "expected_format", F.lit(" | page: "), F.col("page").cast("string"),
        ))
        .select(*DEFINITION_COLUMNS)
    )


def covenant_period(context: Column) -> Column:
    """Period named in the text around a covenant; earlier entries win. Empty when none."""
    period = F.lit("")
    for pattern, name in reversed(P.PERIODS):
        period = F.when(context.rlike(pattern), name).otherwise(period)
    return period


def extract_covenants(docs: DataFrame) -> DataFrame:
    found = find_all(
        docs, P.COVENANT, {"name": 1, "bound": 2},
        marker=P.ANY_PAGE_LABEL, default_page=1, by="stop", keep_text=True, tail=".",
    )
    begin = F.greatest(F.col("pos") - P.COVENANT_LOOKBACK, F.lit(0))
    context = span(F.col("text"), begin, F.col("pos") + F.length("hit") - begin)
    rows = found.select(
        "doc_id", "pos", "page", strip("name").alias("name"), strip("bound").alias("threshold"),
        squash("hit").alias("definition"), covenant_period(context).alias("period"),
        strip(group1(strip("bound"), P.RATIO_VALUE, 0)).alias("value_hint"),
    )
    return (
        rows.withColumn("term", F.when(F.col("period") != "", F.concat("name", F.lit(" ("), "period", F.lit(")")))
                        .otherwise(F.col("name")))
        .withColumn("kind", F.lit("covenant"))
        .withColumn("expected_format", F.lit("ratio"))
        .withColumn("snippet", F.concat(
            F.lit("COVENANT | "), "term", F.lit(" | "), clip("definition", 200), F.lit(" | value: "),
            F.coalesce(F.col("value_hint"), clip("threshold", 50)),
            F.lit(" | format: ratio | page: "), F.col("page").cast("string"),
        ))
        .select(*DEFINITION_COLUMNS, "period", "threshold")
    )
