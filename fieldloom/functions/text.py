"""String helpers on Spark columns: stripping, counting, match positions.

Everything here is built from native expressions, so it runs inside the scan stage of
whatever query uses it: no Python workers and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that Python's str.strip() and str.split() treat as blank.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = f"[{BLANKS}]+"
LINE_BREAK_CHAR = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LINE_BREAK = f"\r\n|{LINE_BREAK_CHAR}"
# A "word" character as Python's \w sees it; usable unchanged in Java and in RE2.
WORD = r"[\p{L}\p{N}_]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(BLANKS))


def squash(c: Column | str) -> Column:
    """Collapse every run of blanks into one space."""
    return F.regexp_replace(strip(c), BLANK_RUN, " ")


def count_char(c: Column | str, char: str) -> Column:
    c = as_col(c)
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def clip(c: Column | str, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(as_col(c), 1, n)


def span(c: Column, start: Column, length: Column) -> Column:
    """``length`` characters from the zero-based offset ``start``."""
    return F.substring(c, start + 1, length)


def blank_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c != "", c)


def contains_any(c: Column | str, terms) -> Column:
    """Does the text hold any of these literal terms?"""
    c = as_col(c)
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(c, F.lit(term))
    return hit


def rlike_any(c: Column | str, patterns) -> Column:
    """One scan with the alternation of all patterns."""
    return as_col(c).rlike("|".join(f"(?:{p})" for p in patterns))


def group1(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, NULL when there is no match."""
    c = as_col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often ``body`` uses it.

    Expressions used inside a lambda are otherwise evaluated anew for every element.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def bound(rows: DataFrame, **values: Column) -> DataFrame:
    """Rows with further columns, each computed once per row, however often and wherever it is read.

    A step of its own: the analyzer resolves lambdas inside lambdas one by one and gives up after so many.
    """
    made = F.explode_outer(F.array(F.struct(*[value.alias(name) for name, value in values.items()])))
    return rows.select("*", made.alias("_bound")).select(*rows.columns, "_bound.*")


# --------------------------------------------------------------------------- match offsets
_BLOCK = 64


def _exclusive_sums(xs: Column) -> Column:
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(
        xs,
        start,
        lambda acc, x: F.struct(
            (acc["total"] + x).alias("total"),
            F.concat(acc["sums"], F.array(acc["total"])).alias("sums"),
        ),
        lambda acc: acc["sums"],
    )


def running_offsets(xs: Column) -> Column:
    """For each element, the sum of all earlier ones.

    Works in blocks, so that a text with n matches costs about n*64 steps instead of n*n.
    """
    def in_blocks(values: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / _BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))

    def offsets(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(
            F.transform(blocks, lambda b: _exclusive_sums(b)),
            _exclusive_sums(totals),
            lambda block, base: F.transform(block, lambda x: x + base),
        ))

    return let(xs, lambda values: let(in_blocks(values), offsets))


def _group_reader(pattern: str, index: int, tail: str):
    def read(hit: Column) -> Column:
        return F.regexp_extract(F.concat(hit, F.lit(tail)) if tail else hit, pattern, index)

    return read


_FEW = 16  # matches of one text, up to which the gaps before each are summed anew


# Two noncharacters, which no pattern names and every character class treats alike.
_MARK, _OTHER = "\uffff", "\ufffe"


def _marked(text: Column, pattern: str, replacement: str) -> Column:
    """The text with its matches marked, in one walk of a matcher that is compiled once."""
    unmarked = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    return F.regexp_replace(unmarked, F.lit(pattern), F.lit(replacement))


def cut(text: Column | str, pattern: str, kept: str | None = None) -> Column:
    """What stands between the matches of a pattern that never matches nothing, as ``split`` cuts it.

    ``split`` compiles its pattern for every value; one that is replaced by a mark is compiled once. ``kept`` is a pattern
    of the same cuts whose first group stays.
    """
    text = as_col(text)
    marked = F.regexp_replace(text, pattern, _MARK) if kept is None else F.regexp_replace(text, kept, f"$1{_MARK}")
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(F.split(marked, _MARK, -1))


def _next_places(text: Column, hits: Column) -> Column:
    """Where each of the texts ``hits`` next stands, from the end of the one before."""
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(hits, none, lambda acc, h: F.struct(
        (F.position(h, text, acc["start"] + acc["size"] + 1) - 1).alias("start"), F.length(h).alias("size"),
        F.concat(acc["starts"], F.array(acc["start"])).alias("starts"),
    ), lambda acc: F.slice(F.concat(acc["starts"], F.array(acc["start"])), F.lit(2), F.size(hits)))


def match_spans(
    text: Column | str, pattern: Column | str, groups: dict[str, int] | None = None, tail: str = "", whole: bool | str = False
) -> Column:
    """All matches of ``pattern`` as ``array<struct<start, hit, *groups>>``.

    ``start`` counts characters from zero. A fixed pattern walks the text once: matches get a mark before and after,
    and the marks cut the text into gaps and matches. Of a pattern that is a column, the gaps come from ``split``, the
    matches from ``regexp_extract_all``; both walk the same matcher, so they interleave. Groups
    are read from the short matches, not from the text again; ``tail`` is what a trailing
    lookahead of the pattern has to see after the match.

    ``whole`` says that the pattern looks at nothing outside its match, so that it matches wherever the characters of one
    of its matches stand. Few such matches are found where their characters next stand, without a marked copy of the text.
    A text says so of matches that end with it; if one ends otherwise, the text is marked.
    """
    text = as_col(text)

    def fields(starts: Column, hits: Column) -> Column:
        named = {"start": starts, "hit": hits}
        for name, index in (groups or {}).items():
            named[name] = F.transform(hits, _group_reader(pattern, index, tail))
        return F.arrays_zip(*[col.alias(name) for name, col in named.items()])

    def with_starts(hits: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)), F.lit(1), F.size(hits))
        return fields(let(gaps, lambda g: F.zip_with(
            running_offsets(F.zip_with(g, hits, lambda x, h: x + F.length(h))), g, lambda o, x: o + x
        )), hits)

    def of_pieces(pieces: Column) -> Column:
        at = lambda xs: F.filter(xs, lambda x, i: i % 2 == 1)
        before = lambda sizes, i: F.aggregate(F.slice(sizes, F.lit(1), 2 * i + 1), F.lit(0), lambda a, x: a + x)
        to_last = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # what follows the last match places none
        starts = let(F.transform(to_last, lambda p: F.length(p)), lambda sizes: F.when(
            F.size(sizes) <= 2 * _FEW, F.transform(at(sizes), lambda _, i: before(sizes, i))).otherwise(at(running_offsets(sizes))))
        as_written = lambda found: F.when(F.contains(text, F.lit(_MARK)), F.zip_with(
            starts, found, lambda s, h: F.substring(text, s + 1, F.length(h)))).otherwise(found)
        return let(as_written(at(pieces)), lambda hits: fields(starts, hits))

    if not isinstance(pattern, str):
        return let(F.regexp_extract_all(text, pattern, F.lit(0)), with_starts)
    if whole:
        ended = lambda hits: F.forall(hits, lambda h: F.endswith(h, F.lit(whole))) if isinstance(whole, str) else F.lit(True)
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(
            (F.size(hits) <= _FEW) & ended(hits), fields(_next_places(text, hits), hits)).otherwise(match_spans(text, pattern, groups, tail)))
    lone = F.array(F.lit(""))  # without a match, the text is neither cut nor measured
    return let(_marked(text, pattern, f"{_MARK}$0{_MARK}"), lambda marked: let(
        F.when(~F.contains(marked, F.lit(_MARK)), lone).otherwise(F.split(marked, _MARK, -1)), of_pieces))


def last_match_start(text: Column, pattern: str) -> Column:
    """Offset of the last match, -1 when there is none."""
    def after_mark(t: Column, marked: Column) -> Column:
        rest = F.length(F.substring_index(marked, _MARK, -1))
        return F.when(F.contains(marked, F.lit(_MARK)), F.length(t) - rest).otherwise(F.lit(-1))

    return let(text, lambda t: let(_marked(t, pattern, f"{_MARK}$0"), lambda m: after_mark(t, m)))


def words(c: Column | str, min_len: int = 3) -> Column:
    """Distinct lower-case words of at least ``min_len`` characters, in order of appearance."""
    found = F.regexp_extract_all(F.lower(as_col(c)), F.lit(WORD + f"{{{min_len},}}"), F.lit(0))
    return F.array_distinct(found)
