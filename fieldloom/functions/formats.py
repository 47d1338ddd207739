"""Which format a key asks for, and whether a value has it. Scalar column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.text import (
    as_col, blank_to_null, contains_any, group1, let, strip,
)


# ---------------------------------------------------------------------- format from the key
def _first_of(text: Column, cascade, flags: str, default: str = "text") -> Column:
    out = F.lit(default)
    for fmt, pats in reversed(cascade):
        pats = [pats] if isinstance(pats, str) else pats
        out = F.when(text.rlike(flags + "|".join(f"(?:{p})" for p in pats)), fmt).otherwise(out)
    return out


def detect_format(key_name: Column | str, key_desc: Column | str | None = None) -> Column:
    """percentage → ratio → date → amount → text, from name and description."""
    desc = F.lit("") if key_desc is None else F.coalesce(as_col(key_desc), F.lit(""))
    text = F.lower(F.concat(as_col(key_name), F.lit(" "), desc))
    return _first_of(text, P.KEY_FORMAT_CASCADE, "(?iU)")


def infer_format_terms(key_name: Column | str) -> Column:
    """Format by the financial terms a key name contains."""
    name = as_col(key_name)
    low = F.lower(name)
    percentage = contains_any(low, P.PERCENTAGE_TERMS)
    ratio = contains_any(low, P.RATIO_TERMS)
    return (
        F.when(contains_any(low, P.DATE_TERMS) & ~percentage & ~ratio, "date")
        .when(percentage, "percentage")
        .when(ratio, "ratio")
        .when(F.contains(name, F.lit("%")), "percentage")
        .when(name.rlike(r"(?iU)\d+\.\d+x\b"), "ratio")
        .when(F.contains(low, F.lit("covenant")), "ratio")
        .otherwise("text")
    )


def infer_format_name(key_name: Column | str) -> Column:
    """Format by whole words of the key name."""
    return _first_of(as_col(key_name), P.NAME_FORMAT_CASCADE, "(?iU)")


def merge_format(rule_format: Column, model_format: Column, key_name: Column) -> Column:
    """Fixed words first, then the rule, then the model."""
    return (
        F.when(key_name.rlike("(?iU)" + P.ALWAYS_PERCENTAGE), "percentage")
        .when(key_name.rlike("(?iU)" + P.ALWAYS_RATIO), "ratio")
        .when(rule_format != "text", rule_format)
        .otherwise(F.coalesce(blank_to_null(model_format), F.lit("text")))
    )


def effective_format(expected: Column, key_name: Column, key_desc: Column) -> Column:
    return F.coalesce(blank_to_null(expected), detect_format(key_name, key_desc))


def _lookup(c: Column, table: dict, default: Column) -> Column:
    pairs = [x for key, value in table.items() for x in (F.lit(key), F.lit(value))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), default)


def format_text(fmt: Column | str) -> Column:
    return _lookup(as_col(fmt), P.FORMAT_TEXTS, F.lit(P.UNKNOWN_FORMAT_TEXT))


def needs_terms(key_desc: Column | str) -> Column:
    return F.coalesce(contains_any(F.lower(as_col(key_desc)), P.OBLIGATION_TERMS), F.lit(False))


def party_hint(key_name: Column | str) -> Column:
    """Which extra instruction a key calls for; parts joined by ``+``, empty when none."""
    low = F.lower(as_col(key_name))
    has = lambda word: F.contains(low, F.lit(word))
    side = F.when(has("bank") & has("representative"), "bank_signer").when(
        has("borrower") & has("representative"), "borrower_signer"
    )
    currency = F.when(has("currency") & has("loan"), "loan_currency")
    return F.concat_ws("+", side, currency)


# ------------------------------------------------------------------------------- dates
def _two(c: Column) -> Column:
    return F.lpad(c.try_cast("int").cast("string"), 2, "0")


def _month(c: Column) -> Column:
    return _lookup(F.lower(c), P.MONTHS, F.lit(None).cast("string"))


def _dashed(*parts: Column) -> Column:
    """Joined by dashes; NULL as soon as one part is NULL."""
    return F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])


def _message(name: str, *values: Column) -> Column:
    """A fixed text with its gaps filled."""
    first, *rest = P.MESSAGES[name].split("{}")
    return F.concat(F.lit(first), *[part for v, text in zip(values, rest) for part in (v, F.lit(text))])


def normalize_date(value: Column | str, strict: bool = False) -> Column:
    """``YYYY-MM-DD`` where the value can be read as a date, else the value itself.

    In slash dates the first number lands in the month slot. ``strict`` also requires a date
    that exists.
    """
    v = as_col(value)
    month_first = _dashed(
        group1(v, P.MONTH_DAY_YEAR, 3), _month(group1(v, P.MONTH_DAY_YEAR, 1)),
        _two(group1(v, P.MONTH_DAY_YEAR, 2)),
    )
    slashed = _dashed(group1(v, P.SLASH_DATE, 3), _two(group1(v, P.SLASH_DATE, 1)), _two(group1(v, P.SLASH_DATE, 2)))
    year_first = _dashed(
        group1(v, P.YEAR_FIRST_DATE, 1), _two(group1(v, P.YEAR_FIRST_DATE, 2)), _two(group1(v, P.YEAR_FIRST_DATE, 3))
    )
    out = F.when(v.rlike(P.VALUE_RULES["date"][0]), v).otherwise(F.coalesce(month_first, slashed, year_first, v))
    if strict:
        out = F.when(F.try_to_timestamp(out, F.lit("yyyy-MM-dd")).isNotNull(), out).otherwise(v)
    return out


# --------------------------------------------------------------------------- value checks
NULL_LIKE = ["", "null", "None", "N/A"]


def _verdict(valid, normalized, issue) -> Column:
    return F.struct(
        F.lit(valid).alias("valid") if isinstance(valid, bool) else valid.alias("valid"),
        normalized.alias("normalized"),
        issue.alias("issue"),
    )


def _rule(fmt: Column, table: dict, part: int) -> Column:
    return _lookup(fmt, {name: rule[part] for name, rule in table.items()}, F.lit(table["text"][part]))


def _fits(value: Column, fmt: Column, table: dict) -> Column:
    out = value.rlike(table["text"][0])
    for name, (pattern, _) in table.items():
        out = F.when(fmt == name, value.rlike(pattern)).otherwise(out)
    return out


def format_example(fmt: Column) -> Column:
    return _rule(fmt, P.VALUE_RULES, 1)


def format_check(value: Column | str, fmt: Column | str, strict: bool = False, lenient: bool = False) -> Column:
    """``struct<valid, normalized, issue>`` for a value against its expected format.

    ``lenient`` also takes ``.75%`` and ``3.00x``. ``strict`` rejects dates that do not exist.
    """
    raw, fmt = as_col(value), as_col(fmt)
    none = F.lit("")

    def of_date(date: Column) -> Column:
        ok = date.rlike(P.VALUE_RULES["date"][0])
        if strict:
            ok = ok & F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNotNull()
        wrong = _message("date", date)
        return F.when(ok, _verdict(True, date, none)).otherwise(_verdict(False, date, wrong))

    def of_other(v: Column) -> Column:
        fits = _fits(v, fmt, P.VALUE_RULES)
        if lenient:
            fits = (
                fits | ((fmt == "percentage") & v.rlike(r"^\.\d+\s*%$"))
                | ((fmt == "ratio") & v.rlike(r"(?i)^\d+\.?\d*\s*x$"))
            )
        normal = F.when(fmt == "ratio", F.regexp_replace(v, P.RATIO_TAIL, " to 1.00")).otherwise(v)
        wrong = _message("mismatch", fmt, format_example(fmt), v)
        return F.when(fits, _verdict(True, normal, none)).otherwise(_verdict(False, v, wrong))

    def of_value(v: Column) -> Column:
        completed = F.when((fmt == "percentage") & v.rlike(P.BARE_NUMBER), F.concat(v, F.lit("%"))).otherwise(v)
        return (
            F.when(
                raw.isNull() | v.isin(NULL_LIKE),
                _verdict(False, F.lit(None).cast("string"), _message("empty")),
            )
            .when(fmt == "date", let(normalize_date(v, strict), of_date))
            .otherwise(let(completed, of_other))
        )

    return let(strip(raw), of_value)


def sanity_check(value: Column | str, fmt: Column | str, hint: Column | None = None) -> Column:
    """Scoring variant: ``struct<valid, normalized, score_adj, issue>``."""
    v, fmt = as_col(value), as_col(fmt)
    hint = F.lit(None).cast("string") if hint is None else hint
    table = P.SCORED_VALUE_RULES

    def out(valid: bool, normalized: Column, adj: float, issue: Column | str) -> Column:
        return F.struct(
            F.lit(valid).alias("valid"), normalized.alias("normalized"), F.lit(adj).alias("score_adj"),
            (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"),
        )

    # Long dates first; the outcome is then looked at once more for a slash date.
    def named(x: Column) -> Column:
        date = _dashed(
            group1(x, P.PLAIN_MONTH_DAY_YEAR, 3), _month(group1(x, P.PLAIN_MONTH_DAY_YEAR, 1)),
            _two(group1(x, P.PLAIN_MONTH_DAY_YEAR, 2)),
        )
        return F.coalesce(date, group1(x, P.PLAIN_MONTH_DAY_YEAR, 0), x)

    def slashed(x: Column) -> Column:
        date = _dashed(group1(x, P.SLASH_DATE, 3), _two(group1(x, P.SLASH_DATE, 1)), _two(group1(x, P.SLASH_DATE, 2)))
        return F.coalesce(date, x)

    def accepted(normal: Column) -> Column:
        decimal = r"(?U)\d+\.\d+"
        gap = F.abs(group1(hint, decimal, 0).try_cast("double") - group1(normal, decimal, 0).try_cast("double"))
        off = (fmt == "ratio") & F.coalesce(gap >= 0.01, F.lit(False))
        return F.when(off, out(True, normal, -0.1, _message("hint"))).otherwise(
            out(True, normal, 0.0, "")
        )

    def judged(x: Column) -> Column:
        bare = (fmt == "percentage") & x.rlike(P.BARE_NUMBER)
        normal = (
            F.when(fmt == "ratio", F.regexp_replace(x, P.RATIO_TAIL, " to 1.00"))
            .when(bare, F.concat(x, F.lit("%"))).when(fmt == "percentage", strip(x)).otherwise(x)
        )
        mismatch = _message("scored_mismatch", x, fmt, _rule(fmt, table, 1))
        return (
            F.when((fmt == "date") & ~x.rlike(table["date"][0]),
                   out(False, x, -0.3, _message("scored_date")))
            .when(~_fits(x, fmt, table) & ~bare, out(False, x, -0.5, mismatch))
            .otherwise(let(normal, accepted))
        )

    dated = let(let(v, named), slashed)
    return F.when(
        v.isNull() | v.isin("", "null", "N/A"), out(False, F.lit(None).cast("string"), -1.0, _message("null"))
    ).otherwise(let(F.when(fmt == "date", dated).otherwise(v), judged))


def rescue_code(key_name: Column, page_text: Column, anchored: bool = True) -> Column:
    """Currency code that the page text states, for currency keys only.

    ``anchored`` asks for a whole three-letter word after "expressed in".
    """
    def stated(text: Column, low: Column) -> Column:
        found = []
        for pattern, word in zip(P.CURRENCY_RESCUES, P.CURRENCY_RESCUE_WORDS):
            if anchored and pattern.startswith(r"(?iU)expressed"):
                pattern += r"\b"
            code = F.upper(group1(text, pattern))
            found.append(code if word is None else F.when(F.contains(low, F.lit(word)) | contains_any(text, P.ODD_LETTERS), code))
        return F.coalesce(*found)

    code = let(page_text, lambda text: let(F.lower(text), lambda low: stated(text, low)))
    return F.when(contains_any(F.lower(key_name), P.CURRENCY_KEY_WORDS), code)


def currency_rescue(key_name: Column, value: Column, page_text: Column, anchored: bool = True) -> Column:
    """Currency code from the page text, only for a missing value of a currency key."""
    return F.when(value.isNull(), rescue_code(key_name, page_text, anchored))


def confidence_score(confidence: Column | str) -> Column:
    """Words to numbers; missing counts as medium, unknown words as one half."""
    c = as_col(confidence)
    known = _lookup(F.lower(F.coalesce(c, F.lit("medium"))), P.CONFIDENCE_WORDS, F.lit(0.5))
    return F.coalesce(c.try_cast("double"), known)


# -------------------------------------------------------------------------------- display
def score_text(score: Column | str) -> Column:
    """Percent text; scores above one are percents already."""
    s = as_col(score)
    pct = F.floor(F.when(s > 1, s).otherwise(s * 100) + 0.5)
    return F.coalesce(F.concat(pct.cast("string"), F.lit("%")), F.lit("—"))


def size_text(n_bytes: Column | str) -> Column:
    n = as_col(n_bytes).cast("double")
    out = F.lit("0 B")
    for power, unit in enumerate(["B", "KB", "MB", "GB"]):
        scaled = F.format_string("%.2f", n / float(1024**power))
        out = F.when(n >= float(1024**power), F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNull() | (n == 0), "0 B").otherwise(out)


def seconds_text(seconds: Column | str) -> Column:
    s = as_col(seconds)
    return (
        F.when(s < 1, F.format_string("%.0fms", s * 1000))
        .when(s < 60, F.format_string("%.2fs", s))
        .otherwise(F.format_string("%.1fmin", s / 60))
    )


def date_text(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(as_col(ts), "dd/MM/yyyy HH:mm"), F.lit("—"))


def percent_of_score(score: Column | str) -> Column:
    s = F.coalesce(as_col(score), F.lit(0.0))
    return F.when(s > 1, s).otherwise(s * 100)


