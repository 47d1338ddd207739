"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Native expressions only; a document is a row, nothing is shuffled. Every pattern is written so that
Java's matcher walks it in linear time and without recursion, however long the text: repeated groups
became character classes over a text whose separators were rewritten one for one beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import let, match_spans
from fieldloom.llm import shared

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "card_short"]
CONTEXT_CHARS = 40
# Words that make a kind likelier when they stand shortly before a span, or less likely.
FOR = {
    "email": ["mail", "contact", "write to"], "ip": ["ip", "address", "host", "server"],
    "card": ["card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax"], "iban": ["iban", "account", "konto", "bank"],
    "card_short": ["card", "visa", "amex", "credit", "payment", "karte", "carte", "tarjeta"],
}
AGAINST = {"ip": ["version", "release", "section"], "phone": ["order", "serial", "isbn"]}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card_short": 0.3}
KEEP = 0.5  # added kinds need this score; the base kinds always stay


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    def weighed(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    chars = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Does an account number pass ISO 7064 mod 97-10?"""
    bare = F.replace(account, F.lit(" "), F.lit(""))
    chars = F.filter(F.split(F.concat(F.substring(bare, 5, 1000), F.substring(bare, 1, 4)), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return (F.length(bare) >= 15) & (F.aggregate(chars, F.lit(0), step) == 1)


def _small_part(part: Column) -> Column:
    return F.regexp_replace(part, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")


def _hits(text: Column, wanted: Column, seen: Column, pattern: str, valid) -> Column:
    """Spans start, end, hit of valid matches; the text is searched only where ``wanted`` holds."""
    spans = F.transform(
        match_spans(seen, pattern), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["hit"])).alias("end"), s["hit"].alias("hit"))
    )
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(wanted, F.filter(spans, lambda s: valid(s["hit"]))).otherwise(none)


def _emails(text: Column) -> Column:
    # A dot before a label character becomes \x01, so a domain is one run of a character class.
    dotted = F.regexp_replace(F.translate(text, "\x01", "\x02"), r"\.(?=[A-Za-z0-9-])", "\x01")
    local = r"[A-Za-z0-9._%+\x01-]"
    pattern = rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
    return _hits(text, F.contains(text, F.lit("@")), dotted, pattern, lambda h: F.lit(True))


def _ips(text: Column) -> Column:
    pattern = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    return _hits(text, text.rlike(pattern), text, pattern, lambda h: F.forall(F.split(h, r"\."), _small_part))


def _number_runs(text: Column, least: int, most: int) -> Column:
    # The first of two separators becomes \x00, so runs hold single separators only.
    single = F.regexp_replace(text, r"[\x20-](?=[\x20-])", "\x00")
    size = lambda h: F.length(digits(h))
    return _hits(text, text.rlike(rf"[0-9](?:[\x20-]?[0-9]){{{least - 1}}}"), single, r"[0-9][0-9\x20-]*[0-9]",
                 lambda h: size(h).between(least, most) & luhn(digits(h)))


def _phones(text: Column) -> Column:
    return _hits(text, F.contains(text, F.lit("+")), text, r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: F.length(digits(h)).between(8, 15))


def _ibans(text: Column) -> Column:
    # Two letters and two digits anywhere propose an account; none of these places overlaps another one.
    # What follows is only looked at, so that a proposal does not swallow the next one.
    pattern = r"[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))"
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def cut(span: Column, rest: Column) -> Column:
        """The longest run of leading words that passes."""
        parts = F.split(F.concat(span["hit"], rest), " ")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " "))
        hit = F.try_element_at(F.filter(heads, mod97), F.lit(-1))
        return F.struct(span["start"].alias("start"), (span["start"] + F.length(hit)).alias("end"), hit.alias("hit"))

    def apart(spans: Column) -> Column:
        """Of overlapping spans the leftmost."""
        def step(a: Column, s: Column) -> Column:
            free = s["start"] >= F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0))
            return F.when(free, F.concat(a, F.array(s))).otherwise(a)

        return F.when(F.size(spans) > 1, F.aggregate(spans, none, step)).otherwise(spans)

    found = F.zip_with(match_spans(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), cut)
    found = let(F.filter(found, lambda s: s["hit"].isNotNull()), apart)
    return F.when(text.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11}"), found).otherwise(none)


def _scored(kind: str, text: Column, spans: Column) -> Column:
    def near(start: Column, words: list[str]) -> Column:
        before = F.lower(F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))))
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(before, w))

    def one(s: Column) -> Column:
        score = F.lit(PRIOR[kind]) + F.when(near(s["start"], FOR[kind]), 0.3).otherwise(0.0)
        if kind in AGAINST:
            score = score - F.when(near(s["start"], AGAINST[kind]), 0.3).otherwise(0.0)
        score = F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), score.alias("score"))

    scored = F.transform(spans, one)
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= KEEP)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds ``into``: spans kind, start, end (code points, end exclusive), hit, score, by kind and start.

    * Null and empty texts have no spans; no other column is read, so nulls there do not matter.
    * Repeated rows each get their spans; ties do not arise, matches of a kind never overlap.
    * A column called like ``into`` is replaced. An empty table gives an empty result.
    """
    finders = {
        "email": _emails, "ip": _ips, "card": lambda t: _number_runs(t, 16, 19), "phone": _phones,
        "iban": _ibans, "card_short": lambda t: _number_runs(t, 13, 15),
    }
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(into, F.concat(*[_scored(k, t, finders[k](t)) for k in KINDS]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        tag = F.when(s["start"] >= a["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(a["out"], gap, tag).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    whole = F.aggregate(order, empty, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def _sql_hits(kind: str, pattern: str, valid: str) -> str:
    return f"""
      SELECT row_id, '{kind}' AS kind, t, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
        's': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0),
        'h': h[i]}})) AS m
      FROM (SELECT row_id, t, regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS g FROM docs)"""


_LUHN = """(list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 END)) % 10 = 0)"""


def _sql_context(kind: str) -> str:
    before = f"lower(substr(t, greatest(s - {CONTEXT_CHARS}, 0) + 1, least(s, {CONTEXT_CHARS})))"
    any_of = lambda words: "(" + " OR ".join(f"contains({before}, '{w}')" for w in words) + ")"
    return any_of(FOR[kind])


ORACLE = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(_sql_hits(k, p, '') for k, p in [
    ('email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
    ('ip', r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
    ('number', r'[0-9]([\x20-]?[0-9])+'),
    ('phone', r'\+[0-9][\x20().0-9-]+[0-9]'),
    ('iban', r'[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}'),
])}),
cut AS (SELECT row_id, kind, t, m.s::BIGINT AS s, CASE WHEN kind <> 'iban' THEN m.h ELSE list_filter(list_transform(
    range(1, len(string_split(m.h, ' ')) + 1), lambda k: array_to_string(string_split(m.h, ' ')[1:k], ' ')), lambda p:
    length(replace(p, ' ', '')) >= 15 AND list_reduce(list_prepend(0::BIGINT, list_transform(
      string_split(substr(replace(p, ' ', ''), 5) || substr(replace(p, ' ', ''), 1, 4), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: CASE WHEN c < 65 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1)[-1] END AS h FROM raw),
sized AS (SELECT *, regexp_replace(h, '[^0-9]', '', 'g') AS d FROM cut WHERE h IS NOT NULL),
good AS (
  SELECT row_id, kind, s, h FROM sized WHERE kind IN ('email', 'iban')
  UNION ALL SELECT row_id, kind, s, h FROM sized WHERE kind = 'ip'
    AND len(list_filter(string_split(h, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast(p AS BIGINT) > 255)) = 0
  UNION ALL SELECT row_id, 'card', s, h FROM sized WHERE kind = 'number' AND length(d) BETWEEN 16 AND 19 AND {_LUHN}
  UNION ALL SELECT row_id, 'card_short', s, h FROM sized WHERE kind = 'number' AND length(d) BETWEEN 13 AND 15 AND {_LUHN} AND {_sql_context('card_short')}
  UNION ALL SELECT row_id, kind, s, h FROM sized WHERE kind = 'phone' AND length(d) BETWEEN 8 AND 15),
named AS (SELECT *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'card_short'], kind) AS k,
    kind || ':' || s || ':' || (s + length(h)) AS x FROM good)
SELECT any_value(docs.doc_id) AS doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(x, ',' ORDER BY k, s) FILTER (k <= 4), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY k, s) FILTER (k IS NOT NULL), '') AS spans
FROM docs LEFT JOIN named USING (row_id) GROUP BY docs.row_id
"""
