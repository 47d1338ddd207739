"""Finding where a key's value may be: routing, context, keyword and vector search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions import formats
from fieldloom.functions import patterns as P
from fieldloom.functions.text import (
    WORD, as_col, blank_to_null, clip, contains_any, count_char, cut, let, match_spans, span, strip, words,
)
from fieldloom.operators.pages import marker_array, page_array, page_at, page_text

SCORE_DIGITS = 12


# ------------------------------------------------------------------------------- pairing
KEY_BYTES = 4 << 20  # of all keys together, up to which they are sent to the documents


def with_key_arrays(docs: DataFrame, keys: DataFrame, on: str | None = "subtype", limit: int = KEY_BYTES) -> DataFrame:
    """Documents (one row per doc_id) with the keys of their template, or with all keys without ``on``, as the array ``_keys``.

    Documents without keys leave. The keys are measured first. Up to ``limit`` bytes they are sent to the documents, one row of keys per template, so
    documents stay where they are however many have the same template. Larger key tables meet the documents' ids
    instead; the keys found for a document are collected (no more than its template has) and join it by doc_id.
    """
    # A constant would fold and turn the join into a Cartesian product.
    link, named = [*([on] if on else []), "_all"], [c for c in keys.columns if c != on]
    with_link = docs.withColumn("_all", F.pmod(F.xxhash64("doc_id"), F.lit(1)))
    keyed = keys.withColumn("_all", F.pmod(F.xxhash64(named[0]), F.lit(1)))
    size = keyed.agg(F.sum(F.octet_length(F.to_json(F.struct(*keyed.columns))))).first()[0] or 0
    one = F.struct(*named).alias("k")
    if size <= limit:
        met = with_link.join(F.broadcast(keyed.groupBy(*link).agg(F.collect_list(one).alias("_keys"))), link)
    else:
        ids = with_link.select("doc_id", *link).join(keyed.select(*link, one), link)
        met = with_link.join(ids.groupBy("doc_id").agg(F.collect_list("k").alias("_keys")), "doc_id")
    return met.select(*docs.columns, "_keys")


def with_template_keys(docs: DataFrame, keys: DataFrame, on: str | None = "subtype", limit: int = KEY_BYTES) -> DataFrame:
    """The documents of `with_key_arrays`, one row per document and key."""
    met = with_key_arrays(docs, keys, on, limit)
    return met.select(*docs.columns, F.explode("_keys").alias("k")).select(*docs.columns, "k.*")


# ------------------------------------------------------------------------------- routing
def section_words(sections: Column) -> Column:
    return F.transform(
        sections,
        lambda s: words(F.concat(s["topic"], F.lit(" "), F.array_join(s["keywords"], " "))),
    )


def routed(sections: Column, tokens: Column, key_words: Column, all_pages: Column, fallback: int | None = None) -> Column:
    """Section sharing most words with the key; the first one on ties; else all pages, or the first ``fallback``."""
    def out(idx, topic, pages, kind, score) -> Column:
        return F.struct(
            idx.alias("section_idx"), topic.alias("topic"), pages.alias("pages"),
            kind.alias("type"), score.alias("overlap"),
        )

    def choose(scores: Column) -> Column:
        best = F.coalesce(F.array_max(scores), F.lit(0))
        at = F.array_position(scores, best).cast("int") - 1
        hit = F.get(sections, at)
        nowhere = out(F.lit(None).cast("int"), F.lit("Full Document"), all_pages if fallback is None else F.slice(all_pages, 1, fallback),
                      F.lit("paragraph"), F.lit(0))
        return F.when(best > 0, out(at, hit["topic"], hit["pages"], hit["type"], best)).otherwise(nowhere)

    return let(F.transform(tokens, lambda t: F.size(F.array_intersect(t, key_words))), choose)


def route_keys(docs: DataFrame, keys: DataFrame, on: str = "subtype") -> DataFrame:
    """Document × key of its template → section.

    ``docs``: doc_id, ``on``, sections, page_numbers. Words are cut once per document, before
    the keys come in; only the document's own arrays are compared, so nothing but the final
    (document, key) rows is produced.
    """
    prepared = docs.withColumn("tokens", section_words(F.col("sections")))
    key_words = words(F.concat(F.col("key_name"), F.lit(" "), F.coalesce("key_desc", F.lit(""))))
    paired = with_template_keys(prepared, keys.withColumn("key_words", key_words), on)
    route = routed(F.col("sections"), F.col("tokens"), F.col("key_words"), F.col("page_numbers"))
    return paired.select("doc_id", "key_id", route.alias("r")).select("doc_id", "key_id", "r.*")


# ------------------------------------------------------------------ context around a table
def _paragraph_pages(pages: Column, table_pages: Column) -> Column:
    return F.filter(
        pages,
        lambda p: ~F.array_contains(table_pages, p["page"])
        & (count_char(p["text"], "│") < 3)
        & (count_char(p["text"], "|") < 6),
    )


def term_context(pages: Column, table_pages: Column, terms: Column, k: int = 3) -> Column:
    """Top pages by number of terms contained: ``array<struct<score, page, text>>``."""
    def scored(p: Column, low_terms: Column) -> Column:
        n = let(F.lower(p["text"]), lambda low: F.size(F.filter(low_terms, lambda t: F.contains(low, t))))
        return F.struct((-n).alias("neg"), p["page"].alias("page"), p["text"].alias("text"))

    def ranked(low_terms: Column) -> Column:
        rows = F.transform(_paragraph_pages(pages, table_pages), lambda p: scored(p, low_terms))
        return F.slice(F.array_sort(F.filter(rows, lambda s: s["neg"] < 0)), 1, k)

    return F.transform(
        let(F.transform(terms, lambda t: F.lower(t)), ranked),
        lambda s: F.struct((-s["neg"]).alias("score"), s["page"].alias("page"), s["text"].alias("text")),
    )


def near_context(pages: Column, table_pages: Column, reach: int = 1) -> Column:
    """Neighbouring paragraph pages in table-page order; a page may come twice."""
    neighbours = F.flatten(F.transform(
        table_pages, lambda p: F.sequence(F.greatest(F.lit(1), p - reach), p + reach)
    ))

    def found(by_page: Column) -> Column:
        return F.transform(
            neighbours, lambda n: F.struct(n.alias("page"), F.try_element_at(by_page, n).alias("text"))
        )

    by_page = let(_paragraph_pages(pages, table_pages), lambda ps: F.map_from_arrays(ps["page"], ps["text"]))
    return F.filter(let(by_page, found), lambda n: n["text"].isNotNull())


def context_by_terms(docs: DataFrame, k: int = 3) -> DataFrame:
    """``docs``: doc_id, pages, table_pages, terms. One row per context page."""
    ctx = term_context(F.col("pages"), F.col("table_pages"), F.col("terms"), k)
    return docs.select("doc_id", F.posexplode_outer(ctx).alias("rank", "c")).filter(F.col("c").isNotNull()).select(
        "doc_id", (F.col("rank") + 1).alias("rank"), F.col("c.page").alias("page"),
        F.col("c.score").alias("score"),
    )


def context_by_proximity(docs: DataFrame, reach: int = 1) -> DataFrame:
    """Neighbour pages for documents where no page holds a term."""
    without = docs.filter(F.size(term_context(F.col("pages"), F.col("table_pages"), F.col("terms"), 1)) == 0)
    return without.select(
        "doc_id", F.posexplode(near_context(F.col("pages"), F.col("table_pages"), reach)).alias("pos", "n")
    ).select("doc_id", "pos", F.col("n.page").alias("page"))


def surrounding_text(pages: Column, table_pages: Column, terms: Column, reach: int = 1) -> Column:
    """The context as one text: by terms, else by proximity."""
    by_terms = F.transform(
        term_context(pages, table_pages, terms),
        lambda c: F.concat(
            F.lit("[Page "), c["page"].cast("string"), F.lit(" — relevance:"), c["score"].cast("string"),
            F.lit("]\n"), c["text"],
        ),
    )
    near = F.transform(
        near_context(pages, table_pages, reach),
        lambda n: F.concat(F.lit("[Page "), n["page"].cast("string"), F.lit("]\n"), n["text"]),
    )
    return F.array_join(let(by_terms, lambda c: F.when(F.size(c) > 0, c).otherwise(near)), "\n\n")


# -------------------------------------------------------------------------------- vectors
def _matrix(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """(query, column) pairs of each query's top k, ties by ascending id."""
    if scores.shape[1] > k:
        cut = np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(-scores <= cut)
    else:
        rows, cols = np.indices(scores.shape).reshape(2, -1)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - start[rows] < k
    return rows[keep], cols[keep]


def _nearest(k: int):
    """Top k vectors of one part for one block of queries."""
    def top(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        sizes = {len(v) for v in (*queries["embedding"], *vectors["embedding"])}
        if len(sizes) > 1:
            raise ValueError(f"embeddings of different lengths: {sorted(sizes)[:5]}")
        scores = np.round(_matrix(queries["embedding"]) @ _matrix(vectors["embedding"]).T, SCORE_DIGITS)
        rows, cols = _best(scores, vectors["vec_id"].to_numpy(), k)
        return pd.DataFrame({
            "query_id": queries["query_id"].to_numpy()[rows], "vec_id": vectors["vec_id"].to_numpy()[cols], "score": scores[rows, cols],
        })

    return top


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 3, block: int = 4096, part: int = 32_768) -> DataFrame:
    """Exact top k by cosine: ``query_id, rank, vec_id, score``.

    ``vectors``: vec_id, embedding. ``queries``: query_id, embedding; rows without an embedding are
    left out, embeddings of different lengths are an error. Queries are cut into blocks and vectors
    into parts, by hash and of about so many rows; each block meets each part in one task, which
    keeps k rows per query. Both are read once whatever their number; none passes through the driver.
    """
    vectors = vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull())
    queries = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(1, -(-queries.count() // block)), max(cores, -(-vectors.count() // part))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    v = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    found = q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def vector_topk_cells(
    vectors: DataFrame, queries: DataFrame, cell: list[str], k: int = 5
) -> DataFrame:
    """Top 2k vectors per query, first per cell, at most k.

    ``vectors`` also carries the ``cell`` identity columns. The dedup runs on 2k rows per query.
    """
    near = vector_topk(vectors, queries, 2 * k)
    named = near.join(vectors.select("vec_id", *cell), "vec_id")
    per_cell = W.partitionBy("query_id", *cell).orderBy("rank")
    firsts = named.withColumn("nth", F.row_number().over(per_cell)).filter(F.col("nth") == 1)
    again = W.partitionBy("query_id").orderBy("rank")
    return (
        firsts.withColumn("rank", F.row_number().over(again))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", *cell)
    )


def router_decision(
    keys: DataFrame, cells: DataFrame, definitions: DataFrame,
    high: float = 0.82, definition_floor: float = 0.40,
) -> DataFrame:
    """What the vector search means for each key.

    ``keys``: query_id, key_name. ``cells``: ranked cells with ``value`` (and ``page`` if known).
    ``definitions``: ranked definitions with expected_format, value_hint, definition.
    """
    page = F.col("page") if "page" in cells.columns else F.lit(None).cast("int")
    top = cells.filter("rank = 1").select(
        "query_id", F.col("score").alias("cell_score"), F.col("value").alias("cell_value"), page.alias("page_hint")
    )
    best_def = definitions.filter("rank = 1").select(
        "query_id", F.col("score").alias("def_score"), F.col("expected_format").alias("def_format"),
        F.col("value_hint").alias("def_hint"), F.col("definition").alias("def_text"),
    )
    confidence = F.coalesce("cell_score", F.lit(0.0))
    adopted = F.coalesce(F.col("def_score") > definition_floor, F.lit(False))
    named = formats.infer_format_name("key_name")
    richer = adopted & (F.coalesce(blank_to_null("def_format"), F.lit("text")) != "text") & (named == "text")
    return (
        keys.join(top, "query_id", "left")
        .join(best_def, "query_id", "left")
        .select(
            "query_id", "key_name",
            confidence.alias("confidence"),
            (confidence < high).alias("needs_llm"),
            F.when(confidence >= high, F.col("cell_value")).alias("best_value"),
            "page_hint",
            F.when(richer, F.col("def_format")).otherwise(named).alias("expected_format"),
            F.when(adopted, F.col("def_hint")).alias("value_hint"),
            F.when(adopted, F.col("def_text")).alias("definition_text"),
        )
    )


def alias_queries(first: DataFrame, aliases: DataFrame, floor: float = 0.35) -> DataFrame:
    """The alias queries worth a search: those of keys whose first result scores below ``floor``, or is missing."""
    strong = first.groupBy("query_id").agg(F.max("score").alias("best")).filter(F.col("best") >= floor)
    return aliases.join(strong, "query_id", "left_anti")


def alias_research(first: DataFrame, second: DataFrame, floor: float = 0.35) -> DataFrame:
    """Alias results replace a weak first result, but only when they score higher.

    Both are ranked results per query. Their best scores are compared per query; the two sides
    are aggregated apart, so no aggregate reads through a union of shuffled inputs.
    """
    own = first.groupBy("query_id").agg(F.max("score").alias("own"))
    alias = second.groupBy("query_id").agg(F.max("score").alias("alias"))
    base = F.coalesce("own", F.lit(0.0))
    take_alias = (base < floor) & F.coalesce(F.col("alias") > base, F.lit(False))
    choice = own.join(alias, "query_id", "full").select("query_id", take_alias.alias("use_alias"))
    kept = first.join(choice.filter("not use_alias"), "query_id")
    return kept.unionByName(second.join(choice.filter("use_alias"), "query_id"))


# -------------------------------------------------------------------------------- keywords
def keyword_pattern(key: Column) -> Column:
    """Case-insensitive whole-word pattern for a literal key."""
    literal = F.regexp_replace(key, r"([^\p{L}\p{N}_])", r"\\$1")
    left = F.when(key.rlike("^" + WORD), F.lit(f"(?<!{WORD})")).otherwise(F.lit(f"(?<={WORD})"))
    right = F.when(key.rlike(WORD + "$"), F.lit(f"(?!{WORD})")).otherwise(F.lit(f"(?={WORD})"))
    first = F.regexp_extract(literal, r"(?s)^\\?.", 0)  # sought before anything is looked at around it
    return F.concat(F.lit("(?iu)"), F.when(key != "", F.concat(F.lit("(?="), first, F.lit(")"))).otherwise(""), left, literal, right)


def keyword_search(
    docs: DataFrame, keys: DataFrame, on: str | None = None, context: int = 100, marker: str = P.PAGE_MARKER, limit: int = KEY_BYTES
) -> DataFrame:
    """All whole-word hits of each key in each document.

    A hit needs the key's first word as a word of the document. Keys of up to ``limit`` bytes come to the documents: their
    words are cut once, and only keys whose first word is among them are looked for, in place. Of a larger key
    table the first words fill a bit filter of fixed size, which a document's words pass before they leave its row; what
    passes joins the keys by word, and the documents concerned join their keys once.
    Keys without a word character are candidates everywhere.
    """
    keys = keys.select("key_id", "key_name", *([on] if on else []), F.get(words("key_name", 1), F.lit(0)).alias("word"))
    link = [on] if on else []
    docs = docs.select("doc_id", *link, "text")
    size = keys.agg(F.sum(F.octet_length(F.to_json(F.struct(*keys.columns))))).first()[0] or 0
    if size <= limit:
        keyed = keys.withColumn("_all", F.pmod(F.xxhash64("key_id"), F.lit(1)))  # a constant would fold
        known = keyed.groupBy(*link, "_all").agg(F.collect_list(F.struct("key_id", "key_name", "word")).alias("keys"))
        met = docs.withColumn("_all", F.pmod(F.xxhash64("doc_id"), F.lit(1))).join(F.broadcast(known), [*link, "_all"])
        own = F.transform("keys", lambda k: k["word"])
        hit = let(F.array_intersect(F.array_distinct(words("text", 1)), own), lambda ws: F.filter(
            F.col("keys"), lambda k: k["word"].isNull() | F.array_contains(ws, k["word"])))
        asked = met.select("doc_id", "text", hit.alias("keys"))
    else:
        passes = first_word_filter(keys)
        candidates = F.filter(F.array_distinct(words("text", 1)), passes)
        met = docs.select("doc_id", *link, F.explode(candidates).alias("word")).join(keys.filter("word IS NOT NULL"), ["word", *link])
        every = with_template_keys(docs.select("doc_id", *link), keys.filter("word IS NULL"), on, limit)
        found = met.select("doc_id", "key_id", "key_name").unionByName(every.select("doc_id", "key_id", "key_name"))
        asked = docs.select("doc_id", "text").join(
            found.groupBy("doc_id").agg(F.collect_list(F.struct("key_id", "key_name")).alias("keys")), "doc_id")  # bounded by the keys
    found = (
        asked.select("doc_id", "text", F.explode_outer("keys").alias("k")).filter(F.col("k").isNotNull())
        .select("doc_id", "k.key_id", "k.key_name", "text", match_spans("text", keyword_pattern(F.col("k.key_name"))).alias("hits"))
        .withColumn("markers", F.when(F.size("hits") > 0, marker_array("text", marker)))
        .select("doc_id", "key_id", "key_name", "text", "markers", F.posexplode_outer("hits").alias("match_idx", "m"))
        .filter(F.col("m").isNotNull())
    )
    begin = F.greatest(F.col("m.start") - context, F.lit(0))
    length = F.col("m.start") + F.length("m.hit") + context - begin
    return found.select(
        "doc_id", "key_id", "key_name", "match_idx",
        page_at(F.col("markers"), F.col("m.start"), 1).alias("page"),
        F.col("m.hit").alias("text"),
        strip(F.replace(span(F.col("text"), begin, length), F.lit("\n"), F.lit(" "))).alias("context"),
        F.col("m.start").alias("position"),
    )


WORD_BITS = 1 << 20  # of the filter over first words, whatever the number of keys


def first_word_filter(keys: DataFrame):
    """Predicate on words: may a key begin with it? The filter is a literal of WORD_BITS bits."""
    bit = keys.filter("word IS NOT NULL").select(F.pmod(F.xxhash64("word"), F.lit(WORD_BITS)).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    set_bits = dict(map(tuple, bit.groupBy(F.floor(F.col("bit") / 64)).agg(F.bit_or(one)).collect()))  # at most WORD_BITS / 64 rows
    filled = F.split(F.lit(",".join(str(set_bits.get(k, 0)) for k in range(WORD_BITS // 64))), ",").cast("array<bigint>")  # folded to one literal

    def passes(word: Column) -> Column:
        at = F.pmod(F.xxhash64(word), F.lit(WORD_BITS))
        return F.call_function("shiftright", F.get(filled, F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return passes


# ------------------------------------------------------------------- definition candidates
def is_signal(text: Column) -> Column:
    """Does a sentence say what something is? Most are settled by the literals that every signal holds."""
    def quick(low: Column) -> Column:
        return contains_any(low, P.SIGNAL_PHRASES) | (contains_any(low, P.SIGNAL_WORDS) & low.rlike(P.SIGNAL_WORD))

    return F.when(contains_any(text, P.ODD_LETTERS), text.rlike(P.DEFINITION_SIGNAL)).otherwise(let(F.lower(text), quick))


def _sentences(pages: Column, definition_pages: Column, min_chars: int, max_chars: int | None) -> Column:
    """Sentences with page and priority; definition pages first, then the rest in text order."""
    def of_page(p: Column, priority: int) -> Column:
        parts = F.transform(cut(p["text"], P.SENTENCE_BREAK, P.SENTENCE_END), strip)
        kept = F.filter(parts, lambda s: (F.length(s) >= min_chars) & (F.lit(True) if max_chars is None else F.length(s) <= max_chars))
        return F.transform(kept, lambda s: F.struct(
            p["page"].alias("page"),
            (F.lit(priority) + F.when(is_signal(s), 2).otherwise(0)).alias("base"),
            s.alias("snippet"),
        ))

    listed = F.transform(
        definition_pages, lambda n: F.get(F.filter(pages, lambda p: p["page"] == n), F.lit(0))
    )
    first = F.transform(F.filter(listed, lambda p: p.isNotNull()), lambda p: of_page(p, 3))
    rest = F.transform(
        F.filter(pages, lambda p: ~F.array_contains(definition_pages, p["page"])), lambda p: of_page(p, 1)
    )
    return F.flatten(F.concat(first, rest))


def mentions(text: Column, key_words: Column) -> Column:
    """Does the text hold any of the key's words? True if the key has none."""
    hit = let(F.lower(text), lambda low: F.exists(key_words, lambda w: F.contains(low, w)))
    return (F.size(key_words) == 0) | hit


def is_heading(text: Column) -> Column:
    """No statement: a grid, or a line without an end mark that is all upper case or has under 20 characters."""
    return F.contains(text, F.lit(P.CELL_BORDER)) | (((F.length(text) < 20) | (F.upper(text) == text)) & ~text.rlike(r"[.!?:;]\s*$"))


def with_tests(sentences: Column) -> Column:
    """Sentences with what `best_sentence` asks of each: its lower case, and whether it is a heading."""
    return F.transform(sentences, lambda s: F.struct(
        s["page"].alias("page"), s["base"].alias("base"), s["snippet"].alias("snippet"),
        F.lower(s["snippet"]).alias("low"), is_heading(s["snippet"]).alias("late"),
    ))


def best_sentence(tested: Column, key_words: Column, low_key: Column) -> Column:
    """The first of `best_snippets` with headings last, of sentences `with_tests`; NULL if none mentions the key.

    ``key_words``: the words of the key, ``low_key``: the key in lower case; both are made once per key.
    """
    hits = F.filter(tested, lambda s: (F.size(key_words) == 0) | F.exists(key_words, lambda w: F.contains(s["low"], w)))
    best = F.array_min(F.transform(hits, lambda s, i: F.struct(
        s["late"].alias("late"), (-(s["base"] + F.when(F.contains(s["low"], low_key), 1).otherwise(0))).alias("neg"),
        i.alias("ord"), s["page"].alias("page"), s["snippet"].alias("snippet"),
    )))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct((-b["neg"]).alias("score"), b["page"].alias("page"), b["snippet"].alias("snippet"))))


def best_snippets(sentences: Column, key: Column, k: int = 8, prefix: int | None = None, headings_last: bool = False) -> Column:
    """Top k different sentences for a key; with ``prefix``, those that share so many first characters are one.

    ``headings_last``: a heading or grid that names the key comes after every sentence that mentions it.
    """
    hits = let(words(key, 3), lambda ws: F.filter(sentences, lambda s: mentions(s["snippet"], ws)))
    scored = let(F.lower(key), lambda low_key: F.transform(hits, lambda s, i: F.struct(
        (is_heading(s["snippet"]) if headings_last else F.lit(False)).alias("late"),
        (-(s["base"] + F.when(F.contains(F.lower(s["snippet"]), low_key), 1).otherwise(0))).alias("neg"),
        i.alias("ord"), s["page"].alias("page"), s["snippet"].alias("snippet"),
    )))
    kept_type = "array<struct<late:boolean,neg:int,ord:int,page:int,snippet:string>>"
    start = F.struct(
        F.array().cast("array<string>").alias("seen"), F.array().cast(kept_type).alias("kept")
    )

    def step(acc: Column, s: Column) -> Column:
        head = s["snippet"] if prefix is None else clip(s["snippet"], prefix)
        fresh = (F.size(acc["kept"]) < k) & ~F.array_contains(acc["seen"], head)
        return F.when(fresh, F.struct(
            F.concat(acc["seen"], F.array(head)).alias("seen"),
            F.concat(acc["kept"], F.array(s)).cast(kept_type).alias("kept"),
        )).otherwise(acc)

    return F.transform(
        F.aggregate(F.array_sort(scored), start, step, lambda acc: acc["kept"]),
        lambda s: F.struct((-s["neg"]).alias("score"), s["page"].alias("page"), s["snippet"].alias("snippet")),
    )


def with_sentences(docs: DataFrame, min_chars: int = 1, max_chars: int | None = None) -> DataFrame:
    return docs.withColumn(
        "sentences", _sentences(F.col("pages"), F.col("definition_pages"), min_chars, max_chars)
    )


def definition_candidates(docs: DataFrame, keys: DataFrame, on: str = "subtype", k: int = 8) -> DataFrame:
    """``docs``: doc_id, ``on``, pages, definition_pages. Sentences are cut once per document."""
    cut = with_sentences(docs).select("doc_id", on, "sentences")
    paired = with_template_keys(cut, keys.select("key_id", "key_name", on), on)
    return paired.select(
        "doc_id", "key_id",
        F.posexplode_outer(best_snippets(F.col("sentences"), F.col("key_name"), k)).alias("pos", "c"),
    ).filter(F.col("c").isNotNull()).select("doc_id", "key_id", (F.col("pos") + 1).alias("rank"), "c.score", "c.page", "c.snippet")


# -------------------------------------------------------------------------- wider contexts
def broader_pages(all_pages: Column, used: Column, n: int | None = None) -> Column:
    rest = F.filter(all_pages, lambda p: ~F.array_contains(used, p))
    return rest if n is None else F.slice(rest, 1, n)


def broader_search(docs: DataFrame, n: int | None = None) -> DataFrame:
    """``docs``: doc_id, pages, used_pages → the next pages to try and their text."""
    wanted = broader_pages(F.col("pages")["page"], F.col("used_pages"), n)
    return docs.select("doc_id", "pages", wanted.alias("next_pages")).select(
        "doc_id", "next_pages", page_text(F.col("pages"), F.col("next_pages")).alias("page_text")
    )


def validation_text(
    section_text: Column, page_text_: Column, full_text: Column, head: int | None = None, window: int | None = None
) -> Column:
    """Section text plus the document; on demand only its head, all cut to a model's window."""
    section = F.coalesce(blank_to_null(section_text), page_text_)
    whole = F.concat(section, F.lit("\n\n"), full_text if head is None else clip(full_text, head))
    return whole if window is None else clip(whole, window)


def validator_context(docs: DataFrame, wanted: Column, marker: str = P.PAGE_MARKER) -> DataFrame:
    section = page_text(page_array("text", marker), wanted)
    return docs.select("doc_id", validation_text(section, F.lit(""), F.col("text")).alias("context"))


def snippet_at_page(text: Column | str, page: Column, chars: int | None = None) -> Column:
    """Text from the label of a page on, else the document; on demand so many characters of it."""
    text = as_col(text)
    at = F.regexp_instr(text, F.concat(F.lit(r"(?iU)PAGE\s+"), page.cast("string"), F.lit(r"\b")))
    found = F.coalesce(at, F.lit(0)) > 0
    rest = F.when(found, F.substring(text, at, F.length(text))).otherwise(text)
    return rest if chars is None else clip(rest, chars)


def page_snippet(docs: DataFrame, page: Column, chars: int | None = None) -> DataFrame:
    return docs.select("doc_id", snippet_at_page("text", page, chars).alias("snippet"))


# ------------------------------------------------------------------------------ embedding
HOT_WORDS = 4096  # words of at least this part of all entries are at most so many; they are sent, the others joined


def embed_snippets(snippets: DataFrame, text: str = "snippet", model=None, key: str = "doc_id") -> DataFrame:
    """Vectors of snippets.

    ``model`` maps a list of texts to a list of vectors and runs batch-wise on the executors; it adds ``embedding``.
    Without one, TF-IDF of unit length as sparse vectors: ``key`` (which names the snippet), ``indices`` (ascending,
    32 bits of a word's hash) and ``weights``. Texts do not move; a row per word and snippet does, and of a word that nearly
    all snippets hold the weight comes to the rows. Snippets without words have empty vectors.
    """
    if model is not None:
        @F.pandas_udf("array<float>")
        def encode(batch: pd.Series) -> pd.Series:
            return pd.Series([np.asarray(v, dtype=np.float32) for v in model(batch.tolist())])

        return snippets.withColumn("embedding", encode(F.col(text)))

    counts = _term_counts(snippets, text, key)
    total = snippets.count()
    spread = counts.groupBy("index").agg(F.count(F.lit(1)).alias("df"))
    entries = spread.agg(F.sum("df")).first()[0] or 0
    hot = F.col("df") * HOT_WORDS >= entries
    sent, rest = spread.filter(hot), spread.filter(~hot)
    known = counts.join(F.broadcast(sent), "index").unionByName(
        counts.join(F.broadcast(sent.select("index")), "index", "left_anti").join(rest, "index"))
    # Counts travel, weights are made where they arrive: small whole numbers pack better than their logarithms.
    rows = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("index", "tf", "df"))).alias("v"))  # bounded by a snippet's words
    idf = lambda x: F.log((F.lit(total) + 1) / (x["df"] + 1))
    norm = lambda ws: F.sqrt(F.aggregate(ws, F.lit(0.0), lambda a, w: a + w * w))
    units = let(F.transform("v", lambda x: x["tf"] * idf(x)), lambda ws: let(
        norm(ws), lambda n: F.transform(ws, lambda w: F.when(n > 0, w / n).otherwise(0.0))))
    vectors = rows.select(key, F.col("v.index").alias("indices"), units.alias("weights"))
    return snippets.select(key).join(vectors, key, "left").select(
        key, F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"), F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))


SENT_KEYS = 1 << 20  # keys of several rows that are sent; if there are more, the words of all rows are shuffled


def _term_counts(snippets: DataFrame, text: str, key: str, limit: int = SENT_KEYS) -> DataFrame:
    """``key``, index (32 bits of a word's hash), tf: counted within the row, but for keys that several rows have."""
    every = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"{WORD}+"), F.lit(0))
    index = lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint")

    def runs(sorted_: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(sorted_) - 1, F.lit(0))), first)
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(sorted_, i).alias("index"), (F.coalesce(F.get(at, k + 1), F.size(sorted_)) - i).cast("bigint").alias("tf"))))

    def in_rows(rows: DataFrame) -> DataFrame:
        counted = let(F.sort_array(F.transform(every, index)), runs)
        return rows.select(key, F.inline_outer(counted)).filter(F.col("index").isNotNull())

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.explode(every).alias("word")).groupBy(key, index(F.col("word")).alias("index")).agg(F.count(F.lit(1)).alias("tf"))

    rows = snippets.select(key, text)
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(key).alias("_again"), F.lit(True).alias("_more"))
    several = repeated.count()
    if not several:
        return in_rows(rows)
    if several > limit:
        return grouped(rows)
    marked = rows.join(F.broadcast(repeated), F.col(key).eqNullSafe(F.col("_again")), "left")
    return in_rows(marked.filter(F.col("_more").isNull())).unionByName(grouped(marked.filter("_more")))


def sparse_dot(a_indices: Column, a_weights: Column, b_indices: Column, b_weights: Column) -> Column:
    """Dot product of two sparse vectors: the cosine of `embed_snippets` rows."""
    def product(common: Column) -> Column:
        at = lambda ids, ws, i: F.get(ws, (F.array_position(ids, i) - 1).cast("int"))
        return F.aggregate(common, F.lit(0.0), lambda acc, i: acc + at(a_indices, a_weights, i) * at(b_indices, b_weights, i))

    return let(F.array_intersect(a_indices, b_indices), product)


# ---------------------------------------------------------------------------- saved vectors
PART_VECTORS = 32_768  # in a row of the saved layout
QUERY_BYTES = 8 << 20  # of queries that are sent at a time


def packed_vectors(vectors: DataFrame, rows_each: int = PART_VECTORS, id_: str = "vec_id") -> DataFrame:
    """Vectors as parts: ``part``, ``ids``, ``dims``, ``matrix`` (64-bit floats, row after row)."""
    kept = vectors.select(F.col(id_).cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    parts = max(1, -(-kept.count() // rows_each))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = {len(v) for v in rows["embedding"]}
        if len(sizes) > 1:
            raise ValueError(f"embeddings of different lengths: {sorted(sizes)[:5]}")
        ordered = rows.sort_values("id")
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in ordered["embedding"]])
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "ids": [ordered["id"].tolist()], "dims": [matrix.shape[1]], "matrix": [matrix.tobytes()]})

    dealt = kept.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, "part long, ids array<long>, dims int, matrix binary")


def search_packed(parts: DataFrame, queries: DataFrame, k: int = 3, at_once: int = QUERY_BYTES) -> DataFrame:
    """Exact top k by cosine over `packed_vectors`: ``query_id, rank, vec_id, score``.

    The parts stay where they are read. Queries (query_id, embedding) come to them packed, ``at_once`` bytes at a time, in as
    many rounds as they need; each part returns k rows per query, which alone are shuffled.
    """
    sample = queries.filter(F.col("embedding").isNotNull()).agg(F.max(F.size("embedding"))).first()[0]
    empty = parts.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    blocks = packed_vectors(queries, max(1, at_once // (8 * sample)), "query_id")
    blocks = blocks.select(F.col("part").alias("block"), F.col("ids").alias("query_ids"), F.col("dims").alias("query_dims"), F.col("matrix").alias("query_matrix"))
    top = _nearest(k)

    def search(batches):
        for batch in batches:
            for row in batch.itertuples():
                read = lambda ids, dims, raw: list(np.frombuffer(raw).reshape(len(ids), dims)) if dims else []
                q = pd.DataFrame({"query_id": row.query_ids, "embedding": read(row.query_ids, row.query_dims, row.query_matrix)})
                v = pd.DataFrame({"vec_id": row.ids, "embedding": read(row.ids, row.dims, row.matrix)})
                yield top(q, v)

    def round_of(block: int) -> DataFrame:
        mine = blocks.filter(F.col("block") == block).withColumn("_all", F.lit(0).cast("bigint"))
        met = parts.withColumn("_all", F.pmod(F.xxhash64("part"), F.lit(1))).join(F.broadcast(mine), "_all").drop("_all")
        found = met.mapInPandas(search, "query_id long, vec_id long, score double")
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    n_blocks = max(1, -(-queries.filter(F.col("embedding").isNotNull()).count() // max(1, at_once // (8 * sample))))
    found = round_of(0)
    for block in range(1, n_blocks):
        found = found.unionByName(round_of(block))
    return found
