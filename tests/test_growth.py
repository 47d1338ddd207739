"""Operators whose way depends on sizes, batches or models: every way gives the same rows."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import registry, requests, retrieval
from fieldloom.plans import extract
from fieldloom.sources import sinks
from fieldloom.streaming import status

PAGE = "=" * 30


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------------------ keys and documents
@pytest.mark.parametrize("templates", [1, 500])
def test_keys_meet_documents_either_way(spark, templates):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % templates).cast("string").alias("subtype"), F.lit("a text").alias("text"))
    keys = spark.range(3 * templates).select(F.col("id").alias("key_id"), (F.col("id") % templates).cast("string").alias("subtype"), F.lit("name").alias("key_name"))
    sent, joined = retrieval.with_template_keys(docs, keys), retrieval.with_template_keys(docs, keys, limit=0)
    assert rows(sent, "doc_id", "key_id", "text") == rows(joined, "doc_id", "key_id", "text")
    assert sent.count() == 3000 and sent.columns == joined.columns
    for p in (plan(sent), plan(joined)):
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "hashpartitioning(doc_id" not in plan(sent)  # documents stay where they are


def test_keys_without_template_meet_every_document(spark):
    docs = spark.range(5).select(F.col("id").alias("doc_id"))
    keys = spark.range(2).select(F.col("id").alias("key_id"))
    assert retrieval.with_template_keys(docs, keys, None).count() == retrieval.with_template_keys(docs, keys, None, 0).count() == 10


@pytest.mark.parametrize("on", [None, "subtype"])
def test_keyword_search_either_way(spark, on):
    texts = ["Alpha beta, alpha-beta. Café!", "no hit", "++ C++ and c++ ++", None, "ALPHA\nBeta gamma", ""]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, subtype string")
    keys = spark.createDataFrame([(1, "alpha", "s"), (2, "alpha beta", "s"), (3, "++", "s"), (4, "café", "s"), (5, "c++", "s"), (6, "alpha", "t")], "key_id int, key_name string, subtype string")
    sent, joined = retrieval.keyword_search(docs, keys, on), retrieval.keyword_search(docs, keys, on, limit=0)
    found = rows(sent, "doc_id", "key_id", "match_idx", "page", "text", "context", "position")
    assert found == rows(joined, "doc_id", "key_id", "match_idx", "page", "text", "context", "position")
    assert {(r[0], r[1]) for r in found if r[1] != 6} >= {(0, 1), (0, 2), (0, 4), (4, 1)}
    assert ({r[1] for r in found} >= {6}) == (on is None)


# ------------------------------------------------------------------------------ extraction
def agreement(*pages):
    return "".join(f"{PAGE}\nPAGE {n}\n{PAGE}\n{body}\n" for n, body in enumerate(pages, 1))


GRID = "[Table 1]\n│ Margin Table │\n│ Level │ Base Margin │\n│ LIBOR Loans │ 1.25% │\n"
MAP = [("Margin Table", [2], "table", ["libor", "base"]), ("Terms", [1], "paragraph", ["fee", "upfront"])]


@pytest.fixture(scope="module")
def small(spark):
    section = "array<struct<topic:string,pages:array<int>,type:string,keywords:array<string>>>"
    text = agreement("The parties met.", GRID, "The margin of LIBOR Loans doubles after a default.\n\nOther words.")
    docs = spark.createDataFrame([(1, text, "loan", MAP, [])], f"doc_id long, text string, subtype string, sections {section}, definition_pages array<int>")
    keys = spark.createDataFrame([(1, "loan", "LIBOR Loans Base Margin", "", "", "percentage"), (2, "loan", "Upfront Fee", "", "", "percentage")],
                                 "key_id int, subtype string, key_name string, key_desc string, search_type string, expected_format string")
    return docs, keys


def test_rules_fill_the_context_of_a_table_value(small):
    found = {r.key_id: r for r in extract.extract_fields(*small).collect()}
    assert found[1].value == "1.25%" and found[1].rule_context == "The margin of LIBOR Loans doubles after a default."
    assert set(found[1].debug.timing) == {"tables_agent", "rules_agent", "description_agent", "validator"}
    assert found[2].value is None and set(found[2].debug.timing) == {"terms_agent", "terms_broader", "description_agent", "validator"}


def test_models_answer_their_branches(small):
    def tables(prompt):
        return json.dumps({"value": "9.99%", "page": 2, "confidence": "high", "row_label": "LIBOR Loans", "col_label": "Base Margin", "table_title": "Margin Table"})

    def rules(prompt):
        assert "doubles after a default" in prompt and "LIBOR Loans" in prompt
        return json.dumps({"value": None, "page": None, "confidence": "medium", "rule_context": "doubled on default"})

    def terms(prompt):
        assert "The parties met." in prompt
        return json.dumps({"value": "0.50%", "page": 1, "confidence": "high", "found_in": "clause"})

    def description(prompt):
        if "Upfront" in prompt:
            raise RuntimeError("no answer")
        return json.dumps({"definition_text": "the margin", "source_page": 2})

    def validator(prompt):
        assert "9.99%" in prompt
        return json.dumps({"value": "9.98%", "score": 0.8, "reason": "read again", "format_valid": True})

    models = {"tables": tables, "rules": rules, "terms": terms, "description": description, "validator": validator}
    found = {r.key_id: r for r in extract.extract_fields(*small, models).collect()}
    assert (found[1].value, found[1].rule_context, found[1].description, found[1].found_in) == ("9.98%", "doubled on default", "the margin", "table")
    assert found[1].debug.llm_calls == 4 and found[1].debug.timing["tables_agent"] > 0  # tables, rules, description, validator
    assert (found[2].value, found[2].found_in, found[2].page, found[2].description) == ("0.50%", "clause", "1", "")
    assert found[2].debug.llm_calls == 1
    with pytest.raises(ValueError, match="unknown kinds"):
        extract.extract_fields(*small, {"other": terms})


def test_texts_stay_in_their_rows(small):
    docs, keys = small
    cut = extract.prepared(docs)
    routed = extract.routes(cut, keys)
    assert not {"text", "pages", "sentences", "page_text"} & set(routed.columns)
    moved = [line for line in plan(routed).splitlines() if " Exchange " in line]
    assert not [line for line in moved if "doc_id" in line]  # keys come to the documents


# ------------------------------------------------------------------------------ streams
def test_status_over_ten_batches_reads_one_base_and_what_follows(spark, tmp_path):
    source, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "id long, ts timestamp, seq long, status string"
    changes = [(k % 7, k, f"s{k}") for k in range(100)]

    def run():
        stream = status.stream_parquet(spark, source, schema, per_batch=1)
        status.status_stream(stream, out, marks, compact_every=4).awaitTermination()

    for b in range(10):
        part = spark.createDataFrame(changes[10 * b : 10 * b + 10], "id long, seq long, status string")
        part.select("id", F.timestamp_seconds("seq").alias("ts"), "seq", "status").coalesce(1).write.mode("append").parquet(source)
        if b in (0, 9):
            run()
    assert status.newest_base(spark, out) == 7 and status.newest_base(spark, out, before=7) == 3
    want = sorted((i, max(k for k in range(100) if k % 7 == i)) for i in range(7))
    got = status.read_status(spark, out)
    assert rows(got.select("id", F.col("at.seq").alias("seq")), "id", "seq") == want
    # A replay writes the folders of its batch again and changes nothing.
    again = spark.read.parquet(f"{out}/deltas").filter("batch = 7").drop("batch").collect()
    spark.createDataFrame(again, status.read_status(spark, out).schema).write.mode("overwrite").parquet(f"{out}/deltas/batch=7")
    merged = status._merged(spark, out, before=7)
    assert rows(merged.select("id", F.col("at.seq").alias("seq")), "id", "seq") == sorted((i, max(k for k in range(80) if k % 7 == i)) for i in range(7))
    read = {re.search(r"batch=(\d+)", f).group(1) for f in status.read_status(spark, out).inputFiles() if "deltas" in f and "batch=" in f}
    assert {"8", "9"} <= read


def test_a_copy_that_comes_late_is_dropped(spark, tmp_path):
    source, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    schema = "fingerprint string, doc_id long, ts timestamp"
    batches = [[("a", 5, 0), ("b", 2, 0), ("a", 3, 0), (None, 9, 0)], [("a", 1, 900 * 86400), ("c", 7, 900 * 86400), (None, 4, 1)], [("b", 8, 0), ("c", 6, 0)]]
    for batch in batches:
        part = spark.createDataFrame(batch, "fingerprint string, doc_id long, s long")
        part.select("fingerprint", "doc_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        status.dedup_uploads(status.stream_parquet(spark, source, schema, per_batch=1), out, marks).awaitTermination()
    found = {r.fingerprint: r.doc_id for r in status.read_uploads(spark, out).collect()}
    assert found == {"a": 3, "b": 2, "c": 7, None: 9} and status.read_uploads(spark, out).count() == 4


# ------------------------------------------------------------------------------ logs and responses
def test_a_step_entered_again_counts_its_own_time(spark):
    log = spark.createDataFrame([(1, "map", 0), (1, "map", 4), (1, "read", 5), (1, "read", 7), (1, "map", 8), (1, "map", 9), (2, "map", 3)], "run_id int, step string, s long")
    found = registry.step_timings(log.select("run_id", "step", F.timestamp_seconds("s").alias("ts")), slow=2.0)
    assert rows(found, "run_id", "step", "entry", "duration", "run_total", "pct_of_max", "is_slow") == [
        (1, "map", 1, 4.0, 7.0, 100, True), (1, "map", 2, 1.0, 7.0, 25, False), (1, "read", 1, 2.0, 7.0, 50, True), (2, "map", 1, 0.0, 0.0, 0, False)]


def test_responses_hold_their_fields(spark):
    reg = spark.createDataFrame([(1, "a", "t", "completed", "done", 100.0, "2024", 0.5, 3, None), (2, "b", "t", "pending", "queued", 10.0, "2024", 0.0, 3, "wait")],
                                "id int, name string, document_type string, status string, pipeline_step string, progress double, created_at string, avg_confidence double, total_pages int, error_msg string")
    res = spark.createDataFrame([(1, 2, "k2", "v"), (1, 1, "k1", None), (2, 1, "k1", "hidden")], "doc_id int, key_id int, key_name string, value string")
    res = res.select("*", *[F.lit(None).cast("string").alias(c) for c in registry.RESPONSE_FIELDS if c not in res.columns])
    texts = spark.createDataFrame([(1, "the text"), (2, "hidden")], "doc_id int, text string")
    found = {r.id: r for r in registry.result_response(reg, res, texts).collect()}
    assert [f.key_name for f in found[1].fields] == ["k1", "k2"] and found[1].ocr_text == "the text" and found[1].progress is None
    assert found[2].fields == [] and found[2].ocr_text == "" and (found[2].progress, found[2].error_msg, found[2].total_keys) == (10.0, "wait", 0)


# ------------------------------------------------------------------------------ vectors
def test_saved_vectors_are_searched_where_they_lie(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(300, 8)).tolist()
    vectors = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(k, data[7 * k]) for k in range(20)], "query_id long, embedding array<double>")
    empty = spark.createDataFrame([], "doc_id int")
    retrieval.PART_VECTORS, kept = 50, retrieval.PART_VECTORS
    try:
        sinks.persist_index(empty, empty, str(tmp_path), vectors)
    finally:
        retrieval.PART_VECTORS = kept
    parts = sinks.load_vectors(spark, str(tmp_path))
    cols = ["query_id", "rank", "vec_id", "score"]
    want = rows(retrieval.vector_topk(vectors, queries, 4), *cols)
    once = retrieval.search_packed(parts, queries, 4)
    assert rows(once, *cols) == want == rows(retrieval.search_packed(parts, queries, 4, at_once=400), *cols)
    assert "matrix" not in " ".join(line for line in plan(once).splitlines() if " Exchange " in line)
    assert retrieval.search_packed(parts, queries.limit(0)).collect() == []


def test_sparse_vectors(spark):
    texts = spark.createDataFrame([(1, "red green red"), (2, "red blue"), (3, ""), (4, None)], "doc_id int, snippet string")
    found = {r.doc_id: r for r in retrieval.embed_snippets(texts).collect()}
    assert len(found[1].indices) == 2 and found[1].indices == sorted(found[1].indices) and sum(w * w for w in found[1].weights) == pytest.approx(1)
    assert found[3].indices == found[4].weights == []
    two = spark.createDataFrame([(found[1].indices, found[1].weights, found[2].indices, found[2].weights)], "a array<bigint>, x array<double>, b array<bigint>, y array<double>")
    dot = two.select(retrieval.sparse_dot(*map(F.col, "axby"))).first()[0]
    mine, other = dict(zip(found[1].indices, found[1].weights)), dict(zip(found[2].indices, found[2].weights))
    assert dot == pytest.approx(sum(w * other.get(i, 0) for i, w in mine.items())) and dot > 0


# ------------------------------------------------------------------------------ requests
def test_every_kind_of_request_names_its_parts(spark):
    row = spark.createDataFrame(
        [("Fee", "what is paid", "1%", "row", "col", "Title", "high", "ctx", "pages", "text", "text of pages", "issue", "meaning", [(0.5, 3, "snip")])],
        "key_name string, key_desc string, value string, row_label string, col_label string, table_title string, confidence string, context string, summary string, "
        "expected_format string, page_text string, issue string, definition_text string, snippets array<struct<score:double,page:int,snippet:string>>")
    parts = {
        "document_map": ["pages"], "router": ["Fee", "what is paid", "pages"], "tables": ["Fee", "text of pages"], "terms": ["Fee", "what is paid", "text of pages"],
        "rules": ["Fee", "1%", "row", "col", "Title", "high", "ctx"], "description": ["Fee", "[1] (page 3) snip"], "table_specialist": ["Fee", "score=0.500", "snip"],
        "definition": ["Fee", "snip"], "validator": ["Fee", "1%", "issue", "meaning", "text of pages"], "scored_validator": ["1%", "row", "col", "meaning", "text of pages"],
    }
    for kind, wanted in parts.items():
        got = requests.build_requests(row, kind).first()
        assert got.agent == kind and all(w in got.prompt for w in wanted), (kind, got.prompt)


# ------------------------------------------------------------------------------ matches and parts
def old_spans(text, pattern):
    """The former way: gaps from ``split``, matches from ``regexp_extract_all``."""
    return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))


@pytest.mark.parametrize("text", ["", "no", "a1b22￿c333", "￿1￾￿", "7", "𝄞5￿￿6𝄞", "1￾2"])
def test_marks_of_the_text_itself_stay(spark, text):
    from fieldloom.functions.text import cut, last_match_start, match_spans

    pattern = "[0-9￿]￾?" if "￾" not in text else r"\d+"
    one = spark.createDataFrame([(text,)], "t string")
    for p in (r"\d+", pattern):
        found = one.select(match_spans("t", p, {"g": 0}).alias("m"), last_match_start(F.col("t"), p).alias("last"), cut("t", p).alias("cut"), old_spans(F.col("t"), p).alias("old")).first()
        if p == r"\d+":
            starts = [m.start() for m in re.finditer(p, text)]
            assert [(m.start, m.hit, m.g) for m in found.m] == [(s, h, h) for s, h in zip(starts, found.old.hits)]
            assert found.last == (starts[-1] if starts else -1)
        assert found["cut"] == found.old.gaps


def test_first_letters_change_no_match(spark):
    from fieldloom.functions import patterns as P

    text = (
        "FOR THE BORROWER\nName: Ann Lee\nTitle: Minister of Work\nfor the bank by: Bo Li Na\nPosition: Country Director\n'Bank' \"Borrower\" IBRD World Bank "
        "International Bank eur 1,000 million uſd 5.00 XDR 77 JPY12 loan no. A-123 Project number XY_9 dated as of May 1, 2020 as of 1/2/2020 effective date of June 3 2021 "
        "carry out the Rural Water Program financing of Sector Work Programme implement City Plan Program ſhall not permit the Debt Ratio to be greater than 3.5 to one; "
        "maintains a Cover Ratio at least 1.2 to 1. will not permit Some Ratio exceed 4 to 1 or so; shall maintain Total Cover not less than 2 to 1. "
    )
    one = spark.createDataFrame([(text,), (text.upper(),), (text.lower(),)], "t string")
    found = 0
    for pattern in [P.SIGNER_NAME, P.SIGNER_TITLE, P.BORROWER_SIDE, P.BANK_SIDE, P.AMOUNT, P.REFERENCE_NUMBER, P.COVENANT, P.AGREEMENT_DATES[0], P.PROGRAMS[1]]:
        plain = re.sub(r"\(\?=\[[^]]*\]\)", "", pattern, count=1)
        assert plain != pattern
        every = one.select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).collect()
        assert all(r.a == r.b for r in every)
        found += sum(len(r.a) for r in every)
    assert found > 30


def test_texts_are_made_in_many_tasks(spark, tmp_path):
    from fieldloom.sources import bindings

    n = spark.range(40).coalesce(1)
    n.select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1234.5).alias("o_totalprice"),
             F.lit("1-URGENT").alias("o_orderpriority"), F.lit("1995-01-02").cast("date").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).coalesce(1).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    n.select(F.col("id").alias("l_partkey"), F.lit("A").alias("l_returnflag"), F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax")).write.parquet(f"{tmp_path}/lineitem.parquet")
    t = bindings.Tables(spark, str(tmp_path))
    for docs in (bindings.agreements(t), bindings.grid_documents(t), bindings.split_grid_documents(t)):
        made = docs.select("doc_id", "text", F.spark_partition_id().alias("part")).collect()
        assert sorted(r.doc_id for r in made) == list(range(40)) and len({r.part for r in made}) >= 8
    assert bindings.html_documents(t).select(F.spark_partition_id().alias("part")).distinct().count() >= 8


def test_results_are_packed_and_read_back(spark, tmp_path):
    rows_ = [(k, "Rate", "d" * 50) for k in range(500)]
    df = spark.createDataFrame(rows_, "key_id long, key_name string, debug string")
    sinks.write_results_json(df, str(tmp_path / "packed"), "r1")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "packed" / "run=r1")).collect())) == rows_
    parts = [p for p in (tmp_path / "packed").rglob("part-*")]
    assert parts and sum(p.stat().st_size for p in parts) < 20_000


def test_embedding_counts_words_within_rows_and_merges_repeated_keys(spark):
    texts = [(1, "b a b"), (2, "a c"), (2, "c d c"), (None, "a e"), (None, "e"), (3, None), (4, ""), (5, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, snippet string")
    got = sorted(map(tuple, retrieval._term_counts(docs, "snippet", "doc_id").collect()), key=str)
    assert got == sorted(map(tuple, retrieval._term_counts(docs, "snippet", "doc_id", 0).collect()), key=str)
    assert sorted(r[2] for r in got if r[0] == 2) == [1, 1, 3] and sorted(r[2] for r in got if r[0] is None) == [1, 2]
    once = docs.filter("doc_id IN (1, 3, 4, 5)")
    counts = retrieval._term_counts(once, "snippet", "doc_id")
    assert sorted((r.doc_id, r.tf) for r in counts.collect()) == [(1, 1), (1, 2), (5, 1)]
    assert "Exchange" not in plan(counts)
    assert retrieval.embed_snippets(docs).count() == len(texts)
