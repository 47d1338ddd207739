"""Hand-derived goldens and brute-force checks on small fixtures."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.catalog import incremental
from fieldloom.functions import formats
from fieldloom.functions import patterns as P
from fieldloom.functions.text import match_spans, running_offsets, strip
from fieldloom.operators import extractors, keys, pages, registry, requests, retrieval, tables, validation
from fieldloom.sources import corpus

RULE = "=" * 20
HTML = (
    "<table><tr><td colspan=5>Margin Steps</td></tr><tr><td>Debt Cover</td><td>- 2.50x</td>"
    "<td>2.50x to 2.00x</td><td><2.00x</td><td>1.50x</td></tr>"
    "<tr><td>Term Loans</td><td>3.10%</td><td>2.80%</td><td>2.60%</td><td>2.40%</td></tr>"
    "<tr><td>Bridge Loans</td><td>2.10%</td><td>1.80%</td><td>1.60%</td><td>1.40%</td></tr>"
    "<tr><td>Standby Fee</td><td>0.70%</td><td>0.60%</td><td>0.55%</td><td>0.45%</td></tr></table>"
)


def page(n, text):
    return f"{RULE}\nPAGE {n}\n{RULE}\n{text}\n"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def scalar(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_spans_match_python(spark):
    text = "été 12 and 345,\n6 été " * 40
    got = [(r["start"], r["hit"]) for r in scalar(spark, match_spans(F.lit(text), r"\d+"))]
    assert got == [(m.start(), m.group()) for m in re.finditer(r"\d+", text)]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_running_offsets(spark, n):
    xs = F.array(*[F.lit(i % 7) for i in range(n)]).cast("array<int>")
    assert scalar(spark, running_offsets(xs)) == [sum(j % 7 for j in range(i)) for i in range(n)]


def test_strip_like_python(spark):
    text = "  \t x y \x1f\n"
    assert scalar(spark, strip(F.lit(text))) == text.strip()


def test_split_pages_variants(spark):
    d = docs(
        spark, "no marker \n", "lead" + "\n" + page(2, " b ") + page(1, "a"), page(1, "old") + page(1, "new"),
        page(3, "x").replace("PAGE", "page"),
    )
    assert rows(pages.split_pages(d), "doc_id", "page", "text") == [
        (0, 1, "no marker \n"), (1, 1, "a"), (1, 2, "b"), (2, 1, "new"), (3, 3, "x"),
    ]


def test_section_runs(spark):
    grid = "│ a │ b │ c │"
    d = docs(spark, page(1, "x") + page(2, grid) + page(3, grid) + page(5, "y"))
    got = pages.fallback_section_map(d).orderBy("section_idx").select("topic", "pages", "type").collect()
    assert [tuple(r) for r in got] == [
        ("Section (pages 1-1)", [1], "paragraph"), ("Table (pages 2-3)", [2, 3], "table"),
        ("Section (pages 5-5)", [5], "paragraph"),
    ]


def test_assemble_over_blocks(spark):
    p = spark.createDataFrame([(1, n, f"t{n}") for n in range(1, 12)], "doc_id long, page int, text string")
    text = pages.assemble_pages(p, block=4).first()["text"]
    assert text == "\n\n".join(f"── Page {n} ──\nt{n}" for n in range(1, 12))


def test_batch_response(spark):
    d = docs(spark, "skip === PAGE 1 ===\na\n=== page 2 === b", " plain ")
    got = {r["doc_id"]: r["texts"] for r in pages.split_batch_response(d, 3).collect()}
    assert got == {0: ["a", "b", ""], 1: ["plain", "", ""]}


def test_html_grid(spark):
    d = spark.createDataFrame([(1, HTML)], "doc_id long, html string")
    cells = tables.html_table_cells(d)
    assert cells.count() == 12
    assert cells.filter("row_label = 'Bridge Loans' and col_idx = 4").first()["value"] == "1.40%"


def grid(*lines):
    return "[Table 1]\n" + "\n".join("│ " + " │ ".join(line) + " │" for line in lines) + "\n"


def test_value_like_header_becomes_data(spark):
    text = grid(
        ["Margin Steps"], ["Debt Cover", "- 2.50x", "2.50x and > 2.00x", "<2.00x", "1.50x"],
        ["Term Loans", "3.10%", "2.80%", "2.60%", "2.40%"], ["Bridge Loans", "2.10%", "1.80%", "1.60%", "1.40%"],
        ["Standby Fee", "0.70%", "0.60%", "0.55%", "0.45%"],
    )
    cells = tables.grid_cells(docs(spark, text))
    assert cells.count() == 16 and cells.filter("col_label = 'col_1'").count() == 4
    headed = tables.grid_cells(docs(spark, text), header_rows=1)
    assert headed.count() == 12 and headed.filter("col_label = '- 2.50x'").count() == 3


def test_blank_cell_shifts_left(spark):
    text = grid(["Level", "A", "B"], ["x", "", "2%"])
    assert rows(tables.grid_cells(docs(spark, text)), "col_label", "value") == [("A", "2%")]
    assert rows(tables.grid_cells(docs(spark, text), keep_empty=True), "col_label", "value") == [("B", "2%")]


def test_two_line_header_shifts(spark):
    text = grid(["Leverage Ratio Grid", "LIBOR", "ABR"], ["", "Loans", "Loans"], ["Ratio ≥ 3", "2.25%", "1.25%"])
    assert rows(tables.grid_cells(docs(spark, text)), "col_label", "value") == [("ABR", "1.25%"), ("LIBOR Loans", "2.25%")]


def test_stitch_reaches_two_tables_only(spark):
    head, data, plain = grid(["Fees"], ["Level", "A"]), grid(["x", "1%"]), grid(["note"], ["more"])
    near = docs(spark, page(5, head) + page(6, data))
    assert rows(tables.stitch_cross_page(near), "table_title", "row_label", "col_label", "value", "page") == [
        ("Fees", "x", "A", "1%", 6)]
    far = docs(spark, page(5, head) + plain.replace("1]", "2]") + plain.replace("1]", "3]") + data)
    assert tables.stitch_cross_page(far).count() == 0


def test_merged_value(spark):
    pick = lambda v, c: scalar(spark, tables.merged_value(F.lit(v), F.lit(c)))
    assert pick("0.375%0.30%", "x") == "0.375%"
    assert pick("0.375%0.30%", "at 0.30 level") == "0.30%"
    assert pick(".75%", "x") == ".75%"


@pytest.mark.parametrize("fmt,value,valid,normal", [
    ("percentage", "2.25%", True, "2.25%"), ("percentage", "2.25", True, "2.25%"), ("percentage", ".75%", False, ".75%"),
    ("ratio", "4.50 to 1.00", True, "4.50 to 1.00"), ("ratio", "4.50 to 1", True, "4.50 to 1"),
    ("ratio", "3.00x", False, "3.00x"), ("date", "January 15, 2020", True, "2020-01-15"),
    ("date", "15/01/2020", True, "2020-15-01"), ("date", "2020/1/5", True, "2020-01-05"), ("date", "soon", False, "soon"),
    ("currency", "EUR 1,000,000", True, "EUR 1,000,000"), ("number", "145", True, "145"),
    ("amount", "anything", True, "anything"), ("text", "N/A", False, None), ("text", None, False, None),
])
def test_format_check(spark, fmt, value, valid, normal):
    got = scalar(spark, formats.format_check(F.lit(value).cast("string"), F.lit(fmt)))
    assert (got["valid"], got["normalized"]) == (valid, normal)


def test_strict_dates_and_lenient_values(spark):
    assert not scalar(spark, formats.format_check(F.lit("15/01/2020"), F.lit("date"), strict=True))["valid"]
    assert scalar(spark, formats.format_check(F.lit(".75%"), F.lit("percentage"), lenient=True))["valid"]


def test_sanity_hint(spark):
    got = scalar(spark, formats.sanity_check(F.lit("4.50 to 1.00"), F.lit("ratio"), F.lit("4.00 to 1.00")))
    assert got["valid"] and got["score_adj"] == -0.1


def test_covenant_cut_at_decimal_point(spark):
    d = docs(spark, "The Borrower shall not permit the Leverage Ratio to be greater than 4.50 to 1.00.",
             "shall not permit the Cover Ratio to be less than 3 to 1 at any time.")
    assert rows(extractors.extract_covenants(d), "doc_id", "value_hint") == [(1, "3 to 1")]


def test_text_values(spark):
    text = ("dated as of November 2, 2015. EUR386,200,000 and EUR 386,200,000 and USD 5,000\n"
            'KINGDOM OF MOROCCO ("Borrower")\nFOR THE BANK\nName: Jane Doe\n')
    d = docs(spark, text)
    assert rows(extractors.extract_dates(d), "value") == [("November 2, 2015",)]
    assert rows(extractors.extract_amounts(d), "value") == [("EUR 386,200,000",), ("USD 5,000",)]
    assert rows(extractors.principal_currency(d), "currency") == [("EUR",), ("USD",)]
    assert rows(extractors.extract_parties(d), "name", "role") == [("KINGDOM OF MOROCCO", "Borrower")]
    assert rows(extractors.extract_signatories(d), "role", "value") == [("Bank Authorized Representative", "Jane Doe")]


def test_keyword_hits(spark):
    d = docs(spark, page(1, "A fee-note, FEE and coffee.") + page(2, "a.b fee"), "nothing")
    k = spark.createDataFrame([(1, "fee"), (2, "a.b"), (3, "fee-note"), (4, "zzz")], "key_id int, key_name string")
    cols = ["doc_id", "key_id", "match_idx", "page", "text", "position", "context"]
    small = rows(retrieval.keyword_search(d, k), *cols)
    text = d.first()["text"]
    want = [(n.lower(), m.start()) for n in ("fee", "a.b", "fee-note")
            for m in re.finditer(rf"\b{re.escape(n)}\b", text, re.I)]
    assert sorted(p for _, p in want) == sorted(r[5] for r in small)


def test_vector_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    m[5] = m[9]  # a tie
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(m).T, 12)
    want = [(i, r + 1, j) for i in range(7) for r, j in enumerate(sorted(range(60), key=lambda j: (-scores[i, j], j))[:4])]
    holes = v.unionByName(spark.createDataFrame([(99, None)], v.schema))
    for block, part in ((4096, 32_768), (3, 7)):
        assert rows(retrieval.vector_topk(holes, qs, 4, block, part), "query_id", "rank", "vec_id") == sorted(want)


def test_load_keys(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"keys": [{"keyName": "A"}, {"keyName": "B", "searchType": null}]}')
    assert rows(keys.load_keys(spark, str(tmp_path / "k.json")), "key_name", "search_type") == [("A", ""), ("B", "")]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError):
        keys.load_keys(spark, str(tmp_path / "e.json"))


def test_running_count_across_buckets(spark):
    d = spark.range(50).select(F.lit(1).alias("doc_id"), F.col("id").alias("key_id"))
    got = registry.running_count(d, ["doc_id"], ["key_id"], F.floor(F.col("key_id") / 7))
    assert all(r["done"] == r["key_id"] + 1 for r in got.collect())


def test_failed_calls_become_rows(spark):
    def fn(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return "{}"

    d = spark.createDataFrame([("ok",), ("bad",)], "prompt string")
    assert rows(requests.with_inference(d, fn).fillna(""), "prompt", "raw", "error") == [("bad", "", "no"), ("ok", "{}", "")]


def test_json_answers(spark):
    d = spark.createDataFrame([('```json\n{"v": 1}\n```',), ('so: {"v": 2} ok',), ('x {"a": {"v": 3}} y',)], "raw string")
    got = validation.parse_model_json(d, "v int").select("parse_ok", "parsed.v").collect()
    assert [tuple(r) for r in got] == [(True, 1), (True, 2), (False, None)]


def test_nothing_is_cut_by_default(spark):
    text = "".join(page(n, f"Line of page {n} that is long enough for a chunk to be kept.") for n in range(1, 20))
    d = docs(spark, text)
    assert pages.page_chunks(d).select("page").distinct().count() == 19
    assert "[Page 19]" in pages.router_summary(d).first()["summary"]
    head = "x" * (1 << 20)
    two = docs(spark, head + "a", head + "b")
    assert two.select(corpus.text_fingerprint("text")).distinct().count() == 2
    wide = d.select("doc_id", pages.page_array("text").alias("pages"), F.array(F.lit(1)).alias("used_pages"))
    assert retrieval.broader_search(wide).first()["next_pages"] == list(range(2, 20))


def test_page_number_beyond_int(spark):
    d = docs(spark, page(1, "one") + page(99999999999, "lost") + page(2, "two"))
    assert rows(pages.split_pages(d), "page", "text") == [(1, "one"), (2, "two")]
    wanted = d.select("doc_id", pages.page_text(pages.page_array("text"), F.array(F.lit(2))).alias("t"))
    assert "two" in wanted.first()["t"]


def test_repeated_cache_rows_reuse_a_page_once(spark):
    todo = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page int")
    cached = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, None)], "doc_id long, page int, cached_text string")
    reused, left = corpus.skip_processed(todo, cached, ["doc_id", "page"])
    assert rows(reused, "page", "cached_text") == [(1, "b")] and rows(left, "page") == [(2,)]


def test_template_keys_join_on_values(spark):
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("loan").alias("subtype"))
    k = spark.createDataFrame([(1, "loan"), (2, "loan"), (3, "other")], "key_id int, subtype string")
    paired = retrieval.with_template_keys(d, k)
    assert paired.count() == 100
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_streams_read_tables_of_several_files(spark, tmp_path):
    source = spark.range(90).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 40).alias("text"))
    source.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = incremental.dedup_uploads(spark, str(tmp_path))
    assert found.count() == found.distinct().count() == 40
    assert incremental.incremental_pages(spark, str(tmp_path)).count() == 90
    source.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert incremental.dedup_uploads(spark, str(tmp_path / "empty")).count() == 0


def test_definition_answers_have_defaults(spark):
    asked = spark.createDataFrame([(1, "Closing Date"), (2, "Margin")], "key_id int, key_name string")
    answers = spark.createDataFrame([(2, "the margin is", "", "percentage", 4)],
                                    "key_id int, definition_text string, extraction_mode string, expected_format string, source_page int")
    got = rows(validation.coalesce_definition(asked, answers, ["key_id"]), "key_id", "definition_text", "extraction_mode", "expected_format", "source_page")
    assert got == [(1, "", "verbatim", "date", None), (2, "the margin is", "verbatim", "percentage", "4")]


def test_milestones_of_steps(spark):
    steps = spark.createDataFrame([("ocr_done",), ("completed",), ("other",)], "step string")
    assert rows(steps.select("step", registry.milestone("step").alias("m")), "step", "m") == [("completed", 100.0), ("ocr_done", 20.0), ("other", 0.0)]


def test_ruled_page_headers_split(spark):
    d = docs(spark, "── Page 1 ──\none\n── Page 2 ──\ntwo")
    assert rows(pages.split_pages(d, P.RULED_PAGE_HEADER), "page", "text") == [(1, "one"), (2, "two")]


def test_batched_inference_marks_failures(spark):
    def model(prompts):
        if "bad" in prompts:
            raise RuntimeError("boom " + "x" * 300)
        return [p.upper() for p in prompts]

    asked = spark.createDataFrame([("good",), ("bad",)], "prompt string").coalesce(1)
    got = {r["prompt"]: r for r in requests.with_inference(asked, model, batched=True).collect()}
    assert got["good"]["raw"] == "GOOD" and got["bad"]["raw"] is None and len(got["bad"]["error"]) == 305
