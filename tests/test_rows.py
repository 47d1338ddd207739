"""What concerns one document is found, routed and chosen in its row; quick searches find what the plain ones find."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import formats
from fieldloom.functions import patterns as P
from fieldloom.functions.text import cut, match_spans
from fieldloom.operators import extractors, retrieval
from fieldloom.plans import extract, index

RULE = "=" * 30
SECTION = "array<struct<topic:string,pages:array<int>,type:string,keywords:array<string>>>"
MAP = [("Margin Table", [2], "table", ["libor", "base"]), ("Terms", [1], "paragraph", ["fee", "upfront", "date", "party"])]
GRID = "[Table 1]\n│ Margin Table │\n│ Level │ Base Margin │\n│ LIBOR Loans │ {}% │\n"


def text_of(n, margin):
    pages = [f'dated as of May {n}, 2020\n"Upfront Fee" means a fee equal to 0.{n}% per annum on the whole amount.\n\nEUR {n},000 are lent.',
             GRID.format(margin), "The margin of LIBOR Loans doubles after a default. Other words."]
    return "".join(f"{RULE}\nPAGE {k}\n{RULE}\n{body}\n" for k, body in enumerate(pages, 1))


def docs_of(spark, rows):
    made = [(doc, text, "loan", MAP, []) for doc, text in rows]
    return spark.createDataFrame(made, f"doc_id long, text string, subtype string, sections {SECTION}, definition_pages array<int>")


@pytest.fixture(scope="module")
def keys(spark):
    made = [(1, "loan", "LIBOR Loans Base Margin", "", "", "percentage"), (2, "loan", "Upfront Fee", "", "", "percentage"), (3, "loan", "Agreement Date", "", "", "date"),
            (4, "loan", "Loan Amount", "", "", "currency"), (5, "loan", "Governing Default", "", "", "text"), (6, "other", "None", "", "", "text")]
    return spark.createDataFrame(made, "key_id int, subtype string, key_name string, key_desc string, search_type string, expected_format string")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def values(df):
    return sorted((tuple(r) for r in df.select("doc_id", "key_id", "branch", "found_in", "value", "page", "confidence", "rule", "sentence", "section").collect()), key=str)


def best_values(docs, keys):
    return extract.value_cascade(extract.route_arrays(docs, keys), extract.found_values(docs))


def test_values_of_documents_are_those_of_rows_per_key(spark, keys):
    docs = extract.prepared(docs_of(spark, [(1, text_of(3, "1.25")), (2, text_of(4, "2.50")), (3, None), (4, "no page"), (None, text_of(5, "9.75"))]))
    best = best_values(docs, keys)
    assert values(best) == values(extract.value_cascade(extract.routes(docs, keys), extract.found_values(docs)))
    found = {(r.doc_id, r.key_id): r.value for r in best.collect()}
    assert found[1, 1] == "1.25%" and found[2, 2] == "0.4%" and found[1, 3] == "May 3, 2020" and found[2, 4] == "EUR 4,000" and found[None, 1] is None
    assert "explode(asked" in plan(best).split("Join LeftOuter")[0]  # one row per document until it has met its values


def test_a_key_meets_only_values_of_its_kinds(spark, keys):
    docs = extract.prepared(docs_of(spark, [(1, text_of(3, "1.25"))]))
    met = plan(best_values(docs, keys)).split("posexplode(", 1)[1].split("\n")[0]
    assert all(kind in met for kind in ("cells", "dates", "amounts", "terms", "others"))


@pytest.mark.parametrize("rows", [[(1, 3, "1.25"), (1, 3, "1.25")], [(1, 3, "1.25"), (1, 4, "2.50"), (2, 5, "3.75")], [(None, 3, "1.25"), (None, 4, "2.50")]])
def test_documents_of_one_id_make_one_row_per_key(spark, keys, rows):
    docs = extract.prepared(docs_of(spark, [(doc, text_of(n, margin)) for doc, n, margin in rows]))
    assert best_values(docs, keys.unionByName(keys)).count() == len({r[0] for r in rows}) * 5


def test_texts_are_read_once_for_all_cells(spark, tmp_path):
    docs_of(spark, [(1, text_of(3, "1.25")), (2, None)]).write.parquet(f"{tmp_path}/docs")
    made = index.table_cells(spark.read.parquet(f"{tmp_path}/docs"))
    assert plan(made).count("Relation [") == 1
    assert {r.row_label for r in made.collect()} == {"LIBOR Loans"}


def test_signals_are_those_of_the_pattern(spark):
    texts = [None, "", "This is so", "thiſ is", "means", "it meanſ x", "demeans it", "meansx", "SHALL MEAN", "shaLL be", "marshall be", "shall beam", "the Definitions", '"definitions"',
             "calculated as│", "uncalculated as", "éis", "is é", "İs", "ıs", "payable at", "payable\nat", "amounts to 5", "re-presents", "represents", "DEFINED TERM", "wiLL be", "equals", "equalsé", "I\u0130S is"]
    one = spark.createDataFrame([(t,) for t in texts], "t string").select("t", retrieval.is_signal(F.col("t")).alias("a"), F.col("t").rlike(P.DEFINITION_SIGNAL).alias("b")).collect()
    assert [(r.t, r.a) for r in one] == [(r.t, r.b) for r in one]
    assert 10 < sum(bool(r.a) for r in one) < len(texts) - 8


def test_sentences_are_cut_as_before(spark):
    texts = [None, "", "a. b", ". b", "a.\n\n\nb", "a\n\nb\n \n\nc", "a?! \u2003b.\tc", "...  x", "a.\uffff b. c", "é!\n𝒳? z.", " \n\n ", "a.\u00a0b\n\n.\n\n"]
    one = spark.createDataFrame([(t,) for t in texts], "t string").select(cut("t", P.SENTENCE_BREAK, P.SENTENCE_END).alias("a"), F.split("t", P.SENTENCE_BREAK, -1).alias("b")).collect()
    assert [r.a for r in one] == [r.b for r in one]


def test_page_markers_and_keywords_match_as_the_plain_patterns(spark):
    plain = r"(?iU)={20,}\s*\nPAGE\s+(\d+)\s*\n={20,}"
    texts = ["", f"{RULE}\nPAGE 1\n{RULE}", f"x{RULE}== \n\npage ٣ \n{RULE}{RULE}\nPage 4\n{RULE[:20]}=", f"{RULE[:19]}\nPAGE 1\n{RULE}", f"{RULE}\nPAGE 2\n{RULE[:19]}"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        match_spans("t", P.PAGE_MARKER, {"n": 1}, whole=True).alias("a"), match_spans("t", plain, {"n": 1}).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and any(r.a for r in rows)
    told = "Borrower borrowers (BORROWER) ſum Sum xSUM c++ C++x \\d a.b a+b 𝒳y \n."
    words = spark.createDataFrame([(k, told) for k in ("borrower", "sum", "c++", "\\d", "a.b", "(b", "𝒳y", "", "\n.")], "k string, t string")
    free = F.regexp_replace(retrieval.keyword_pattern(F.col("k")), r"(?s)^\(\?iu\)\(\?=\\?.\)", "(?iu)")
    found = words.select(F.regexp_extract_all("t", retrieval.keyword_pattern(F.col("k")), F.lit(0)).alias("a"), F.regexp_extract_all("t", free, F.lit(0)).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and sum(len(r.a) for r in found) >= 6


def test_signers_at_the_end_of_a_text(spark):
    texts = ["Name: Bo Li x, and\nName: Bo Li x", "Name: Bo Li\nName: Bo Li\n", "name: Ann Lee\r\n", "By: Ann Lee", "Title: Head of Work\nTITLE: Head of Work"]
    for pattern in (P.SIGNER_NAME, P.SIGNER_TITLE):
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select(match_spans("t", pattern, whole="\n").alias("a"), match_spans("t", pattern).alias("b")).collect():
            assert r.a == r.b
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert extractors.extract_signatories(docs).count() == 7


def test_currency_codes_need_their_words(spark):
    texts = [None, "", "expreſſed in EUR", "EXPRESSED IN eur.", "the amount of it (usd)", "Amount\n(abc)", "paid in GBP", "expressed in dollars, in CHF"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(formats.rescue_code(F.lit("Currency"), F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [None, None, "EUR", "EUR", "USD", None, "GBP", "CHF"]
