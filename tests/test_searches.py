"""Each text is searched once per pattern, and only candidates are sorted."""

import re

from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.text import last_match_start, match_spans
from fieldloom.operators import extractors, tables
from fieldloom.plans import extract
from fieldloom.sources import bindings


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_side_is_found_by_one_search(spark):
    texts = [
        None, "", "no side", "FOR THE BORROWER\nName: ", "FOR THE BANK\nBy: ", "for the bank of the borrower", "BORROWER IBRD", "IBRD BORROWER",
        '("Borrower") and ("Bank") agree', '("Bank") and ("Borrower") agree', "xBANK 'Bank'Borrower'", "'Bank'Bank' x", "World Bank\n\n" + "é𝒳 " * 300,
        "INTERNATIONAL BANK for the borrowers", "FOR THE BORROWERS' World Bank", "BORROWER" + " y" * 390 + " IBRD", "IBRD" + " y" * 397 + " tail",
    ]
    docs = docs_of(spark, *texts).withColumn("at", F.coalesce(F.length("text"), F.lit(0)))
    window = F.substring("text", F.greatest(F.col("at") - P.PARTY_LOOKBACK, F.lit(0)) + 1, F.least("at", F.lit(P.PARTY_LOOKBACK)))
    later = last_match_start(F.col("w"), P.BANK_SIDE) > last_match_start(F.col("w"), P.BORROWER_SIDE)
    got = docs.withColumn("w", window).select(
        "text", extractors.nearest_side(F.col("text"), F.col("at")).alias("got"), F.when(later, "Bank").otherwise("Borrower").alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert {r.got for r in got} == {"Bank", "Borrower"}
    assert "regexp_replace" not in plan(extractors.nearest_party(docs, F.array("at")))


def test_only_candidates_of_a_key_are_sorted(spark):
    asked = spark.createDataFrame(
        [(1, 1, ["rate"], "percentage", [1]), (1, 2, ["other"], "text", [1]), (2, 1, ["rate"], "percentage", [1]), (None, 1, ["rate"], "percentage", [1])],
        "doc_id long, key_id int, key_words array<string>, format string, section_pages array<int>",
    ).selectExpr("*", "'table' AS content_type", "array(2) AS next_pages", "CAST(NULL AS struct<page:int,snippet:string>) AS sentence")
    cells = [(d, "cell", 0, 1, "rate", "", f"{v}%") for d in (1, None) for v in range(9, 3, -1)]
    found = spark.createDataFrame([*cells, (1, "date", 0, 1, "rate", "", "x")], "doc_id long, source string, pos int, page int, row_label string, col_label string, value string")
    best = extract.value_cascade(asked, found)
    got = {(r.doc_id, r.key_id): (r.branch, r.value) for r in best.collect()}
    assert got == {(1, 1): (1, "4%"), (1, 2): (None, None), (2, 1): (None, None), (None, 1): (None, None)}
    below = plan(best).split("Aggregate [doc_id", 2)[1].split("Join", 1)[0]
    assert "Filter" in below and "posexplode" in below


def test_matches_are_sought_once(spark):
    text = 'A\n"Commitment Fee" means a fee equal to 0.25% per annum on the undrawn amount.\n\nbetween\nALPHA CO\nand\nBETA BANK\n(x)'
    docs = docs_of(spark, text, "nothing", None, "")
    defined = extractors.extract_definitions(docs)
    assert [(r.doc_id, r.term) for r in defined.collect()] == [(0, "Commitment Fee")]
    assert "RLIKE" not in plan(extractors.find_all(docs, P.DEFINITION, {"term": 1}))
    assert "RLIKE" not in plan(tables.known_grid(docs))
    parties = extractors.extract_parties(docs)
    assert {(r.name, r.role) for r in parties.collect()} == {("ALPHA CO", "Borrower"), ("BETA BANK", "Bank")}
    assert plan(parties).count("between\\s*") == 3  # one search, and two groups read from its matches


def test_offsets_of_few_and_many_matches(spark):
    texts = [None, "", "none", "a1", "1a", "é𝒳1 22 b", "￿1 2￿", *("ab1" * n + "end" for n in (15, 16, 17, 200))]
    for r in docs_of(spark, *texts).select("text", match_spans("text", r"\d+", {"v": 0}).alias("m")).collect():
        assert (r.m is None) == (r.text is None)
        if r.text is not None:
            assert [(m.start, m.hit, m.v) for m in r.m] == [(m.start(), m[0], m[0]) for m in re.finditer(r"\d+", r.text)]


def test_quick_patterns_match_as_the_plain_ones(spark):
    plain = {
        P.LOOSE_PAGE_MARKER: r"(?iU)={10,}\s*\n\s*PAGE\s+(\d+)\s*\n\s*={10,}",
        P.AGREEMENT_DATES[0]: (r"(?iU)(?:dated\s+as\s+of|effective\s+(?:as\s+of|date(?:\s+of)?)|as\s+of|dated)\s+"
                               r"([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{4})"),
        P.AGREEMENT_DATES[1]: r"(?iU)this\s+\w+(?:\s+\w+)?\s*,?\s*dated\s+([A-Z][a-z]+\s+\d{1,2},?\s+\d{4})",
        P.NAMED_PARTY: (r"(?U)([A-Z][A-Z ,\.]{3,80}?)\s*\(\s*[*\"']\s*(?:the\s+)?"
                        r"([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]+)?)\s*[*\"']\s*\)"),
        P.BETWEEN_PARTIES: r"(?iU)between\s*\n\s*([A-Z][A-Z\s]{3,60}?)\s*\n\s*and\s*\n\s*([A-Z][A-Z\s]{3,80})",
        P.AMOUNT: r"(?iU)(EUR|USD|GBP|JPY|CHF|XDR)\s*(\d[\d,\.]+(?:\s*(?:million|billion))?)",
        P.REFERENCE_NUMBER: r"(?iU)(?:LOAN|PROJECT|CONTRACT|AGREEMENT)\s+(?:NUMBER|NO\.?|#|N°)\s*([A-Z0-9][\w\-]{2,20})",
    }
    rule = "=" * 9
    texts = [
        None, "", f"{rule}\nPAGE 1\n{rule}", f"x{rule}== \n page 2\n{rule}=y{rule}=====\n\n Page ٣ \n{rule}==", "dated as of May 1, 2020 aſ of June 2 2021",
        "DATED 1/2/2020 Effective date of 3-4-2021, effective as of July 4, 2020", "this loan agreement, dated May 1, 2020 thiſ deed dated June 2, 2020",
        'ALPHA CO., LTD ("the Borrower") x GAMMA (\'Bank\')', "A" * 82 + '("Bank")', "A" * 78 + "    " + ' \n ("Bank")', 'ABC ("Bank")ABCD ("Big Bank")(("X")',
        "between\nALPHA CO\nand\nBETA BANK\n BETWEEN \n alpha\nAND\nbeta", "eur 1,000 UſD 20.5 million gBp30 CHF4 XDR 12 jpy 5 billion",
        "Loan number LN-1 PROJECT NO. AB12 contract #x_9 Agreement N°123 loan no", "𝒳 loan # 123 é AGREEMENT NUMBER 77A",
    ]
    docs = docs_of(spark, *texts)
    spans = lambda p, n: match_spans("text", p, {f"g{k}": k for k in range(1, n + 1)})
    for quick, old in plain.items():
        groups = re.sub(r"\(\?|\\\(", "", old).count("(")
        rows = docs.select(spans(quick, groups).alias("a"), spans(old, groups).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
        assert any(r.a for r in rows)
    assert P.LOOSE_PAGE_MARKER.startswith("(?U)==========(?i)")


def test_programs_are_sought_only_where_their_words_stand(spark):
    texts = [
        "in support of the Borrower's Health Sector Program", "to carry out the Rural Road Programme", "the Water Supply Program for Results",
        "financing of the Second Port Program and the Third Port Program Investment", "the Fourth Port Program", None, "", "in support of nothing",
    ]
    found = extractors.extract_programs(docs_of(spark, *texts))
    assert {(r.doc_id, r.rank) for r in found.collect()} == {(0, 0), (1, 1), (2, 2), (3, 1), (3, 2)}
    assert all(f"Contains(text#{n}, {w})" in plan(found) for n in re.findall(r"Contains\(text#(\d+)", plan(found))[:1] for w in sum(P.PROGRAM_WORDS, []))


def test_long_texts_are_made_part_by_part_and_once(spark):
    docs = bindings.materialized(spark.range(3), F.concat(F.lit("a"), F.when(F.col("id") > 0, F.col("id").cast("string"))))
    assert [r.text for r in docs.orderBy("id").collect()] == [None, "a1", "a2"]
    assert plan(docs).count("lambdafunction(concat(") + plan(docs).count("lambdafunction(CASE") >= 1 and "Filter" not in plan(docs)


def test_few_whole_matches_are_placed_without_a_marked_text(spark):
    rule = "=" * 12
    loans = lambda n: "é𝒳 " + "".join(f"LOAN NO X{k % 7}0 loan # X00 x " for k in range(n))
    texts = [
        None, "", "none", loans(1), loans(8), loans(9), loans(200), "LOAN NUMBER LN-12 LOAN NUMBER LN-1 LOAN NUMBER LN-12", "\uffffLOAN NO AB12\uffff LOAN NO AB12",
        f"{rule}\nPAGE 1\n{rule}" * 3 + f" {rule}=\nPAGE 2\n{rule}", "USD 10USD 10USD 100 USD 10.5", "dated May 1, 2020 as of dated May 1, 2020",
        'ALPHA CO ("Bank") ALPHA CO x ALPHA CO ("Bank")', "in support of the Aaaaa Program in support of Aaaaa in support of Aaaaa Program",
        "the Fifth Port Program the Fifth Port Program for Results the Fifth Port Programme\n\nInvestment",
    ]
    docs = docs_of(spark, *texts)
    for p in sorted(P.WHOLE):
        rows = docs.select(match_spans("text", p, {"v": 1}, whole=True).alias("a"), match_spans("text", p, {"v": 1}).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
    marked = plan(docs.select(match_spans("text", P.REFERENCE_NUMBER, {"v": 1}, whole=True)))
    assert "regexp_extract_all" in marked and "<= 16" in marked
    assert "regexp_extract_all" in plan(extractors.extract_ids(docs)) and "regexp_extract_all" in plan(extractors.extract_programs(docs))
