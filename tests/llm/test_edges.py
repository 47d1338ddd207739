"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import contamination, fingerprints, html_text, jaccard, licenses, mixing, pii, substrings, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, pii string, row string, words string, tokens string"
LONG = "lorem ipsum dolor sit amet. " * 9000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old mill"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG),
    (None, "a text without a number"), (None, None), (6, "1" * 20000 + "@" * 300 + "." * 300 + "a.b" * 9000), (7, "\x00\x01 \U0001f600 é"),
]
ITEMS = "item_id long, text string"
OPERATORS = {
    "pii": lambda d, s: pii.find_pii(d),
    "substrings": lambda d, s: substrings.drop_repeats(d, s),
    "fingerprints": lambda d, s: fingerprints.fingerprints(d, 4),
    "contamination": lambda d, s: contamination.find_leaks(d, s.createDataFrame([(1, "ipsum dolor sit amet. lorem ipsum dolor"), (2, None), (3, "x")], ITEMS), s),
    "html": lambda d, s: html_text.extract_text(d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "text")),
    "tokens": lambda d, s: token_counts.count_tokens(d, [b" a", b"th", b"the"], s),
    "mixing": lambda d, s: mixing.mix_sources(d, s),
    "jaccard": lambda d, s: jaccard.jaccard_components(d, s),
    "licenses": lambda d, s: licenses.scan_licenses(d, s),
    "toxicity": lambda d, s: toxicity.score_toxicity(d, toxicity.fit([], []), s),
}
PER_ROW = set(OPERATORS) - {"contamination"}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if i == 1 else "s", None, 0.5, 9, "x", None, "w", "t") for i, t in ROWS], SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    rows = OPERATORS[name](odd, spark).collect()
    assert len(rows) == (len(ROWS) if name in PER_ROW else 1)


def by_id(rows, of):
    """Values of the rows with an id, all of an id's rows together."""
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(of(r))
    return found


def test_values_of_odd_rows(spark, odd):
    run = lambda name: OPERATORS[name](odd, spark).collect()
    groups = by_id(run("jaccard"), lambda r: (r.n_shingles, r.component_id))
    assert groups[2] == {(0, 2)} and groups[3] == {(0, 3)} and groups[4] == {(0, 4)}  # null, empty and blank link with nothing
    assert len(groups[5]) == 1 and next(iter(groups[5]))[1] == 5  # repeated rows are one document
    assert groups[None] == {(1, None), (0, None)} and groups[7] == {(1, 7)}
    kept = by_id(run("substrings"), lambda r: (r.text, r.n_removed > 0))
    assert kept[2] == kept[3] == {("", False)} and kept[4] == {(" \n\t ", False)}
    assert kept[1] == {(ROWS[0][1], False)} and len(kept[5]) == 1 and len(next(iter(kept[5]))[0]) < len(LONG)  # a text that repeats itself
    taken = by_id(run("mixing"), lambda r: (r.size, r.taken))
    assert taken[2] == taken[3] == taken[4] == {(0, 0)} and len(taken[5]) == 1
    assert all(t in {k * n for k in range(4)} for rows in taken.values() for n, t in rows)
    tokens = by_id(run("tokens"), lambda r: (r.n_words, r.n_tokens))
    assert tokens[2] == tokens[3] == tokens[4] == {(0, 0)} and len(tokens[5]) == 1
    notices = by_id(run("licenses"), lambda r: (r.n_words, r.n_base, tuple(r.labels)))
    assert notices[2] == notices[3] == notices[4] == {(0, 0, ())} and notices[5] == {(45_000, 0, ())}
    pages = {r.page_id: r.text for r in run("html")}
    assert pages[2] == pages[3] == pages[4] == "" and pages[1] == ROWS[0][1]
    found = by_id(run("pii"), lambda r: tuple(s.kind for s in r.pii))
    assert found[1] == found[2] == found[3] == {()}
    leaks = run("contamination")
    assert [(r.doc_id, r.item_id, r.start_word) for r in leaks] == [(5, 1, 1)]


def test_two_texts_under_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f g h"), (5, "p q r s t u v w"), (7, "a b c d e f g h"), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = by_id(jaccard.jaccard_components(docs, spark).collect(), lambda r: r.component_id)
    assert groups == {5: {5}, 7: {5}, 9: {9}}
    kept = corpus_pipeline.deduplicate(spark, docs, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, "a b c d e f g h"), (5, "p q r s t u v w"), (9, None)], key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd, name):
    assert OPERATORS[name](odd.limit(0), spark).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd):
    made = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 0), (2, 1), (None, None)], "doc_id long, toxic int").write.parquet(f"{made}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g"), (2, None)], ITEMS).write.parquet(f"{made}/benchmark.parquet")
    return made


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, folder)
    assert out.columns == (odd.columns if name != "mix" else [*odd.columns, "copy"])
    assert len(out.collect()) >= 1
    assert stage(spark, odd.limit(0), folder).collect() == []


def test_stages_are_four_or_five():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run


def test_rows_are_chosen_and_made_single_in_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 7, "b"), (2, 5, "c"), (3, 4, "d"), (4, 4, "e"), (4, 4, "e")], "doc_id long, n int, tokens string")
    those = spark.createDataFrame([(1, 5), (3, 5), (4, 4), (4, 9)], "doc_id long, n int")
    single = jaccard._only(rows, those)
    assert sorted(tuple(r) for r in single.collect()) == [(1, 5, "a"), (4, 4, "e")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard._only(rows, those)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # the rows, and the keys that they meet
