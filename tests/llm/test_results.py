"""Operators against brute force on small tables."""

import hashlib
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from fieldloom.llm import contamination, fingerprints, html_text, jaccard, licenses, mixing, pii, queries, substrings, token_counts, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="tables not present")


def lower(text):
    return (text or "").encode().lower().split()


def grams(text, width=5):
    w = lower(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@needs_data
@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    message, good = compare.compare(spark, compare.connect(DATA), name, queries.QUERIES[name], queries.ORACLES[name], DATA)
    assert good, message


# ------------------------------------------------------------------------------ 1
def test_pii_kinds_and_masking(spark):
    texts = [
        "mail a.b@x.co.uk, 10.0.0.255 and 256.1.1.1; card 4111 1111 1111 1111 bad 4111 1111 1111 1112 tel +49 (30) 1234567",
        "account IBAN DE89 3704 0044 0532 0130 00 LATER", "visa 378282246310005", "378282246310005", "é a@b.c..d@e.f", "1.2.3.4.5.6.7.8",
    ]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    kinds = {r.doc_id: [(s.kind, s.hit if s.kind != "email" else texts[r.doc_id][s.start : s.end]) for s in r.pii] for r in found.collect()}
    assert kinds[0] == [("email", "a.b@x.co.uk"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")]
    assert kinds[1] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds[2] == [("card_short", "378282246310005")] and kinds[3] == []
    assert kinds[4] == [("email", "a@b.c"), ("email", "..d@e.f")]
    assert [k for k, _ in kinds[5]] == ["ip", "ip"]
    masked = found.select(pii.masked(found.text, found.pii).alias("t")).collect()
    assert masked[1].t == "account IBAN [IBAN] LATER" and masked[3].t == texts[3]


def test_accounts_beside_one_another(spark):
    texts = [
        "DE89370400440532013000 GB82WEST12345698765432", "REF AB12 DE89 3704 0044 0532 0130 00", "IBANDE89370400440532013000",
        "GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00 FR1420041010050500013M02606", "REF AB12 DE89 3704 0044 0532 0130 01",
    ]
    want = [
        ["DE89370400440532013000", "GB82WEST12345698765432"], ["DE89 3704 0044 0532 0130 00"], ["DE89370400440532013000"],
        ["GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606"], [],
    ]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [s.hit for s in r.pii if s.kind == "iban"] for r in found} == dict(enumerate(want))
    assert all(texts[r.doc_id][s.start : s.end] == s.hit for r in found for s in r.pii)


# ------------------------------------------------------------------------------ 2
def some_words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))


def removed(spark, rows):
    return {r.doc_id: r for r in substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_repeated_passages_leave_once(spark):
    passage = " ".join(f"{some_words(k, 8)}." for k in range(8))
    rows = [(1, f"Alpha beta. {passage} Gamma delta."), (2, f"Other start here.\n{passage}\nOther end."), (3, "Nothing is shared. Not here. Nor here. Or there.")]
    got = removed(spark, rows)
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Other start here.\nOther end." and got[2].n_removed == 8


def test_a_passage_of_two_sentences_leaves(spark):
    passage = f"{some_words(1, 31)}. {some_words(2, 31)}."
    got = removed(spark, [(1, f"One start. {passage} One end."), (2, f"Another start. {passage} Another end."), (3, f"{passage}")])
    assert got[1].n_removed == 0
    assert got[2].text == "Another start. Another end." and got[3].text == ""


def test_a_passage_inside_long_sentences_leaves_but_for_its_edges(spark):
    passage = ", ".join(some_words(10 + k, 9) for k in range(7))  # 63 words without an end mark
    got = removed(spark, [(1, f"{some_words(20, 5)} {passage} {some_words(21, 5)}"), (2, f"{some_words(22, 3)} {passage} {some_words(23, 14)}")])
    assert got[1].n_removed == 0 and len(got[2].text.split()) <= 3 + 14 + 2 * substrings.PIECE


def test_short_lines_stay_however_often_they_repeat(spark):
    lines = "First short line.\nSecond one here too.\nThird and last.\n"
    rows = [(k, f"{some_words(k, 40)}.\n{lines}{some_words(1000 + k, 40)}.") for k in range(20)]
    got = removed(spark, rows)
    assert all(got[k].text == t and got[k].n_removed == 0 for k, t in rows)


def test_marks_without_words_are_no_run(spark):
    got = removed(spark, [(1, "Some text here . . . . and more."), (2, "Wholly other words . . . . to the end.")])
    assert got[1].n_removed == got[2].n_removed == 0


@needs_data
def test_pieces_add_up(spark):
    assert all("".join(substrings.pieces(r.text or "")) == (r.text or "") for r in documents(spark).collect())
    assert substrings.pieces("a " * 30)[0] == "a " * substrings.PIECE


# ------------------------------------------------------------------------------ 3
@needs_data
def test_fingerprints(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in documents(spark).collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op3_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(rows)
    errors = []
    for (i, text), (_, other) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edit = text[: len(text) - third] + other[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        a, b = grams(text), grams(edit)
        errors.append(abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1)))
    assert sum(errors) / len(errors) < 0.05
    by_text = defaultdict(set)
    for i, text in rows:
        by_text[text].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_containment_of_unequal_texts(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(9000)]
    frame = spark.createDataFrame([(" ".join(words[:1500]), " ".join(words))], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    r = frame.select(fingerprints.containment(a, b).alias("c"), fingerprints.containment(b, a).alias("d"), (fingerprints.merged(a, b)["hashes"] == b["hashes"]).alias("m")).first()
    assert r.c == 1.0 and abs(r.d - 1 / 6) < 0.05 and r.m


# ------------------------------------------------------------------------------ 4
def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = random.Random(3)
    odds = np.exp(np.array([rng.uniform(-2, 2) for _ in range(7)]))
    starts, ends, trans = np.array([0, 3, 3]), np.array([3, 3, 7]), np.array([[0.3, -0.4], [-0.2, 0.9]])
    p, moves = toxicity.marginals(odds, starts, ends, trans, True)
    want, want_moves = np.zeros(7), np.zeros((2, 2))
    for i, j in zip(starts, ends):
        total, part, counts = 0.0, np.zeros(j - i), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=j - i):
            w = np.prod([odds[i + k] if s else 1.0 for k, s in enumerate(y)]) * np.exp(sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            part += w * np.array(y)
            for a, b in zip(y, y[1:]):
                counts[a, b] += w
        want[i:j] = part / total if j > i else 0
        want_moves += counts / total
    assert np.allclose(p, want) and np.allclose(moves, want_moves)


def test_toxic_texts_are_told_apart():
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(300)]

    def text(bad):
        w = [rng.choice(plain) for _ in range(60)]
        for _ in range(3 * bad):
            w[rng.randrange(60)] = rng.choice(["scoundrel", "rotter", "blighter", "cadbury1", "cadbury2", "cadbury3"])
        return " ".join(w)

    label = [i % 2 for i in range(300)]
    field = toxicity.fit([text(y) for y in label], label)
    test = [text(i % 2) for i in range(100)]
    scores, spans = toxicity.tag(field, test)
    assert sum((s >= 0.5) == bool(i % 2) for i, s in enumerate(scores)) >= 95
    assert all(test[i][s["start"] : s["end"]][:4] in ("scou", "rott", "blig", "cadb") for i in range(1, 100, 2) for s in spans[i])
    assert toxicity.fit(["a"], [0]).scores(toxicity.Field().documents(*map(__import__("numpy").array, ([0.1], [0], [1]))))[0] < 0.01


# ------------------------------------------------------------------------------ 5
def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([12, 12, 30, 45, 60, 4])]
    rows = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 90))]
        if d % 3 == 0:
            leak = items[d // 3 % 6][1].split()
            if d % 2 and len(leak) > 20:
                leak[3] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
        rows.append((d, " ".join(w)))
    got = {(r.doc_id, r.item_id): r.similarity for r in contamination.find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in rows:
        w = text.split()
        for i, item in items:
            m = item.split()
            if len(m) < 5 or len(w) < 5:
                continue
            g, b = [tuple(w[k : k + 5]) for k in range(len(w) - 4)], Counter(tuple(m[k : k + 5]) for k in range(len(m) - 4))
            size = len(m) - 4
            best = max(sum((Counter(g[s : s + size]) & b).values()) / sum((Counter(g[s : s + size]) | b).values()) for s in range(max(1, len(g) - size + 1)))
            if best >= 0.75:
                want[d, i] = round(best, 6)
    assert got == want and len(want) >= 15


def test_leaks_with_one_edited_word_are_all_found(spark):
    rng = random.Random(55)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(39))) for i in range(300)]
    rows = []
    for i, text in items:
        w = text.split()
        w[5 + i % 29] = "edited"  # 5 of 35 shingles differ: similarity 30 / 40
        rows.append((i, " ".join(w)))
    got = contamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity) for r in got} == {(i, i, 0.75) for i, _ in items}


def test_blocks_of_fingerprints_find_all_pairs_within_the_radius(spark):
    rng = random.Random(56)
    sims = [rng.getrandbits(64) for _ in range(12)]
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    probes = [(signed(flipped(x, n)), 7 + n % 2) for x in sims for n in (0, 1, 23, 24, 25, 26, 40, 64)]
    windows = spark.createDataFrame([(k, m, k % 5, x) for k, (x, m) in enumerate(probes)], "row_hash long, m int, start int, sim long")
    bench = spark.createDataFrame([(k, 7 + k % 2, signed(x)) for k, x in enumerate(sims)], "item_id long, m int, sim long")
    got = [(r.row_hash, r.item_id) for r in contamination.near_items(windows, bench).collect()]
    want = [(k, i) for k, (x, m) in enumerate(probes) for i, y in enumerate(sims) if m == 7 + i % 2 and ((x ^ y) & (2**64 - 1)).bit_count() <= 24]
    assert sorted(got) == sorted(want) and len(want) > 12


def test_leaks_come_through_the_index(spark, monkeypatch):
    sought = []
    near = contamination.near_items
    monkeypatch.setattr(contamination, "near_items", lambda *a: sought.append(near(*a)) or sought[-1])
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "a b " + words + " c"), (2, "nothing of it at all here")], "doc_id long, text string")
    got = contamination.find_leaks(docs, spark.createDataFrame([(7, words)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.hamming, r.similarity) for r in got] == [(1, 7, 2, 0, 1.0)]
    assert (7, 2) in {(r.item_id, r.start) for r in sought[0].collect()}


# ------------------------------------------------------------------------------ 6
@pytest.mark.parametrize("html, want", [
    ("<nav><a href=x>Home</a></nav><article><header><h1>Head</h1></header><p>One &amp; two<br>three.<p>Hm.</article><footer>(c)</footer>", "Head One & two three. Hm."),
    ("<div id=menu>x</div><div id=c><h2>T</h2><div><p>Long text of some length here.</p><p class='ad'>Buy</p><p>End.</p></div></div>"
     "<div class='comments'><p>Great article, thank you so much</p></div>", "T Long text of some length here. End."),
    ("<script>var a='</p>';</script><style>p{}</style>", ""), ("<p>open <b>bold <p>next", "open bold next"), ("", ""), (None, ""),
])
def test_main_text(html, want):
    assert html_text.main_text(html) == want


# ------------------------------------------------------------------------------ 7
def test_piece_counts_equal_greedy_matching():
    rng = random.Random(7)
    vocabulary = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    known = set(vocabulary) | {bytes([b]) for b in range(256)}
    automaton = token_counts.LongestMatch(vocabulary)
    for _ in range(500):
        s = bytes(rng.choice(b"ab cd") for _ in range(rng.randrange(0, 30)))
        at = n = 0
        while at < len(s):
            at += next(k for k in range(6, 0, -1) if at + k <= len(s) and s[at : at + k] in known)
            n += 1
        assert automaton.pieces(s) == n


# ------------------------------------------------------------------------------ 8
def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 60), f"s{rng.randrange(3)}" if rng.random() < 0.6 else rng.choice(["a", None])) for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 3000
    source, size, taken = {i: s for i, _, s in rows}, Counter(), Counter()
    for r in got:
        assert r["size"] == len(rows[r.doc_id][1].split()) and 0 <= r.copies <= 3
        size[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rest = (total - sum(3 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in order if s not in capped and rest * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    want = {s: 3 * size[s] if s in capped else rest * weight[s] for s in order}
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * total and r.source_size == size[source[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 60 for s in order)
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


# ------------------------------------------------------------------------------ 9
def brute_components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, grams(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i)) for i, s in sets}


@needs_data
def test_components_of_documents(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op9_ngram_jaccard_join"](spark, DATA).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in documents(spark).collect()])


def test_components_of_large_loose_groups(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(2000)]
    rows = []
    for base in range(2):
        text = [rng.choice(vocab) for _ in range(150)]
        for _ in range(90):  # more than SMALL, edits spread around what a link allows
            w = list(text)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, rows[k][1]) for k in range(20)] + [(300, "short text"), (301, "Short  TEXT"), (302, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


# ------------------------------------------------------------------------------ 10
def test_license_labels(spark):
    texts = [
        "Code.\nReleased under the MIT License.\nUnder the MIT-license!", "This work is licensed under the GNU General Public License, version 3.",
        "permission is granted to no one; license copy software", "apache license, version 2 cc by nc", "plain text", "ünder the mit license",
    ]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in got}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels) == (10, 2, 2, 6, ["mit"])
    assert got[1].labels == ["gpl-3"] and got[1].base_labels == [] and got[1].score >= 0.5
    assert got[2].labels == [] and got[2].score == 0
    assert got[3].base_labels == ["apache-2", "cc-by-nc"] and (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 4)
    assert got[4].labels == [] and got[5].n_base == 0


def test_licenses_of_texts_with_many_notices(spark):
    notice = {label: text for label, text, _ in licenses.TEMPLATES}  # the last, mostly longest notice of each label
    files = [list(notice), ["gpl-3", "bsd"], ["mit", "gpl-3"], ["mit", "apache-2", "gpl-3", "bsd", "mpl-2", "isc", "unlicense", "cc0"]]
    texts = ["\n\n".join(f"Part {k} of the bundle.\n{notice[label]}" for k, label in enumerate(f)) for f in files]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels = {r.doc_id: r.labels for r in got}
    assert all(set(f) <= set(labels[k]) for k, f in enumerate(files)) and labels[1] == ["bsd", "gpl-3"]


# ------------------------------------------------------------------------------ pipeline
@needs_data
def test_pipeline_keeps_what_it_should(spark):
    docs, kept = {r.doc_id: r for r in documents(spark).collect()}, corpus_pipeline.run(spark, DATA).collect()
    groups = brute_components([(i, r.text) for i, r in docs.items()])
    assert kept and all(groups[r.doc_id][1] is not None for r in kept)
    assert len({groups[i][1] for i in {r.doc_id for r in kept}}) == len({r.doc_id for r in kept})  # one of each group
    assert all(r.n_chars == len(r.text) and 1 <= r.copy <= 3 for r in kept)
    leaks = {r.doc_id for r in queries.QUERIES["op5_benchmark_decontamination"](spark, DATA).collect()}
    assert leaks and not leaks & {r.doc_id for r in kept}
