"""Scores of the interpolated language model against plain dictionaries of n-grams."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import language_model as lm

SCHEMA = "doc_id long, text string, n_tokens long, score double, block long, words string"
HELD = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 1"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 9, 0.5, 3, "x") for i, t in rows], SCHEMA)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["Rare", "É", "The", "THE"]
    return [(k, " ".join(rng.choices(words, weights=range(16, 0, -1), k=rng.randrange(0, 30)))) for k in range(n)]


def plain_counts(rows, order):
    counts = [Counter() for _ in range(order)]
    for i, text in rows:
        t = [" "] * (order - 1) + tokens(text)
        for k in range(order):
            counts[k].update(tuple(t[j - k : j + 1]) for j in range(order - 1, len(t)))
    return counts


def plain_score(text, counts, n, docs, weights, order):
    t, total = [" "] * (order - 1) + tokens(text), 0.0
    for j in range(order - 1, len(t)):
        p = 1 / (len(counts[0]) + 1)
        for k in range(order):
            context = n if k == 0 else docs if t[j - 1] == " " else counts[k - 1][tuple(t[j - k : j])]
            bucket = int(context > 0) if k == 0 else int(context).bit_length()
            f = counts[k][tuple(t[j - k : j + 1])] / context if context else 0
            p = weights[k][bucket] * f + (1 - weights[k][bucket]) * p
        total += math.log10(p)
    return total


@pytest.mark.parametrize(("order", "small"), [(1, False), (2, True), (3, False), (3, True)])
def test_scores_equal_plain_counts(spark, monkeypatch, order, small):
    learned = []
    monkeypatch.setattr(lm, "DELETED", 4)
    if small:  # many blocks and stripes
        monkeypatch.setattr(lm, "BLOCK_BYTES", 400)
        monkeypatch.setattr(lm, "STRIPE_TOKENS", 200)
    plain = lm.learned_weights
    monkeypatch.setattr(lm, "learned_weights", lambda *a: learned.append(plain(*a)) or learned[-1])
    rows = corpus(order, 80)
    found = lm.interpolated_scores(frame(spark, rows), F.expr(HELD), spark, order).collect()
    train = [r for r in rows if not held(r[0])]
    counts = plain_counts(train, order)
    n, v = sum(counts[0].values()), len(counts[0])
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows)[r.doc_id]
        t = tokens(text)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(t), n)
        assert r.n_known == sum(counts[0][(w,)] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((counts[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r.score == pytest.approx(plain_score(text, counts, n, len(train), learned[0], order))


def test_probabilities_of_all_next_tokens_add_up_to_one():
    rows = corpus(7, 40)
    counts, order = plain_counts(rows, 3), 3
    weights = np.random.default_rng(1).uniform(0.1, 0.9, (3, lm.BUCKETS))
    weights[:, 0] = 0
    n = sum(counts[0].values())
    known = [w for (w,) in counts[0] if w != "\n"]
    # One step after "w0 w1": the end, every known word, and one unknown one.
    before = plain_score("w0 w1", counts, n, len(rows), weights, order) - plain_score_end(counts, n, len(rows), weights)
    after = [plain_score_prefix(f"w0 w1 {w}", counts, n, len(rows), weights) for w in [*known, "unknown"]]
    end = plain_score("w0 w1", counts, n, len(rows), weights, order)
    assert sum(10**x for x in [*after, end]) == pytest.approx(10**before)


def plain_score_prefix(text, *model):
    """Without the end token's probability."""
    words = text.split()
    return plain_score(text, *model, 3) - _end(words, *model)


def plain_score_end(*model):
    return _end(["w0", "w1"], *model)


def _end(words, counts, n, docs, weights):
    t = [" ", " ", *words, "\n"]
    j, p = len(t) - 1, 1 / (len(counts[0]) + 1)
    for k in range(3):
        context = n if k == 0 else counts[k - 1][tuple(t[j - k : j])]
        bucket = int(context > 0) if k == 0 else int(context).bit_length()
        f = counts[k][tuple(t[j - k : j + 1])] / context if context else 0
        p = weights[k][bucket] * f + (1 - weights[k][bucket]) * p
    return math.log10(p)


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(3)
    f = [rng.uniform(0, 0.2, 500) * (rng.random(500) > 0.4) for _ in range(2)]
    buckets = [np.ones(500, np.uint8), rng.integers(0, 4, 500).astype(np.uint8)]
    f[1][buckets[1] == 0] = 0
    weights, scores = lm.first_weights(2), []
    for _ in range(8):
        scores.append(np.log(lm.mixed_up(f, buckets, weights, 0.01)[-1]).sum())
        weights = lm.maximised(lm.expected(f, buckets, weights, 0.01), weights)
    assert all(b >= a - 1e-9 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0]
    assert (weights[:, 0] == 0).all() and (weights < 1).all()


def test_held_out_texts_score_better_than_the_base(spark):
    rng = random.Random(1)
    follows = {k: rng.sample(range(40), 3) for k in range(40)}
    rows = []
    for i in range(300):
        k, words = rng.randrange(40), []
        for _ in range(30):
            words.append(f"t{k}")
            k = rng.choice(follows[k])
        rows.append((i, " ".join(words)))
    found = [r for r in lm.interpolated_scores(frame(spark, rows), F.expr(HELD), spark).collect() if r.held_out]
    assert sum(r.score for r in found) > 0.6 * sum(r.base_score for r in found)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "a b"), (None, "a c"), (None, None), (5, "a " * 40_000), (6, "\x00 \U0001f600")]
    found = sorted(lm.interpolated_scores(frame(spark, rows), F.expr(HELD), spark).collect(), key=str)
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert [by_id[i].n_tokens for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 1, 3, 40_001, 3]
    assert by_id[1].score == by_id[2].score == by_id[3].score and by_id[1].held_out == held(1)
    assert len({r.score for r in found if r.doc_id == 4}) == 1
    assert all(r.score < 0 and r.base_score < 0 for r in found)


def test_empty_and_untrained(spark):
    assert lm.interpolated_scores(frame(spark, []), F.expr(HELD), spark).collect() == []
    found = lm.interpolated_scores(frame(spark, [(1, "a b"), (2, None)]), F.lit(True), spark).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(0, 0, 0.0, 0.0)] * 2


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        assert (lm.unpacked(lm.packed(a)) == a).all()
        assert (lm.unpacked_sorted(lm.packed_sorted(np.sort(a))) == np.sort(a)).all()
