"""Alignment against the libraries' own encoders on whole texts and plain loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("tokenizers")

import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from fieldloom.llm import alignment  # noqa: E402
from fieldloom.llm.shared import Scratch  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(alignment.A_PATH).exists(), reason="vocabulary files not present")
SCHEMA = "doc_id long, text string, row_id long, n_a string, pairs long, part string"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown fox can't jump over 12345 lazy dogs.", "Füße in Straßen, naïve café; 東京 とても 良い  two  blanks", "x", " ", "  lead and trail  ",
    "<|endoftext|> and <s> </s> <unk> <0x41> are plain text", "tabs\tand\nlines\r\n\n  indented\n", "emoji 👩‍👩‍👧 é combining é", "a▁piece mark", "\x00nul",
    "1" * 3000, "word " * 400, "end with space ", "don't they'll we've I'm he'd", "ZeroWidth​Join nbsp　wide", "The quick brown fox",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(alignment.A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    byte = alignment._byte_level()
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if not t.startswith("<|")}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        """[(a ids, b ids), …] and the links in order, or None."""
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        p, q = [a_bytes[i] for i in x], [b_bytes(i) for i in y]
        if b"".join(p) != (" " + text).encode() or b"".join(q) != (" " + text).encode():
            return None
        spans = lambda ids, parts: [(i, sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k, i in enumerate(ids)] if len(ids) < 900 else _fast(ids, parts)
        x, y = spans(x, p), spans(y, q)
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        found = [([], []) for _ in cuts]
        for side, tokens in enumerate((x, y)):
            k = 0
            for i, _, e in tokens:
                while cuts[k] < e:
                    k += 1
                found[k][side].append(i)
        links = [(i, j) for i, s, e in x for j, t, f in y if s < f and t < e] if len(x) < 900 else None
        return found, links

    return groups


def _fast(ids, parts):
    at, out = 0, []
    for i, p in zip(ids, parts):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def expected(plain, texts):
    found = [plain(t) for t in texts]
    docs = Counter(p for f in found if f for p in set(f[1]))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    rows = []
    for f in found:
        if not f:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = f
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(written(groups).encode()).hexdigest(),
        ))
    return rows


def short_texts():
    return [t[:600] for t in TEXTS] + [None, "", TEXTS[0], "b" * 300]


@pytest.fixture(scope="module")
def files(spark):
    return alignment.Files(spark, alignment.A_PATH, alignment.B_PATH)


def query(spark, tmp_path, texts):
    spark.createDataFrame([(k, t, 1, "x", 2, "y") for k, t in enumerate(texts)], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = alignment.op12_token_alignment(spark, str(tmp_path))
    assert found.columns == NAMES
    return [tuple(r)[1:] for r in sorted(found.collect())]


@pytest.mark.parametrize("many", [1 << 20, 20, 1])
def test_query_equals_plain_loops(spark, plain, monkeypatch, tmp_path, many):
    monkeypatch.setattr(alignment, "MANY", many)  # most pairs are joined rather than sent
    texts = short_texts()
    assert query(spark, tmp_path, texts) == expected(plain, texts)


@pytest.mark.parametrize("section", [5, 40, 300])
def test_sections_and_fragments_change_nothing(spark, plain, files, section):
    texts = [t for t in TEXTS if t]
    frame = spark.createDataFrame([(k, t, 1, "x", 2, "y") for k, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r for r in alignment.align(frame, files, section).collect()}
    for k, t in enumerate(texts):
        f = plain(t)
        assert found[k].groups == (written(f[0]) if f else "")
        assert found[k].n_links == (found[k].n_a + found[k].n_b - found[k].n_groups)
        if f and f[1] is not None:
            pairs = Counter(a << 16 | b for a, b in f[1])
            got = dict(zip(alignment.unpacked_sorted(found[k].pairs).tolist(), alignment.unpacked(found[k].times).tolist()))
            assert got == pairs


def test_sections_add_up_and_begin_with_a_space():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice("ab 1.é \n") for _ in range(200))
        parts = alignment.sections(text, 17)
        assert "".join(parts) == " " + text and all(p.startswith(" ") for p in parts)
    assert alignment.sections("a b c", 1, may_cut=False) == [" a b c"]


def test_composition_is_associative(files):
    tokenizers = alignment._tokenizers(files)
    aligner, rng = alignment.Aligner(tokenizers), random.Random(9)
    for text in [t for t in TEXTS if len(t) > 40]:
        sides = alignment._tokenized(tokenizers, " " + text)
        if sides is None:
            continue
        whole = aligner.one(sides)
        for size in (1, 3, 11, 50):
            parts = [alignment.Fragment.unpack(f.pack()) for f in alignment.fragments(aligner, sides, size)]
            while len(parts) > 1:  # any order of composition
                k = rng.randrange(len(parts) - 1)
                parts[k : k + 2] = [parts[k].then(parts[k + 1], aligner)]
            got = parts[0].whole(aligner)
            assert got[:5] == whole[:5]
            assert (got.pairs == whole.pairs).all() and (got.times == whole.times).all()


def test_empty_table_and_null_ids(spark, files, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align(empty, files).collect() == []
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert alignment.op12_token_alignment(spark, str(tmp_path)).collect() == []
    odd = spark.createDataFrame([(None, "same text", 1, "x", 2, "y")] * 2 + [(3, None, 1, "x", 2, "y")], SCHEMA)
    rows = alignment.align(odd, files)
    counts = {r.row_id: r for r in alignment.link_counts(rows, Scratch(spark, "test")).collect()}
    assert len(counts) == 3 and sorted(r.count_sum for r in counts.values())[0] == 0
    assert len({r.count_sum for r in counts.values()}) == 2  # repeated rows are two documents with equal results


def test_long_runs(files):
    tokenizers = alignment._tokenizers(files)
    for text in ("x" * 300_000, " " * 100_000, "1" * 100_000, "?" * 100_000):
        sides = alignment._tokenized(tokenizers, " " + text)
        assert sides is None or int(sides[0][1].sum()) == len(text) + 1


def test_missing_vocabulary_is_named(spark):
    with pytest.raises(FileNotFoundError, match="no-such-file"):
        alignment.Files(spark, "/no-such-file", alignment.B_PATH)


def test_lengths_are_those_of_the_bytes(files):
    tokenizers = alignment._tokenizers(files)
    assert tokenizers.cuts and np.array_equal(tokenizers.a_lengths, [len(t) for t in tokenizers.a_bytes])
