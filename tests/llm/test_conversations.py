"""The prefix trie against a plain enumeration of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fieldloom.llm import conversations
from fieldloom.llm.shared import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, depth long, key1 string, n long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def enumerated(paths):
    """Rows of the trie over {conv_id: [(role, text), …]}."""
    members = defaultdict(set)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        ends = ",".join(str(c) for c in sorted(c for c in own if len(paths[c]) == len(p)))
        rows.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children),
            sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows)


def ordered(rows):
    """Paths of rows whose turns do not tie but for equal ones."""
    paths = defaultdict(list)
    for c, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            paths[c].append((role or "", text or ""))
    return dict(paths)


def rebuilt(paths):
    found = {}
    for c, turns in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = paths.get(c - c % 5, [])[:h] + turns[h:]
    return found


def trie_rows(trie):
    digests = conversations.end_digests(trie.ends)
    rows = []
    shas = {(r.depth, r.key1, r.key2): r.ends_sha256 for r in digests.collect()}
    for r in trie.nodes.collect():
        ends = str(r.conv_id) if r.key1 is None and r.n_ends else ""
        sha = shas.get((r.depth, r.key1, r.key2)) or hashlib.sha256(ends.encode()).hexdigest()
        rows.append((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sha))
    return sorted(rows)


def some(seed, convs, longest, words):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        rows += [(c, t, rng.choice(["user", None, ""]), rng.choice(words), 7, "x", 9) for t in range(rng.randrange(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "longest", "segment"), [(1, 12, 1024), (2, 12, 3), (3, 40, 8)])
def test_trie_equals_enumeration(spark, monkeypatch, seed, longest, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = some(seed, 60, longest, ["a", "bé", None, "", "long text"] if seed < 3 else ["a"])
    rows += [(1000 + k, t, "system", "same") for k in range(70) for t in range(4)]
    rows = [tuple([*r, 7, "x", 9][:7]) for r in rows]
    trie = conversations.conversation_trie(spark.createDataFrame(rows, SCHEMA), spark)
    assert trie_rows(trie) == enumerated(ordered(rows))


def test_a_crowded_sketch_changes_nothing(spark, monkeypatch):
    rows = some(5, 80, 9, ["a", "b", "c", "d"])
    expected = enumerated(ordered(rows))
    monkeypatch.setattr(conversations, "LEAST_CELLS", 64)
    monkeypatch.setattr(conversations, "MOST_CELLS", 64)
    assert trie_rows(conversations.conversation_trie(spark.createDataFrame(rows, SCHEMA), spark)) == expected


def test_query_rebuilds_conversations(spark, tmp_path):
    rows = some(6, 90, 12, ["a", "b"])
    rows = [r for r in rows if r[0] not in (20, 25, 30)]  # families without their first conversation
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    paths = rebuilt(ordered(rows))
    assert any(not p for p in paths.values())  # some are left without turns
    found = conversations.op11_conversation_trie(spark, str(tmp_path))
    assert found.columns == NAMES
    assert sorted(map(tuple, found.collect())) == enumerated(paths)


def test_nulls_ties_repeats_and_negative_ids(spark):
    rows = [
        (None, 1, "user", "left out"), (3, None, "user", "first"), (3, 1, "user", "second"), (3, 1, "user", "second"),
        (-7, 1, None, None), (-7, 1, "b", "tie"), (-7, 1, "a", "tie"), (4, 0, "user", "x" * 100_000),
    ]
    trie = conversations.conversation_trie(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), spark)
    u = "user"
    paths = {3: [(u, "first"), (u, "second"), (u, "second")], -7: [("", ""), ("a", "tie"), ("b", "tie")], 4: [(u, "x" * 100_000)]}
    assert trie_rows(trie) == enumerated(paths)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.op11_conversation_trie(spark, str(tmp_path)).collect() == []


def test_many_ids_end_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(conversations, "IDS", 3)  # joined eight at a time
    rows = [(c, 0, "user", "same", 1, "x", 2) for c in range(-20, 300, 3)]
    trie = conversations.conversation_trie(spark.createDataFrame(rows, SCHEMA), spark)
    assert trie_rows(trie) == enumerated(ordered(rows))


def test_long_conversations_are_cut_into_bounded_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(conversations, "SEGMENT", 16)
    rows = [(1, t, "user", f"t{t}", 1, "x", 2) for t in range(500)] + [(2, 0, "user", "t0", 1, "x", 2)]
    segments = conversations.numbered_segments(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test"))
    assert max(len(r.turns) for r in segments.collect()) == 16
    assert segments.filter("conv_id = 1").count() == 32
