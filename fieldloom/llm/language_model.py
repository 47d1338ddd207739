"""Language-model scores: deleted interpolation of n-gram estimates.

An n-gram's estimate is its count over the count of its context. The estimates of all orders are mixed from the
longest down, each with a weight for the bucket of its context's count (powers of two): P_k = w·f_k + (1 - w)·P_(k-1),
and P_0 is uniform over the known tokens and one unknown one. The weights are learned by expectation-maximisation on the
tokens of a deleted part of the training documents, with estimates from which that part's counts are taken away.

How counts travel. Documents are cut into blocks of some megabytes (`token_blocks`). A block sends each distinct n-gram
once, with its count, as packed 64-bit hashes in stripes of the hash space (`requests`); so a word that every text holds
arrives once a block. A stripe adds up the counts and sends them back in the order they were asked for (`counted`).
Blocks and their answers meet in a cogroup by block (`scores`). All n-grams are counted; nothing is pruned.
Tokens are told apart by 64-bit hashes, longer n-grams by 56 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import shared
from fieldloom.llm.shared import Scratch

ORDER = 3
BLOCK_BYTES = 12 << 20  # of texts; bounds a task's memory unless one text is longer
STRIPE_TOKENS = 2 << 20  # of the corpus for each stripe; bounds a group's memory
DELETED = 25  # one training document in so many, by hash, teaches the weights
ROUNDS = 12
BUCKETS = 66  # bits of a count, and 0
START, END = (np.uint64(xxhash.xxh3_64_intdigest(mark)) for mark in (b" ", b"\n"))  # no word holds a blank
MASK = np.uint64(~0xFF & (1 << 64) - 1)  # longer n-grams travel as 56 bits: a byte less in every request
_MIX = np.uint64(0x9E3779B97F4A7C15)

BLOCK = "block long, deleted boolean, n_tokens long, n_trained long, n_docs long, doc_ids array<long>, held binary, lengths binary, words binary, tokens binary"
REQUEST = "size int, stripe long, block long, deleted boolean, keys binary, counts binary"
ANSWER = "block long, deleted boolean, size int, stripe long, distinct long, counts binary, gone binary"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


# ------------------------------------------------------------------------------ packing
def packed(a: np.ndarray) -> bytes:
    """Whole numbers, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return np.uint32(len(a)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    n = int(np.frombuffer(b[:4], np.uint32)[0])
    planes = np.frombuffer(pa.decompress(b[4:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.uint64)


def packed_sorted(a: np.ndarray) -> bytes:
    return packed(np.diff(a, prepend=np.uint64(0)))


def unpacked_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


# ------------------------------------------------------------------------------ blocks
def token_blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Documents as blocks of numbered tokens; those of the deleted part are in blocks of their own.

    Each document's tokens are its words, A-Z in lower case, and one end.
    """
    deleted = ~held_out & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(DELETED)) == 0)

    def block(number: int, part: bool, ids: list, held: list, hashes: list) -> tuple:
        flat, lengths = np.concatenate(hashes), np.array([len(h) for h in hashes])
        words, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
        frequent = np.argsort(-n, kind="stable")  # small numbers for frequent words
        rank = np.empty(len(words), np.int64)
        rank[frequent] = np.arange(len(words))
        train = ~np.array(held)
        return (
            number, part, len(flat), int(lengths[train].sum()), int(train.sum()), ids, np.packbits(held).tobytes(),
            packed(lengths), packed(words[frequent]), packed(rank[inverse]),
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_blocks = shared.task_serial(), {part: ([], [], [], [0]) for part in (False, True)}
        for batch in batches:
            for doc_id, text, held, part in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids, helds, hashes, size = open_blocks[part]
                ids.append(doc_id)
                helds.append(held)
                hashes.append(np.append(shared.word_hashes(shared.lower_words(text)), END))
                size[0] += len(text or "") + 16
                if size[0] >= BLOCK_BYTES:
                    yield _rows(BLOCK, [block(number, part, ids, helds, hashes)])
                    number, open_blocks[part] = number + 1, ([], [], [], [0])
        for part, (ids, helds, hashes, _) in open_blocks.items():
            if ids:
                yield _rows(BLOCK, [block(number, part, ids, helds, hashes)])
                number += 1

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held"), deleted.alias("deleted"))
    return rows.mapInArrow(cut, BLOCK)


class Block:
    """A block's tokens, read back."""

    def __init__(self, row: dict):
        self.number, self.deleted, self.ids = row["block"], row["deleted"], row["doc_ids"]
        self.lengths = unpacked(row["lengths"]).astype(np.int64)
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(self.ids)).astype(bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tokens = unpacked(row["words"])[unpacked(row["tokens"]).astype(np.int64)]

    def before(self, values: np.ndarray, first) -> np.ndarray:
        """The value of the token before each, ``first`` at the start of a text."""
        moved = np.empty_like(values)
        moved[1:] = values[:-1]
        moved[self.starts] = first
        return moved

    def grams(self, order: int) -> Iterator[np.ndarray]:
        """Hashes of the n-grams that end at each token, n from 1 to ``order``; texts begin with start marks."""
        keys, padding = self.tokens, START
        for size in range(order):
            yield keys & MASK if size else keys
            keys = shared.mixed(self.before(keys, padding) * _MIX + self.tokens)
            padding = shared.mixed(np.array([padding]) * _MIX + START)[0]


def _edges(stripes: int) -> np.ndarray:
    width = (1 << 64) // stripes
    return np.array([k * width for k in range(1, stripes)], np.uint64)


# ------------------------------------------------------------------------------ counts
def requests(blocks: DataFrame, order: int, stripes: int) -> DataFrame:
    """Each block's distinct n-grams with their counts in its training documents, a row per size and stripe."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(stripes)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                trained = np.repeat(~block.held, block.lengths)
                for size, keys in enumerate(block.grams(order), 1):
                    distinct, place = np.unique(keys, return_inverse=True)
                    counts = np.bincount(place, weights=trained, minlength=len(distinct)).astype(np.uint64)
                    cut = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
                    yield _rows(REQUEST, [
                        (size, s, block.number, block.deleted, packed_sorted(distinct[i:j]), packed(counts[i:j]))
                        for s, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i
                    ])

    return blocks.mapInArrow(ask, REQUEST)


def counted(asked: DataFrame) -> DataFrame:
    """The corpus's counts of each block's n-grams, in the order of their hashes; ``gone``: those of the deleted part."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [unpacked_sorted(r["keys"]) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpacked(r["counts"]) for r in rows])
        deleted = np.repeat([r["deleted"] for r in rows], [len(k) for k in keys])
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
        gone = np.bincount(place[deleted], weights=counts[deleted], minlength=len(distinct)).astype(np.uint64)
        at, out = 0, []
        for k, (r, own) in enumerate(zip(rows, keys)):
            here, at = place[at : at + len(own)], at + len(own)
            known = int((total > 0).sum()) if k == 0 else 0
            out.append((r["block"], r["deleted"], r["size"], r["stripe"], known, packed(total[here]), packed(gone[here]) if r["deleted"] else None))
        return pa.Table.from_batches([_rows(ANSWER, out)])

    return asked.groupBy("size", "stripe").applyInArrow(add, ANSWER)


def _answers(block: Block, answers: pa.Table, order: int, column: str) -> list[np.ndarray]:
    """For each size the corpus's count of the n-gram at each token."""
    by_size: dict[int, list] = {}
    for r in answers.select(["size", "stripe", column]).to_pylist():
        by_size.setdefault(r["size"], []).append((r["stripe"], r[column]))
    found = []
    for size, keys in enumerate(block.grams(order), 1):
        counts = np.concatenate([unpacked(c) for _, c in sorted(by_size[size])])
        found.append(counts[np.unique(keys, return_inverse=True)[1]].astype(np.float64))
    return found


def _estimates(block: Block, counts: list[np.ndarray], n_trained: float, n_docs: float) -> tuple[list, list]:
    """For each order the estimate of each token and the bucket of its context."""
    estimates, buckets = [], []
    context = np.full(len(block.tokens), float(n_trained))
    for k, c in enumerate(counts):
        if k:
            context = block.before(counts[k - 1], n_docs)
        estimates.append(np.divide(c, context, out=np.zeros_like(c), where=context > 0))
        buckets.append(np.frexp(context)[1].astype(np.uint8) if k else (context > 0).astype(np.uint8))
    return estimates, buckets


# ------------------------------------------------------------------------------ weights
def mixed_up(estimates: list, buckets: list, weights: np.ndarray, uniform: float) -> list[np.ndarray]:
    """P_0 … P_order of each token."""
    p = [np.full(len(estimates[0]), uniform)]
    for f, b, w in zip(estimates, buckets, weights):
        p.append(w[b] * f + (1 - w[b]) * p[-1])
    return p


def expected(estimates: list, buckets: list, weights: np.ndarray, uniform: float) -> np.ndarray:
    """Expectation step: for each order and bucket, how often its estimate is chosen, and how often it could be."""
    p, sums = mixed_up(estimates, buckets, weights, uniform), np.zeros((2, *weights.shape))
    reached = np.ones(len(p[0]))
    for k in range(len(estimates) - 1, -1, -1):
        chosen = reached * weights[k][buckets[k]] * estimates[k] / p[k + 1]
        sums[0, k] = np.bincount(buckets[k], weights=chosen, minlength=BUCKETS)
        sums[1, k] = np.bincount(buckets[k], weights=reached, minlength=BUCKETS)
        reached = reached - chosen
    return sums


def first_weights(order: int) -> np.ndarray:
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0.0  # a context that was never seen says nothing
    return weights


def maximised(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Maximisation step; a bucket without tokens takes the weight of the one below it."""
    out = weights.copy()
    for k in range(len(weights)):
        for b in range(1, BUCKETS):
            out[k, b] = min(sums[0, k, b] / sums[1, k, b], 1 - 1e-6) if sums[1, k, b] > 0 else out[k, b - 1] if b > 1 else weights[k, b]
    return out


def learned_weights(statistics: DataFrame, order: int, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of every order and bucket, from estimates and buckets of the deleted tokens; one small job a round."""
    weights = first_weights(order)
    for _ in range(rounds):
        now = weights

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, *now.shape))
            for batch in batches:
                for row in batch.to_pylist():
                    f = np.frombuffer(row["estimates"], np.float32).reshape(order, -1).astype(np.float64)
                    sums += expected(list(f), list(np.frombuffer(row["buckets"], np.uint8).reshape(order, -1)), now, uniform)
            k, b = np.nonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(sums[0, k, b]), pa.array(sums[1, k, b])], ["k", "b", "chosen", "reached"])

        found = statistics.mapInArrow(step, "k long, b long, chosen double, reached double").groupBy("k", "b").agg(F.sum("chosen"), F.sum("reached"))
        sums = np.zeros((2, *weights.shape))
        for k, b, chosen, reached in found.collect():  # at most order × BUCKETS rows
            sums[:, k, b] = chosen, reached
        weights = maximised(sums, weights)
        if np.abs(weights - now).max() < 1e-4:
            break
    return weights


# ------------------------------------------------------------------------------ scores
def interpolated_scores(docs: DataFrame, held_out: Column, spark: SparkSession | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    ``held_out`` (a condition on doc_id) names the documents that nothing is learned from; null counts as false.
    ``score`` is the interpolated model's log10 probability of the text and its end, ``base_score`` that of single
    tokens with half a count added.

    * Null, empty and blank texts are one end token. Long texts are scored whole. Repeated rows count and are scored
      each. Only doc_id and text are read. An empty table gives an empty result.
    * Without training documents every token is unknown: all scores are 0.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "language-model")
    blocks = scratch.keep(token_blocks(docs, F.coalesce(held_out, F.lit(False))))
    n = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (
        F.col("n_tokens"), F.col("n_trained"), F.col("n_docs"),
        F.when(F.col("deleted"), F.col("n_trained")), F.when(F.col("deleted"), F.col("n_docs")),
    )]).first()
    n_tokens, n_trained, n_docs, gone_tokens, gone_docs = n
    answers = scratch.keep(counted(requests(blocks, order, -(-n_tokens // STRIPE_TOKENS) or 1)))
    distinct = answers.filter("size = 1").agg(F.sum("distinct")).first()[0] or 0
    uniform = 1 / (distinct + 1)

    def statistics(block: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            b = Block(row)
            kept = [c - g for c, g in zip(_answers(b, found, order, "counts"), _answers(b, found, order, "gone"))]
            f, buckets = _estimates(b, kept, n_trained - gone_tokens, n_docs - gone_docs)
            out.append((np.float32(f).tobytes(), np.uint8(buckets).tobytes()))
        return pa.Table.from_batches([_rows("estimates binary, buckets binary", out)])

    taught = blocks.filter("deleted").groupBy("block").cogroup(answers.filter("deleted").groupBy("block"))
    weights = learned_weights(scratch.keep(taught.applyInArrow(statistics, "estimates binary, buckets binary")), order, uniform)

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            b = Block(row)
            counts = _answers(b, found, order, "counts")
            p = mixed_up(*_estimates(b, counts, n_trained, n_docs), weights, uniform)[-1]
            each = lambda values: np.add.reduceat(values, b.starts)  # noqa: E731  every text has a token
            base = np.log10((counts[0] + 0.5) / (n_trained + 0.5 * (distinct + 1)))
            out.append(pa.RecordBatch.from_arrays([
                pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.lengths), pa.array(each((counts[0] > 0).astype(np.int64))),
                pa.array(each(base)), pa.array(each(np.log10(p))),
            ], [c.split()[0] for c in SCORE.split(", ")]))
        return pa.Table.from_batches(out)

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORE)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_trained).cast("long").alias("train_tokens"), "base_score", "score")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return interpolated_scores(shared.table(spark, sf_dir, "documents"), held_out, spark)
