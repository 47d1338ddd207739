"""Toxic spans and scores: a two-state linear-chain conditional random field over tokens.

Token labels come from labelled documents: a token is toxic if its document is and its word, or one of the
word's beginnings, stands in many more toxic than clean documents of the sample. The field sees each token's
word, beginnings and ending and its neighbours' beginnings. Forward-backward marginals give offending tokens with
their offsets; a logistic layer over their sum, maximum and share gives the document score.

Fitting takes at most FIT_DOCS labelled documents per class, chosen by hash among the rows that are not held out;
the fitted field is a few arrays of fixed size, sent to all executors. Scoring is one pass over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm import shared

FIT_DOCS = 600  # labelled documents of each class that the field is fitted on
SLOTS = 1 << 16  # weights of hashed features
OWN = 4  # features of a token itself: word, beginnings of four and five bytes, ending
STEPS = 40
FOLDS = 5
EVIDENCE = 20.0  # log-likelihood ratio from which on a feature marks the tokens of toxic documents
SLICE = 2_000_000  # characters that are tagged together
STRIP = b".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~`^@"
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[int]:
    w = word.strip(STRIP) or word
    return [xxhash.xxh3_64_intdigest(p) % SLOTS for p in (b"w" + w, b"4" + w[:4], b"5" + w[:5], b"e" + w[-4:])]


class Words:
    """Numbers for distinct words of a batch, with their features."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}

    def number(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))

    def features(self) -> np.ndarray:
        return np.array([features(w) for w in self.ids] or np.zeros((0, OWN)), np.int64).reshape(-1, OWN)


def neighbours(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next token's word number, -1 at a document's edges."""
    before, after = np.r_[-1, ids[:-1]], np.r_[ids[1:], -1]
    before[starts[ends > starts]] = -1
    after[ends[ends > starts] - 1] = -1
    return before, after


def marginals(odds: np.ndarray, starts: np.ndarray, ends: np.ndarray, trans: np.ndarray, transitions: bool = False):
    """P(toxic) of every token, and on demand the expected transitions (2×2); all documents advance together, step by step.

    odds: exp of a token's own score. The recursions run on ratios toxic : clean, which cannot underflow.
    """
    length = ends - starts
    last = ends[length > 0] - 1
    order = np.argsort(-length, kind="stable")
    first, length = starts[order], length[order]
    t = np.exp(trans)
    forward, backward = np.empty(len(odds)), np.ones(len(odds))
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for step, k in enumerate(active):
        at = first[:k] + step
        if step:
            r = forward[at - 1]
            forward[at] = odds[at] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
        else:
            forward[at] = odds[at]
    for step in range(len(active) - 2, -1, -1):
        at = first[: active[step + 1]] + step
        ahead = odds[at + 1] * backward[at + 1]
        backward[at] = (t[1, 0] + t[1, 1] * ahead) / (t[0, 0] + t[0, 1] * ahead)
    both = forward * backward
    p = both / (1 + both)
    if not transitions:
        return p, None
    inner = np.ones(len(odds), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    ahead = odds[at + 1] * backward[at + 1]
    w = np.stack([np.full(len(at), t[0, 0]), t[0, 1] * ahead, forward[at] * t[1, 0], forward[at] * t[1, 1] * ahead])
    return p, (w / w.sum(0)).sum(1).reshape(2, 2)


class Field:
    """Weights of own and neighbouring features, a bias, transitions, and the document layer."""

    def __init__(self) -> None:
        self.own = np.zeros(SLOTS)
        self.near = np.zeros((2, SLOTS))
        self.bias, self.trans = np.array([-4.0]), np.zeros((2, 2))
        self.layer, self.prior = np.zeros(4), 0.0

    def odds(self, f: np.ndarray, ids: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        own = self.own[f].sum(1)[ids] if len(f) else np.zeros(0)
        sides = [np.r_[w[f[:, 1]], 0.0][x] for w, x in zip(self.near, (before, after))]
        return np.exp(np.clip(own + sides[0] + sides[1] + self.bias[0], -30, 30))

    def documents(self, p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Per document: log of the expected toxic tokens, largest marginal, root of their share, one."""
        length = np.maximum(ends - starts, 1)
        total = np.r_[0.0, np.cumsum(p)]
        expected = np.maximum(total[ends] - total[starts], 0)
        top = np.zeros(len(starts))
        some = ends > starts
        if some.any():
            top[some] = np.maximum.reduceat(p, starts[some])
        return np.stack([np.log1p(expected), top, np.sqrt(expected / length), np.ones(len(starts))], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.layer, -30, 30)))


def _laid_out(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    words = Words()
    parts = [words.number(shared.lower_words(t)) for t in texts]
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return words, ids, ends - np.array([len(p) for p in parts], np.int64), ends


def _adam(weights: list[np.ndarray], steps: int, gradient, rate: float, decay: float) -> None:
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for k in range(1, steps + 1):
        for w, g, a, b in zip(weights, gradient(), m, v):
            g = g - decay * w
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)


def fit(texts: list[str | None], toxic: list[int]) -> Field:
    """Fit tokens, then documents. Without both classes the field is silent and every score 0."""
    field = Field()
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        field.layer[3] = -30.0
        return field
    words, ids, starts, ends = _laid_out(texts)
    f = words.features()
    counts = np.zeros((2, SLOTS))
    for d, (i, j) in enumerate(zip(starts, ends)):
        counts[int(y[d])][np.unique(f[np.unique(ids[i:j])])] += 1
    share, seen_in = y.mean(), counts.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (counts[1] * np.log(counts[1] / (seen_in * share)) + np.where(counts[0] > 0, counts[0] * np.log(counts[0] / (seen_in * (1 - share))), 0))
    telling = (counts[1] > 4 * counts[0]) & (np.nan_to_num(ratio) >= EVIDENCE)
    label = telling[f].any(1)[ids] & np.repeat(y > 0, ends - starts)
    before, after = neighbours(ids, starts, ends)
    label = label.astype(float)
    inner = np.ones(len(ids), bool)
    inner[ends[ends > starts] - 1] = False
    pairs = np.flatnonzero(inner)
    seen = np.bincount((2 * label[pairs] + label[pairs + 1]).astype(int), minlength=4).reshape(2, 2).astype(float)
    flat = f[ids]

    def gradient() -> list[np.ndarray]:
        p, expected = marginals(field.odds(f, ids, before, after), starts, ends, field.trans, True)
        miss = label - p
        own = np.bincount(flat.ravel(), np.repeat(miss, OWN), SLOTS)
        near = [np.bincount(f[x[x >= 0], 1], miss[x >= 0], SLOTS) for x in (before, after)]
        return [own, np.stack(near), np.array([miss.sum()]), seen - expected]

    _adam([field.own, field.near, field.bias, field.trans], STEPS, gradient, 0.15, 0.02)
    p, _ = marginals(field.odds(f, ids, before, after), starts, ends, field.trans)
    x = field.documents(p, starts, ends)
    _adam([field.layer], 400, lambda: [x.T @ (y - field.scores(x))], 0.1, 0.001)
    return field


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of about SLICE characters in all: bounds the arrays of a task."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def tag(field: Field, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of the texts, and the spans of their toxic tokens."""
    words, ids, starts, ends = _laid_out(texts)
    p, _ = marginals(field.odds(words.features(), ids, *neighbours(ids, starts, ends)), starts, ends, field.trans)
    spans: list[list[dict]] = [[] for _ in texts]
    hit = np.flatnonzero(p >= 0.5)
    owner = np.searchsorted(ends, hit, side="right")
    for d in np.unique(owner).tolist():
        places = [m.span() for m in TOKEN.finditer(texts[d])]
        spans[d] = [{"start": places[k - starts[d]][0], "end": places[k - starts[d]][1], "p": float(p[k])} for k in hit[owner == d]]
    return field.scores(field.documents(p, starts, ends)), spans


def _scored(field) -> object:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [tag(field.value, part) for part in _slices(batch.column("text").to_pylist())]
            scores = np.concatenate([np.zeros(0)] + [x for x, _ in done])
            spans = pa.array([s for _, part in done for s in part], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores), spans], ["row", "score", "spans"])

    return score


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS) -> Field:
    """Fit on at most ``per_class`` toxic and clean labelled documents that are not held out, chosen by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "id IS NOT NULL AND toxic IN (0, 1)"
    ).filter(~held_out(F.col("id"))).distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    chosen = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice per_class rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(few, "id").orderBy("id", F.xxhash64("text")).limit(4 * per_class).collect()
    field, own = fit([r["text"] for r in rows], [r["toxic"] for r in rows]), Counter(r["toxic"] for r in rows)
    if min(own[0], own[1]) > 0:  # back from the sample's share of toxic documents to that of all labelled ones
        field.layer[3] += np.log(sizes[1] / sizes[0]) - np.log(own[1] / own[0])
    return field


def score_toxicity(docs: DataFrame, field: Field, spark: SparkSession | None = None) -> DataFrame:
    """row (a struct of all columns), score (0 to 1) and spans (start, end in code points, p) of tokens that are likelier toxic than not.

    * Null and empty texts have no tokens: no spans, and the score of a document without toxic tokens.
    * The score depends on the text alone, so repeated rows and equal texts score alike; null doc_ids are served.
    * Other columns travel inside ``row``, so their names cannot clash. An empty table gives an empty result.
    """
    spark = spark or docs.sparkSession
    sent = spark.sparkContext.broadcast(field)  # arrays of fixed size
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType()),
        ]))),
    ])
    return rows.mapInArrow(_scored(sent), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels")
    found = score_toxicity(docs.select(F.col("doc_id").cast("long"), "text"), fit_on(docs, labels), spark).select("row.doc_id", "score", "spans")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        F.size("spans").alias("n_spans"))
