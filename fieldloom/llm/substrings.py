"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences; sentences of more than PIECE words at clause marks, and clauses at every PIECE words. From
each piece on, the shortest run of at least two pieces and FLOOR words is hashed. Runs with equal hashes anywhere
in the corpus are repeats; the first one, by doc_id and position, stays, and pieces that any other one covers are removed.
The floor keeps short lines that many texts hold (headings, notices) where they are; the cuts make passages of one
or two long sentences repeat as well as those of many. Sentences end at . ! ? or a line break; pieces are compared
with A-Z in lower case and blanks squeezed, and carry their own trailing blanks, so that what is kept is the text itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import shared
from fieldloom.llm.shared import Scratch

PIECE = 12  # words of a piece at most
FLOOR = 36  # words of a run at least
BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
# A sentence with its end marks and the blanks after it; a piece of a long one: words up to one with a clause mark.
SENTENCE = rf"[^.!?\n]*(?:[.!?]+{BLANK}*|\n{BLANK}*|$)"
CLAUSE = rf"{BLANK}*(?:{WORD}*[^\x20\x09-\x0D,;:]{BLANK}+){{0,{PIECE - 1}}}{WORD}+{BLANK}*"
_SENTENCE, _CLAUSE = re.compile(SENTENCE), re.compile(CLAUSE)


def pieces(text: str) -> list[str]:
    """Sentences, long ones cut; they add up to the text."""
    out = []
    for sentence in filter(None, _SENTENCE.findall(text)):
        if len(sentence.encode("utf-8", "surrogatepass").split()) > PIECE:
            out += _CLAUSE.findall(sentence)
        else:
            out.append(sentence)
    return out


def runs(parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """First piece, piece after the last one, and hash of each run."""
    words = [p.encode("utf-8", "surrogatepass").lower().split() for p in parts]
    norms = [b" ".join(w) for w in words]
    until = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    start = np.arange(len(parts))
    stop = np.maximum(np.searchsorted(until, until[:-1] + FLOOR), start + 2)
    start, stop = start[stop <= len(parts)], stop[stop <= len(parts)]
    hashes = [xxhash.xxh3_64_intdigest(b"\0".join(norms[i:j])) for i, j in zip(start.tolist(), stop.tolist())]
    return start, stop, hashes


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [runs(pieces(t)) for t in batch.column("text").to_pylist()]
        size = [len(start) for start, _, _ in found]
        of = pa.array(np.repeat(np.arange(len(size)), size))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.array([h for _, _, hs in found for h in hs], np.uint64).view(np.int64)), batch.column("doc_id").take(of), batch.column("row_hash").take(of),
            pa.array(np.concatenate([s for s, _, _ in found] or [[]]).astype(np.int32)), pa.array(np.concatenate([e for _, e, _ in found] or [[]]).astype(np.int32)),
        ], ["hash", "doc_id", "row_hash", "at", "until"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, removed = [], [], []
        for text, covered in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist()):
            parts = pieces(text)
            gone = np.zeros(len(parts) + 1, np.int64)
            for c in covered or ():
                gone[c["at"]] += 1
                gone[c["until"]] -= 1
            stays = np.cumsum(gone)[:-1] == 0
            texts.append("".join(p for p, s in zip(parts, stays) if s))
            total.append(len(parts))
            removed.append(len(parts) - int(stays.sum()))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, texts), pa.int64()),
        ], ["doc_id", "text", "n_sentences", "n_removed", "n_chars"])


def drop_repeats(docs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """doc_id, text (what is kept), n_sentences (pieces), n_removed, n_chars (of the kept text): one row per input row.

    * Null and empty texts have no pieces and stay empty; texts with fewer than FLOOR words keep them all.
    * Repeats within one text count; of overlapping repeats each non-first one is covered.
    * Rows are told apart by doc_id and a hash of the text. Rows that repeat one another completely are one document
      (one is kept like any other, all get equal results); null doc_ids come last in the order.
    * Other columns are ignored. An empty table gives an empty result.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "substrings")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("doc_id", "text"))
    spans = texts.mapInArrow(_spans, "hash long, doc_id long, row_hash long, at int, until int")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash", "at")
    firsts = spans.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").select("hash", "first")
    firsts = scratch.keep(firsts)
    later = spans.join(firsts, "hash").filter(place != F.col("first")).select("row_hash", "at", "until")
    covered = scratch.keep(later.groupBy("row_hash").agg(F.collect_set(F.struct("at", "until")).alias("covered")))  # bounded by a text's pieces
    # Texts without a repeat are not moved.
    concerned = shared.may_be_in(covered.select("row_hash"), F.col("row_hash"))
    moved = texts.filter(concerned).join(covered, "row_hash", "left").select("doc_id", "text", "covered")
    whole = texts.filter(~concerned).select("doc_id", "text", F.lit(None).cast("array<struct<at:int,until:int>>").alias("covered"))
    result = "doc_id long, text string, n_sentences long, n_removed long, n_chars long"
    return whole.mapInArrow(_kept, result).unionByName(moved.mapInArrow(_kept, result))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(shared.table(spark, sf_dir, "documents"), spark)


# A run is the shortest one that reaches the floor: the first end, among pieces that hold words, from the target on.
ORACLE = rf"""
WITH s AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{SENTENCE}'), lambda s: s <> '') AS ss FROM documents),
d AS (SELECT row_id, doc_id, flatten(list_transform(ss, lambda s: CASE WHEN len(regexp_extract_all(s, '{WORD}+')) > {PIECE}
  THEN regexp_extract_all(s, '{CLAUSE}') ELSE [s] END)) AS parts FROM s),
n AS (SELECT *, list_transform(parts, lambda s: trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+', ' ', 'g'))) AS norms FROM d),
p AS (SELECT row_id, doc_id, norms, unnest(range(1, len(norms) + 1)) AS i FROM n),
w AS (SELECT *, len(regexp_extract_all(norms[i], '{WORD}+')) AS words, sum(words) OVER (PARTITION BY row_id ORDER BY i) AS until FROM p),
e AS (SELECT row_id, i AS j, until FROM w WHERE words > 0),
r AS (SELECT w.row_id, doc_id, i, greatest(j, i + 1) AS j, norms FROM (SELECT *, until - words + {FLOOR} AS target FROM w) w ASOF JOIN e ON e.row_id = w.row_id AND w.target <= e.until),
f AS (SELECT row_id, i, j, row_number() OVER (PARTITION BY norms[i:j] ORDER BY doc_id, i) AS nth FROM r WHERE j <= len(norms)),
gone AS (SELECT row_id, list(DISTINCT k) AS places FROM (SELECT row_id, unnest(range(i, j + 1)) AS k FROM f WHERE nth > 1) GROUP BY row_id),
k AS (SELECT doc_id, parts, list_filter(list_transform(range(1, len(parts) + 1), lambda i:
        CASE WHEN list_contains(coalesce(places, []), i) THEN NULL ELSE parts[i] END), lambda s: s IS NOT NULL) AS kept
      FROM d LEFT JOIN gone USING (row_id))
SELECT doc_id, array_to_string(kept, '') AS text, len(parts) AS n_sentences, len(parts) - len(kept) AS n_removed,
       length(array_to_string(kept, '')) AS n_chars FROM k
"""
