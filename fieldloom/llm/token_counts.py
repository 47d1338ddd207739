"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets a failure link and a popped-token count for every node: when the text leaves the trie
there, the longest matches of the node's string are taken off its front, their number is the popped count, and the
link leads to the node of what is left. One walk over a word's bytes then gives the number of greedy longest-match
pieces, in linear time and without building a piece. A word is searched with one blank before it, as byte-level
vocabularies keep word beginnings; blanks between words count with the word that follows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import shared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHED = 200_000  # words whose counts a task remembers; beyond that it forgets them all and starts anew


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """The automaton. Bytes that no token starts with count as one piece each."""

    def __init__(self, vocabulary: list[bytes]):
        self.goto: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        for token in [*vocabulary, *(bytes([b]) for b in range(256))]:
            node = 0
            for byte in token:
                found = self.goto[node].get(byte)
                if found is None:
                    found = self.goto[node][byte] = len(self.goto)
                    self.goto.append({})
                    ends.append(False)
                node = found
            ends[node] = bool(token)
        self.fail, self.popped = [0] * len(self.goto), [0] * len(self.goto)
        level = [(0, byte, node) for byte, node in self.goto[0].items()]
        while level:
            deeper = []
            for parent, byte, node in level:
                if ends[node]:  # the whole string is one token
                    self.popped[node] = 1
                else:
                    count, left = self.popped[parent], self.fail[parent]
                    while byte not in self.goto[left]:
                        count, left = count + self.popped[left], self.fail[left]
                    self.popped[node], self.fail[node] = count, self.goto[left][byte]
                deeper.extend((node, b, n) for b, n in self.goto[node].items())
            level = deeper
        self.cache: dict[bytes, int] = {}

    def pieces(self, string: bytes) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        node = count = 0
        for byte in string:
            step = goto[node].get(byte)
            while step is None:
                count += popped[node]
                node = fail[node]
                step = goto[node].get(byte)
            node = step
        while node:
            count += popped[node]
            node = fail[node]
        return count

    def text(self, text: str | None) -> int:
        cache, total = self.cache, 0
        for word in text.encode("utf-8", "surrogatepass").split() if text else ():
            n = cache.get(word)
            if n is None:
                if len(cache) >= CACHED:
                    cache.clear()
                n = cache[word] = self.pieces(b" " + word)
            total += n
        return total


_built: dict[int, LongestMatch] = {}


def _automaton(vocabulary) -> LongestMatch:
    """One automaton per worker process and vocabulary."""
    if vocabulary.id not in _built:
        _built.clear()
        _built[vocabulary.id] = LongestMatch(vocabulary.tokens.value)
    return _built[vocabulary.id]


class _Sent:
    def __init__(self, tokens):
        self.tokens, self.id = tokens, hash(tuple(tokens.value[:1000])) ^ len(tokens.value)


def count_tokens(docs: DataFrame, vocabulary: list[bytes], spark: SparkSession | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens (long): one row per input row.

    * Null, empty and blank texts have no words and no tokens.
    * Repeated rows get equal counts. Only doc_id and text are read. An empty table gives an empty result.
    """
    spark = spark or docs.sparkSession
    sent = _Sent(spark.sparkContext.broadcast(vocabulary))  # a public vocabulary: some hundred thousand tokens at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [(len((t or "").encode("utf-8", "surrogatepass").split()), automaton.text(t)) for t in texts]
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(shared.table(spark, sf_dir, "documents"), read_vocabulary(), spark)
