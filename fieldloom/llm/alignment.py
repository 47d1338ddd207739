"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers, by a monoid of fragments.

A fragment is what a byte range of a text says by itself: the tokens up to the first place where both tokenizers end a
token (its open prefix), the groups between such places (closed), and the tokens after the last one (its open suffix).
Fragments of neighbouring ranges compose, and composition is associative: only an open suffix and the open prefix
beside it are looked at again. Texts are cut into sections where both tokenizers must end a token, so that a very
long text is tokenized by many tasks, and token streams into byte ranges at any place; their fragments are
composed by a tree of groupings, FAN neighbours at a time. Texts of one section never leave their task.

A link is a pair of tokens, one of each tokenizer, whose bytes overlap. How many documents hold a pair is counted in
the task first and then over the corpus. Pairs that at least one in MANY of all (document, pair) entries name are at most
MANY, so they are sent to every task; entries of the others are joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import shared
from fieldloom.llm.language_model import packed, packed_sorted, unpacked, unpacked_sorted
from fieldloom.llm.shared import Scratch

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary cuts a text into words before it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"  # stands for a space in pieces

SECTION = 1 << 16  # characters of a section, up to the next place where it may end, and bytes of a fragment
FAN = 8
MANY = 1 << 20
CACHED = 1 << 20  # pairs that a task counts before it passes the counts on
BATCH_CHARS = 2 << 20  # of texts that are grouped at a time


# ------------------------------------------------------------------------------ tokenizers
def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        byte, vocabulary = _byte_level(), json.loads(a_json)["model"]["vocab"]
        # Special tokens are no merges; their strings in texts are plain text.
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if not re.fullmatch(r"<\|.*\|>", token)}
        self.a = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("links are packed for vocabularies of up to 65536 tokens")
        # Sections may end before a space only if no piece goes on after one.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def encode(self, section: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a section, which begins with a space; None where their bytes differ from it."""
        a, b = self.a.encode_ordinary(section), self.b.encode(section[1:])
        raw = section.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


_SECTION_END = re.compile(r"(?<=[^\W_]) (?=[^\W_])")  # a space between letters or digits: both tokenizers end a token before it


def sections(text: str, size: int, may_cut: bool = True) -> list[str]:
    """The text behind one space, in parts that each begin with a space; they add up to it."""
    text, parts, start = " " + text, [], 0
    while may_cut and len(text) - start > size:
        end = _SECTION_END.search(text, start + size)
        if not end:
            break
        parts.append(text[start : end.start()])
        start = end.start()
    return [*parts, text[start:]]


_loaded: dict[int, Tokenizers] = {}


def _tokenizers(files) -> Tokenizers:
    """One pair per worker process."""
    if files.id not in _loaded:
        _loaded.clear()
        _loaded[files.id] = Tokenizers(*files.sent.value)
    return _loaded[files.id]


class Files:
    """Vocabulary files of public tokenizers (a few megabytes), read by the driver and sent to the workers."""

    def __init__(self, spark: SparkSession, a_path: str, b_path: str):
        contents = []
        for path in (a_path, b_path):
            try:
                with open(path, "rb") as file:
                    contents.append(file.read())
            except OSError as error:
                raise FileNotFoundError(f"no vocabulary file {path}: name one that the driver can read") from error
        self.sent, self.id = spark.sparkContext.broadcast(contents), hash(tuple(contents))


# ------------------------------------------------------------------------------ groups and links
class Summary(NamedTuple):
    """Closed groups: counts, the groups written out, and the distinct links (sorted) with how often each occurs."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: np.ndarray
    times: np.ndarray

    def then(self, right: Summary) -> Summary:
        pairs, place = np.unique(np.concatenate([self.pairs, right.pairs]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([self.times, right.times]), minlength=len(pairs)).astype(np.uint64)
        groups = f"{self.groups};{right.groups}" if self.groups and right.groups else self.groups or right.groups
        return Summary(*(x + y for x, y in zip(self[:4], right[:4])), groups, pairs, times)


NOTHING = Summary(0, 0, 0, 0, "", shared.NO_HASHES, shared.NO_HASHES)
ALIGNED = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def _aligned_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows: row_id, doc_id, Summary."""
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
    listed = [(row_id, doc_id, *s[:5], packed_sorted(s.pairs), packed(s.times)) for row_id, doc_id, s in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*listed)) or [()] * 9, types)], [c.split()[0] for c in ALIGNED.split(", ")])


class Aligner:
    """Groups and links of stretches of text whose edges are common ends."""

    def __init__(self, tokenizers: Tokenizers):
        most = max(len(tokenizers.a_bytes), len(tokenizers.b_bytes))
        self.written = [f"{i}{mark}" for i in range(most) for mark in ",|;"]

    def one(self, sides) -> Summary:
        return self.many([sides])[0]

    def many(self, stretches: list) -> list[Summary]:
        """Many at a time; None and stretches without tokens have nothing."""
        full = [sides for sides in stretches if sides is not None and len(sides[0][0])]
        found = iter(self._grouped(full) if full else ())
        return [next(found) if sides is not None and len(sides[0][0]) else NOTHING for sides in stretches]

    def _grouped(self, full: list) -> Iterator[Summary]:
        (a, a_lengths), (b, b_lengths) = _joined(*full)
        n_a, n_b = (np.array([len(sides[s][0]) for sides in full]) for s in (0, 1))
        # Texts follow one another, so offsets run on and the edge between two of them is a common end.
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        again = ends[1:] == ends[:-1]
        common, pieces = ends[1:][again], ends[np.append(True, ~again)]
        # Every piece between neighbouring ends is the overlap of one token of each side.
        i, j = np.searchsorted(a_ends, pieces), np.searchsorted(b_ends, pieces)
        a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
        stops = a_ends[a_stop - 1]
        link_stop, group_stop = np.searchsorted(pieces, stops, "right"), np.searchsorted(common, stops, "right")
        pair = (a[i] << 16 | b[j]).astype(np.uint64)  # ids of both sides fit 16 bits
        texts = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(link_stop, prepend=0))
        entry, times = np.unique(texts << np.uint64(32) | pair, return_counts=True)
        entry_stop = np.searchsorted(entry >> np.uint64(32), np.arange(len(full), dtype=np.uint64), "right")
        entry &= np.uint64(0xFFFFFFFF)
        # All tokens in the order of the text that is hashed: by group, first side first.
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        mark = np.concatenate([np.append(a_group[1:] != a_group[:-1], True) * 1, np.append(b_group[1:] != b_group[:-1], True) * 2])
        words = list(map(self.written.__getitem__, (np.concatenate([a, b]) * 3 + mark)[order].tolist()))
        begin = [0] * 4
        for k, stop in enumerate(zip(a_stop.tolist(), b_stop.tolist(), group_stop.tolist(), link_stop.tolist())):
            e = (int(entry_stop[k - 1]) if k else 0, int(entry_stop[k]))
            groups = "".join(words[begin[0] + begin[1] : stop[0] + stop[1]])[:-1]
            yield Summary(*(y - x for x, y in zip(begin, stop)), groups, entry[e[0] : e[1]], times[e[0] : e[1]].astype(np.uint64))
            begin = stop


# ------------------------------------------------------------------------------ fragments
class Fragment:
    """A byte range: tokens of both sides that end up to its first common end, the summary of the groups between that and
    its last one (None without a common end), and the tokens after it. Sides are ((a ids, a lengths), (b ids, b lengths))."""

    __slots__ = ("opened", "closed", "tail")

    def __init__(self, opened, closed: Summary | None = None, tail=None):
        self.opened, self.closed, self.tail = opened, closed, tail

    @staticmethod
    def of(aligner: Aligner, sides, a_from: int = 0, b_from: int = 0) -> Fragment:
        """Of the tokens whose ends lie in a range; ``…_from``: where the first token of each side begins."""
        (a, a_lengths), (b, b_lengths) = sides
        a_ends, b_ends = a_from + np.cumsum(a_lengths), b_from + np.cumsum(b_lengths)
        common = np.intersect1d(a_ends, b_ends)
        if not len(common):
            return Fragment(sides)
        i, j = np.searchsorted(a_ends, common[[0, -1]], "right"), np.searchsorted(b_ends, common[[0, -1]], "right")
        part = lambda x, y, p, q: ((a[x:y], a_lengths[x:y]), (b[p:q], b_lengths[p:q]))
        return Fragment(part(0, i[0], 0, j[0]), aligner.one(part(i[0], i[1], j[0], j[1])), part(i[1], None, j[1], None))

    def then(self, right: Fragment, aligner: Aligner) -> Fragment:
        """The fragment of both ranges. What was closed stays closed; only what is open between them is grouped now."""
        if self.closed is None:
            return Fragment(_joined(self.opened, right.opened), right.closed, right.tail)
        between = _joined(self.tail, right.opened)
        if right.closed is None:
            return Fragment(self.opened, self.closed, between)
        return Fragment(self.opened, self.closed.then(aligner.one(between)).then(right.closed), right.tail)

    def whole(self, aligner: Aligner) -> Summary:
        """Of a whole text, whose first and last bytes are common edges."""
        first = aligner.one(self.opened)
        return first if self.closed is None else first.then(self.closed).then(aligner.one(self.tail))

    def pack(self) -> bytes:
        """Sides packed one after the other, then the summary."""
        parts = [packed(p.astype(np.uint64)) for sides in (self.opened, self.tail) if sides is not None for side in sides for p in side]
        if self.closed is not None:
            c = self.closed
            parts += [np.int64(c[:4]).tobytes(), pa.compress(c.groups.encode(), codec="zstd", asbytes=True), np.int64([len(c.groups)]).tobytes(), packed_sorted(c.pairs), packed(c.times)]
        return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)

    @staticmethod
    def unpack(raw: bytes) -> Fragment:
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        edges = 8 + 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw[8 : 8 + 8 * n], np.int64))])
        parts = [raw[i:j] for i, j in zip(edges[:-1], edges[1:])]
        sides = [unpacked(p).astype(np.int64) for p in parts[: 4 if n == 4 else 8]]
        read = [((sides[k], sides[k + 1]), (sides[k + 2], sides[k + 3])) for k in range(0, len(sides), 4)]
        if n == 4:
            return Fragment(read[0])
        numbers, text, length, pairs, times = parts[8:]
        groups = pa.decompress(text, int(np.frombuffer(length, np.int64)[0]), codec="zstd", asbytes=True).decode()
        closed = Summary(*np.frombuffer(numbers, np.int64).tolist(), groups, unpacked_sorted(pairs), unpacked(times))
        return Fragment(read[0], closed, read[1])


def _joined(*parts):
    return tuple(tuple(np.concatenate([p[s][k] for p in parts]) for k in (0, 1)) for s in (0, 1))


def fragments(aligner: Aligner, sides, size: int) -> Iterator[Fragment]:
    """The token streams of a section in byte ranges of ``size``; a token belongs to the range in which it ends."""
    (a, a_lengths), (b, b_lengths) = sides
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    edges = np.arange(size, int(a_ends[-1]) if len(a_ends) else 0, size)
    i = np.concatenate([[0], np.searchsorted(a_ends, edges, "right"), [len(a)]])
    j = np.concatenate([[0], np.searchsorted(b_ends, edges, "right"), [len(b)]])
    for x, y, p, q in zip(i[:-1], i[1:], j[:-1], j[1:]):
        part = ((a[x:y], a_lengths[x:y]), (b[p:q], b_lengths[p:q]))
        yield Fragment.of(aligner, part, int(a_ends[x - 1]) if x else 0, int(b_ends[p - 1]) if p else 0)


# ------------------------------------------------------------------------------ texts
def _tokenized(tokenizers: Tokenizers, section: str):
    ids = tokenizers.encode(section)
    return ids and ((ids[0], tokenizers.a_lengths[ids[0]]), (ids[1], tokenizers.b_lengths[ids[1]]))


def align(docs: DataFrame, files: Files, section: int = SECTION) -> DataFrame:
    """row_id, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times: one row per input row.

    ``groups``: ``a1,a2|b1;a3|b2,b3``, decimal ids in order. ``pairs`` (packed, sorted): the distinct links, the first
    side's id times 65536 plus the second's; ``times``: how often each occurs.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") >= section

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(files)
        aligner = Aligner(tokenizers)
        for batch in batches:
            ids, sides, size = [], [], 0
            for row_id, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append((row_id, doc_id))
                sides.append(_tokenized(tokenizers, " " + text) if text else None)
                size += len(text)
                if size > BATCH_CHARS:
                    yield _aligned_rows([(*i, s) for i, s in zip(ids, aligner.many(sides))])
                    ids, sides, size = [], [], 0
            yield _aligned_rows([(*i, s) for i, s in zip(ids, aligner.many(sides))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_cut = _tokenizers(files).cuts
        for batch in batches:
            for row_id, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = sections(text, section, may_cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row_id] * len(parts)), pa.array([doc_id] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string()),
                ], ["row_id", "doc_id", "part", "text"])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(files)
        aligner = Aligner(tokenizers)
        for batch in batches:
            for row_id, doc_id, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                sides = _tokenized(tokenizers, text)
                found = fragments(aligner, sides, section) if sides else [None]
                yield _fragment_rows([(row_id, doc_id, part, k, f and f.pack()) for k, f in enumerate(found)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_tokenizers(files))
        for batch in batches:
            for row_id, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "fragment"))):
                yield _aligned_rows([(row_id, doc_id, Fragment.unpack(raw).whole(aligner) if raw is not None else NOTHING)])

    parts = rows.filter(long).mapInArrow(cut, "row_id long, doc_id long, part long, text string")
    parts = parts.repartition(shared.shuffle_partitions(docs.sparkSession), "row_id", "part")
    whole = composed(parts.mapInArrow(tokenize, FRAGMENT), files, docs.sparkSession)
    return rows.filter(~long).mapInArrow(short, ALIGNED).unionByName(whole.mapInArrow(finish, ALIGNED))


FRAGMENT = "row_id long, doc_id long, part long, piece long, fragment binary"


def _fragment_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in FRAGMENT.split(", ")])


def composed(leaves: DataFrame, files: Files, spark: SparkSession) -> DataFrame:
    """A row per text: its fragments composed, FAN neighbours a step; a null fragment if a part has no tokens."""
    scratch = Scratch(spark, "alignment")

    def step(of: str):
        def compose(table: pa.Table) -> pa.Table:
            aligner, rows, total = Aligner(_tokenizers(files)), sorted(table.to_pylist(), key=lambda r: (r["part"], r["piece"])), None
            if all(r["fragment"] is not None for r in rows):
                for f in (Fragment.unpack(r["fragment"]) for r in rows):
                    total = f if total is None else total.then(f, aligner)
            place = {"part": rows[0]["part"], "piece": 0} | {of: rows[0][of] // FAN}
            return pa.Table.from_batches([_fragment_rows([(rows[0]["row_id"], rows[0]["doc_id"], *place.values(), total and total.pack())])])

        return compose

    level = scratch.keep(leaves)
    while True:
        most = level.agg(F.max("part").alias("part"), F.max("piece").alias("piece")).first()
        of = "piece" if most["piece"] else "part"  # the pieces of a section first
        if not most[of]:
            return level
        keys = ["row_id", "part"] if of == "piece" else ["row_id"]
        level = scratch.keep(level.groupBy(*keys, F.floor(F.col(of) / FAN).alias("to")).applyInArrow(step(of), FRAGMENT))


# ------------------------------------------------------------------------------ counts of pairs
def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs: how many rows hold each link."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for raw in batch.column("pairs").to_pylist():
                waiting.append(unpacked_sorted(raw))
                size += len(waiting[-1])
                if size > 4 * CACHED:
                    yield _counted(waiting)
                    waiting, size = [], 0
        yield _counted(waiting)

    return aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))


def _counted(waiting: list[np.ndarray]) -> pa.RecordBatch:
    pairs, n = np.unique(np.concatenate([shared.NO_HASHES, *waiting]), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])


def link_counts(aligned: DataFrame, scratch: Scratch) -> DataFrame:
    """row_id, n_best, count_sum: a row's links whose pair is held by most documents of all pairs of its first token
    (ties included), and the sum of its links' counts."""
    spark = scratch.spark
    counts = scratch.keep(pair_counts(aligned))
    first = F.call_function("shiftright", F.col("pair"), F.lit(16)).alias("a")
    most = counts.groupBy(first).agg(F.max("n_docs").alias("most"))  # a row per token of a vocabulary
    known = counts.withColumn("a", first).join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    known = scratch.keep(known)
    entries = known.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") * MANY >= entries  # holds for MANY pairs at most
    table = known.filter(hot).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    sent = spark.sparkContext.broadcast([table[c].to_numpy()[order] for c in ("pair", "n_docs", "best")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = sent.value
        for batch in batches:
            ids, size = batch.column("row_id").to_numpy(), []
            pairs, times = [shared.NO_HASHES], [shared.NO_HASHES]
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                pairs.append(unpacked_sorted(p))
                times.append(unpacked(t))
                size.append(len(pairs[-1]))
            pair, n = np.concatenate(pairs).astype(np.int64), np.concatenate(times).astype(np.int64)
            row = np.repeat(np.arange(len(ids)), size)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            is_hot = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            at, own = at[is_hot], n[is_hot]
            sums = [np.bincount(row[is_hot], weights=w, minlength=len(ids)).astype(np.int64) for w in (own * best[at] if len(at) else own, own * docs[at] if len(at) else own)]
            yield _entry_rows(ids, np.full(len(ids), -1), np.zeros(len(ids), np.int64), *sums)
            if not is_hot.all():
                cold = ~is_hot
                none = np.zeros(cold.sum(), np.int64)
                yield _entry_rows(ids[row[cold]], pair[cold], n[cold], none, none)

    found = aligned.select("row_id", "pairs", "times").mapInArrow(look_up, "row_id long, pair long, n long, n_best long, count_sum long")
    found = scratch.keep(found)
    cold = found.filter("pair >= 0").select("row_id", "pair", "n").join(known.filter(~hot), "pair").select(
        "row_id", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("n_docs")).alias("count_sum")
    )
    sums = [F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")]
    # Entries of one row are added up in its task first; a row without cold entries has one row here.
    return found.filter("pair < 0").select("row_id", "n_best", "count_sum").unionByName(cold.groupBy("row_id").agg(*sums)).groupBy("row_id").agg(*sums)


def _entry_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["row_id", "pair", "n", "n_best", "count_sum"])


# ------------------------------------------------------------------------------ query
def op12_token_alignment(spark: SparkSession, sf_dir: str, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    scratch = Scratch(spark, "alignment")
    aligned = align(shared.table(spark, sf_dir, "documents"), Files(spark, a_path, b_path))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = scratch.keep(aligned.withColumn("groups_sha256", digest).drop("groups"))
    counts = link_counts(aligned, scratch)
    return aligned.join(counts, "row_id").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
