"""Conversation prefix trie: which turns many conversations share from their start on.

A node is a distinct sequence of first turns. Only hashes of turns travel, never texts: a prefix of d turns is known
by two 64-bit digests, each the exclusive or of its turns' hashes, salted with their places.

1. `numbered_segments`: turns in order, SEGMENT of them to a row. Places come from a range partitioning and the counts
   of the partitions before, so that a conversation with a third of all turns is ordered by many tasks.
2. `_possibly_shared`: a count-min sketch (two rows of cells, kept as one bit a cell: counted more than once?) over all
   prefixes. A prefix with an unset bit is proven to be a singleton, and so are all that continue it. Its tail is
   emitted where it stands; only the prefixes before it shuffle and are counted exactly. A crowded sketch lets more
   prefixes through, which costs time and changes no result.
3. Every node is owned by its smallest member. What a conversation owns is the rest of its path from some depth on, so
   the trie falls into one path per conversation, hanging from a node of another one. A conversation knows
   the sum of its own path; a node's subtree is its own path below it and the paths of its other members. These are
   sums over members, combined within tasks before they shuffle: no walk along the edges, no iteration.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.llm import shared
from fieldloom.llm.shared import Scratch

SEGMENT = 1024  # turns in a row; bounds its size, not a conversation's
SALT = 11
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26  # cells in a row of the sketch: four for each prefix, in between
HOT_SHARE = 1000  # a node that more than one in so many paths hang from is hot; there are fewer of them than this
IDS = 12  # bits of the conv_ids that are joined to one string at a time

TURN = "struct<h1:bigint,h2:bigint,bytes:bigint>"
NODE = ["depth", "key1", "key2"]


@dataclass
class Trie:
    """``nodes``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_ends, n_children, n_leaves, saved_tokens, key1, key2.

    ``ends``: conv_id, depth, key1, key2: the node where each conversation ends. Keys are null for nodes with one
    member that the sketch proved; conv_id and depth name those, as they name any node.
    """

    nodes: DataFrame
    ends: DataFrame


# ------------------------------------------------------------------------------ turns
def _texts(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def numbered_segments(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, segment, turns: the hashed turns of each conversation in order, SEGMENT a row."""
    role, text = _texts("role"), _texts("text")
    light = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(SALT), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    within = [F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    ranged = light.repartitionByRange(shared.shuffle_partitions(scratch.spark), "conv_id", *within)
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = ranged.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*within)))
    at = (F.col("nth") - 1 + F.col("before")).alias("at")
    placed = local.join(sizes, ["conv_id", "part"]).select("conv_id", at, "h1", "h2", "bytes")
    one = F.struct("at", "h1", "h2", "bytes")
    grouped = placed.groupBy("conv_id", F.floor(F.col("at") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["bytes"].alias("bytes")))
    return scratch.keep(grouped.select("conv_id", "segment", turns.alias("turns")))


def _carried(rows: DataFrame, value: Column, name: str, light: list[str]) -> DataFrame:
    """Adds what the earlier segments of a conversation amount to; first segments have none and are not joined."""
    earlier = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    late = rows.select("conv_id").filter("segment > 0").distinct()
    sums = rows.select("conv_id", "segment", *light).join(late, "conv_id", "left_semi").select("conv_id", "segment", value.over(earlier).alias(name))
    return rows.filter("segment > 0").join(sums.filter("segment > 0"), ["conv_id", "segment"])


def _salted(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, segment, start, bytes, s1, s2 (salted hashes), c1, c2 (digests of the segments before)."""
    sized = segments.withColumn("n", F.size("turns").cast("long"))
    first = sized.filter("segment = 0").withColumn("start", F.lit(0).cast("long"))
    sized = first.unionByName(_carried(sized, F.sum("n"), "start", ["n"]))
    salted = lambda h, seed: F.transform("turns", lambda t, i: F.xxhash64(F.lit(seed), t[h], F.col("start") + i))
    rows = sized.select("conv_id", "segment", "start", F.col("turns.bytes").alias("bytes"), salted("h1", 1).alias("s1"), salted("h2", 2).alias("s2"))
    total = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
    rows = scratch.keep(rows.withColumn("x1", total("s1")).withColumn("x2", total("s2")))
    none = F.lit(0).cast("bigint")
    first = rows.filter("segment = 0").withColumn("c1", none).withColumn("c2", none)
    later = _carried(rows, F.bit_xor("x1"), "c1", ["x1"])
    later = later.join(_carried(rows, F.bit_xor("x2"), "c2", ["x2"]).select("conv_id", "segment", "c2"), ["conv_id", "segment"])
    return first.unionByName(later).drop("x1", "x2")


# ------------------------------------------------------------------------------ sketch
def _digests(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row bounds, and the two prefix digests of every turn of the batch."""
    lists = batch.column("s1")
    bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    found = []
    for s, c in (("s1", "c1"), ("s2", "c2")):
        salted = batch.column(s).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        running = np.bitwise_xor.accumulate(salted) if len(salted) else salted
        before = np.concatenate([np.zeros(1, np.int64), running])[bounds[:-1]]
        found.append(running ^ np.repeat(before ^ batch.column(c).to_numpy(), np.diff(bounds)))
    return bounds, found


def _cells(digests: list[np.ndarray], cells: int) -> list[np.ndarray]:
    return [(d & (cells - 1)) + k * cells for k, d in enumerate(digests)]


def _sketch(salted: DataFrame, cells: int) -> np.ndarray:
    """One bit for each of 2 * cells counters: is it above one? Never more than MOST_CELLS / 4 bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = np.unique(np.concatenate(_cells(_digests(batch)[1], cells)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(n, 2))], ["cell", "n"])

    counts = salted.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("cell") % 64).cast("int"))
    words = counts.groupBy(F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(2 * cells // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


SCREENED = "conv_id long, segment long, start long, n long, known array<bigint>, key1 array<bigint>, key2 array<bigint>, end1 long, end2 long"


def _possibly_shared(salted: DataFrame, spark: SparkSession) -> DataFrame:
    """Per segment: its leading prefixes that the sketch can't prove to be singletons (bytes and keys), and its last digest."""
    total = salted.agg(F.sum(F.size("s1"))).first()[0] or 0
    cells = min(max(1 << (4 * total).bit_length(), LEAST_CELLS), MOST_CELLS)
    sent = spark.sparkContext.broadcast(_sketch(salted, cells))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            bounds, digests = _digests(batch)
            single = np.zeros(bounds[-1], bool)
            for cell in _cells(digests, cells):
                single |= (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 0
            size, proven = np.diff(bounds), np.append(np.flatnonzero(single), bounds[-1])
            kept = np.minimum(proven[np.searchsorted(proven, bounds[:-1])] - bounds[:-1], size)
            take = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) < np.repeat(kept, size)
            offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
            lists = lambda a: pa.ListArray.from_arrays(offsets, pa.array(a[take], pa.int64()))
            ends = []
            for d, c in zip(digests, ("c1", "c2")):
                end = batch.column(c).to_numpy().copy()
                end[size > 0] = d[bounds[1:][size > 0] - 1]
                ends.append(pa.array(end))
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), batch.column("segment"), batch.column("start"), pa.array(size, pa.int64()),
                lists(batch.column("bytes").flatten().to_numpy(zero_copy_only=False)), *map(lists, digests), *ends,
            ], [c.split()[0] for c in SCREENED.split(", ")])

    return salted.mapInArrow(screen, SCREENED)


# ------------------------------------------------------------------------------ trie
def _prefixes(screened: DataFrame, *others: str) -> DataFrame:
    """A row for each possibly shared prefix; the first segment adds the root."""
    long = F.lit(0).cast("bigint")
    root = F.array(F.struct(long.alias("known"), long.alias("key1"), long.alias("key2")))
    listed = F.arrays_zip("known", "key1", "key2")
    # A first segment starts with the root, so its places are depths; a later one is shifted by one.
    listed = F.when(F.col("segment") == 0, F.concat(root, listed)).otherwise(listed)
    shift = F.when(F.col("segment") == 0, 0).otherwise(F.col("start") + 1)
    exploded = screened.select("conv_id", *others, shift.alias("shift"), F.posexplode(listed).alias("i", "p"))
    return exploded.select("conv_id", *others, (F.col("i") + F.col("shift")).cast("long").alias("depth"), "p.*")


def _below(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``own``: the sum of ``saving`` over the owner's path from the node downwards, in blocks of SEGMENT depths."""
    cut = nodes.withColumn("block", F.floor(F.col("depth") / SEGMENT))
    deeper = W.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = cut.groupBy("conv_id", "block").agg(F.sum("saving").alias("s"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("deeper"))
    inside = F.sum("saving").over(W.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()))
    return cut.withColumn("inside", inside).join(blocks, ["conv_id", "block"]).withColumn("own", F.col("inside") + F.col("deeper")).drop("block", "inside", "deeper")


def prefix_trie(segments: DataFrame, spark: SparkSession | None = None) -> Trie:
    """The trie over ``segments`` (conv_id, segment, turns: see `numbered_segments`).

    Conversations without turns end at the root. Without conversations there is no root.
    """
    spark = spark or segments.sparkSession
    scratch = Scratch(spark, "trie")
    screened = scratch.keep(_possibly_shared(_salted(segments, scratch), spark))

    # Where each conversation ends, and where its proven tail begins.
    tail = F.when(F.size("key1") < F.col("n"), F.col("start") + F.size("key1") + 1)
    last = F.struct("segment", (F.size("key1") == F.col("n")).alias("in_shared"), F.col("end1").alias("key1"), F.col("end2").alias("key2"))
    convs = screened.groupBy("conv_id").agg(F.sum("n").alias("length"), F.min(tail).alias("tail"), F.max(last).alias("last"))
    convs = scratch.keep(convs.select("conv_id", "length", "tail", "last.in_shared", "last.key1", "last.key2"))
    ended = convs.filter("in_shared").groupBy(F.col("length").alias("depth"), "key1", "key2").agg(F.count(F.lit(1)).alias("n_ends"))

    # Exact counts of possibly shared nodes; the owner is the smallest member.
    counted = _prefixes(screened).groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("known").alias("bytes"))
    counted = counted.join(ended, NODE, "left").withColumn("n_ends", F.coalesce("n_ends", F.lit(0))).withColumn("saving", (F.col("n_convs") - 1) * F.col("bytes"))
    counted = scratch.keep(counted)

    # What a conversation owns: from which depth on, the sum along it, and whether it has a leaf.
    owned = counted.groupBy("conv_id").agg(F.min("depth").alias("from_shared"), F.sum("saving").alias("path"), F.max(F.col("n_ends") == F.col("n_convs")).alias("shared_leaf"))
    owners = convs.join(owned, "conv_id", "left").select(
        "conv_id", "length", F.least("from_shared", "tail").alias("owns"), F.coalesce("path", F.lit(0)).alias("path"),
        (~F.col("in_shared") | F.coalesce("shared_leaf", F.lit(False))).cast("long").alias("leaf"),
    )
    known = scratch.keep(screened.drop("end1", "end2").join(owners, "conv_id"))

    # Sums over members.
    places = _prefixes(known, "owns", "length", "path", "leaf")
    hangs = F.coalesce(F.col("depth") == F.col("owns") - 1, F.lit(False))
    goes_on = F.coalesce((F.col("depth") >= F.col("owns")) & (F.col("depth") < F.col("length")), F.lit(False))
    other = F.when(F.coalesce(F.col("depth") >= F.col("owns"), F.lit(False)), 0).otherwise(F.col("path"))
    sums = places.groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.sum((hangs | goes_on).cast("long")).alias("n_children"),
        F.sum(other).alias("others"), F.sum(hangs.cast("long")).alias("n_hanging"),
    )
    shared_nodes = scratch.keep(_below(counted.join(sums, NODE), scratch))

    # The node that a path hangs from is another conversation's: hot ones are fewer than HOT_SHARE, so they can be sent.
    hanging = places.filter(hangs).select(F.col("conv_id").alias("child"), "owns", *NODE)
    hot = shared_nodes.filter(F.col("n_hanging") * HOT_SHARE > convs.count()).select(*NODE, F.col("conv_id").alias("above"))
    rest = shared_nodes.select(*NODE, F.col("conv_id").alias("above"))
    parents = hanging.join(F.broadcast(hot), NODE).unionByName(hanging.join(F.broadcast(hot.drop("above")), NODE, "left_anti").join(rest, NODE))
    parents = scratch.keep(parents.select(F.col("child").alias("conv_id"), F.col("owns").alias("depth"), "above"))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens", "key1", "key2"]
    parent = F.coalesce("above", F.when(F.col("depth") > 0, F.col("conv_id"))).alias("parent_conv_id")
    inner = shared_nodes.join(parents, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", parent, "n_convs", "n_ends", "n_children", "n_leaves", (F.col("own") + F.col("others")).alias("saved_tokens"), "key1", "key2"
    )
    tails = known.filter(F.size("key1") < F.col("n")).select("conv_id", "length", (F.col("start") + F.size("key1") + 1).alias("depth"), (F.col("start") + F.col("n")).alias("to"))
    tails = tails.join(parents, ["conv_id", "depth"], "left").withColumn("first", F.col("depth")).withColumn("depth", F.explode(F.sequence("first", "to")))
    one, null = F.lit(1).cast("long"), F.lit(None).cast("long")
    outer = tails.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("first"), F.coalesce("above", "conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), (F.col("depth") == F.col("length")).cast("long").alias("n_ends"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), null.alias("key1"), null.alias("key2"),
    )
    key = lambda k: F.when(F.col("in_shared"), F.col(k)).alias(k)
    ends = convs.select("conv_id", F.col("length").alias("depth"), key("key1"), key("key2"))
    return Trie(inner.select(columns).unionByName(outer.select(columns)), ends)


def conversation_trie(conversations: DataFrame, spark: SparkSession | None = None) -> Trie:
    """The trie over conv_id, turn, role, text as they stand.

    * Turns are ordered by ``turn``, nulls first; ties by role, then by the hash of the text. Repeated rows are turns
      of their own.
    * Null roles and texts are empty ones. Rows without conv_id belong to no conversation and are left out.
    * Other columns are ignored. An empty table has no nodes.
    """
    spark = spark or conversations.sparkSession
    return prefix_trie(numbered_segments(conversations, Scratch(spark, "turns")), spark)


# ------------------------------------------------------------------------------ digests of members
def end_digests(ends: DataFrame) -> DataFrame:
    """depth, key1, key2, ends_sha256: SHA-256 of the ids that end at each keyed node, ascending, comma-joined.

    A hash of one string takes one task, but not its memory: ids are joined 2^IDS at a time, and the task that hashes a
    node reads these strings in order, one after the other.
    """
    joined = ends.filter("key1 IS NOT NULL").groupBy(*NODE, F.call_function("shiftright", F.col("conv_id"), F.lit(IDS)).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        for batch in batches:
            *keys, ids = (batch.column(c).to_pylist() for c in (*NODE, "ids"))
            for *here, part in zip(*keys, ids):
                if here == node:
                    sha.update(b"," + part.encode())
                    continue
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = here, hashlib.sha256(part.encode())
            yield _digest_rows(done)
            done = []
        yield _digest_rows([(*node, sha.hexdigest())] if node else [])

    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(digest, "depth long, key1 long, key2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends_sha256"])


# ------------------------------------------------------------------------------ query
FAMILY = 5  # conversations that share their head
HEADS = 9  # lengths of a head: 0 to 8 turns


def rebuilt(segments: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % FAMILY, h = crc32(c) % HEADS.

    The remainder has the sign of c, as in SQL.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = segments.filter((F.col("segment") == 0) & (F.col("conv_id") == base)).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast(f"array<{TURN}>")), F.lit(1), h)
    first = segments.filter("segment = 0").join(heads, base == F.col("base"), "left")
    first = first.select("conv_id", "segment", F.concat(head, F.slice("turns", h + 1, F.lit(SEGMENT))).alias("turns"))
    return first.unionByName(segments.filter("segment > 0"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "turns")
    segments = numbered_segments(shared.table(spark, sf_dir, "conversations"), scratch)
    trie = prefix_trie(scratch.keep(rebuilt(segments)), spark)
    digests = end_digests(trie.ends)
    own = F.when(F.col("key1").isNull() & (F.col("n_ends") > 0), F.col("conv_id").cast("string")).otherwise("")
    keyed = trie.nodes.join(digests, NODE, "left")
    return keyed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(own, 256)).alias("ends_sha256"),
    )


# A shared table of 256 entries is not needed: each byte takes eight steps with the reflected polynomial 0xEDB88320.
ORACLE = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, 4294967295::BIGINT AS v, CAST(c AS VARCHAR) AS s, 0 AS i FROM ids UNION ALL
  SELECT c, list_reduce([xor(v, ascii(s[1]))] || range(8), lambda a, x: xor(a >> 1, (a & 1) * 3988292384)), s[2:], i + 1 FROM crc WHERE length(s) > 0),
heads AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE length(s) = 0),
own AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
full_path AS (SELECT o.c, coalesce(b.t[:h], []) || coalesce(o.t[h + 1:], []) AS t FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 5),
steps AS (SELECT c, t, len(t) AS n, unnest(range(len(t) + 1)) AS depth FROM full_path),
member AS (SELECT c, n, depth, t[:depth] AS p, CASE WHEN depth > 0 THEN strlen(t[depth].text) ELSE 0 END AS bytes FROM steps),
node AS (SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, count(*) FILTER (n > depth) AS longer,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '') AS ends FROM member GROUP BY depth, p),
below AS (SELECT a.depth, a.p, count(*) FILTER (d.longer = 0) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved_tokens,
  count(*) FILTER (d.depth = a.depth + 1) AS n_children FROM node a JOIN node d ON d.depth >= a.depth AND d.p[:a.depth] = a.p GROUP BY a.depth, a.p)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN below USING (depth, p) LEFT JOIN node u ON u.depth = n.depth - 1 AND u.p = n.p[:n.depth - 1]
"""
