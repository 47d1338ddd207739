r"""N-gram Jaccard join: multiple-global-order prefix filters, hub verification, components.

Two texts link when their sets of five-word shingles have a Jaccard index of at least 0.75. A text
that links with another shares at least one token of its prefix with it, whatever total order of all
tokens the prefixes are cut from. The join cuts prefixes under several orders (rare tokens first, ties
by differently salted hashes) and verifies only pairs that meet under all of them.

1. `set_sizes`: equal sets collapse to the smallest doc_id.
2. `rare_first`: exact document counts of all tokens. Tokens travel in packed blobs; tokens that many
   documents of one chunk hold travel once with a count, so no token gathers its documents in one task.
   Back come, per document, its tokens that others hold too, and its prefixes under every order.
   A document whose prefix holds unique tokens alone can link with nothing and ends here.
3. `verified_links`: buckets of documents with a common prefix token are not expanded into pairs, but for
   those of at most SMALL documents. In a larger one the document with most shared tokens (its hub) is compared
   with all others. For the hub h, |x ∩ y| is at most min(|x ∩ h|, |y ∩ h|) + min(|x \ h|, |y \ h|), where only
   tokens that two members of the bucket share count outside h; members that links have not yet connected to the hub are paired with those
   members for which this bound reaches what a link needs, and verified.
4. `components`: alternating large and small stars over the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import shared
from fieldloom.llm.shared import Scratch

ORDERS = 2
SMALL = 24  # documents of a bucket that is expanded into pairs
PERCENT = 75
WIDTH = 5
CHUNK_TOKENS = 1 << 20  # tokens that travel together; bounds the memory of a task, not the result
CHUNK_DOCS = 60_000  # document numbers within a chunk fit 16 bits
HOT_IN_CHUNK = 64  # documents of one chunk from which on a token travels once with its count

BLOBS = "bucket long, chunk long, tokens binary, docs binary, hot binary, hot_n binary, head binary"
PREFIXED = "doc_id long, n int, tokens binary, " + ", ".join(f"p{k} array<long>" for k in range(ORDERS))


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def _planes(a: np.ndarray) -> bytes:
    """Bytes of sorted integers, most significant ones together: they repeat and compress."""
    return a.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    if not b:
        return shared.NO_HASHES
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


# ------------------------------------------------------------------------------ sets
def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set_key (128-bit hash of the set, null when it is empty); a row per row."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for text in batch.column(1).to_pylist():
                s = shared.shingle_hashes(shared.lower_words(text), WIDTH)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "n", "set_key"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sizes, "doc_id long, n int, set_key binary"
    )


# ------------------------------------------------------------------------------ token counts
def _packed(buckets: int):
    """Chunks of documents → one blob of sorted tokens per bucket, and one header per chunk."""

    def flush(chunk: int, ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(sets)
        docs = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.r_[start, len(tokens)])
        hot = np.repeat(count > HOT_IN_CHUNK, count)
        hot_tokens, hot_n = tokens[start][count > HOT_IN_CHUNK], count[count > HOT_IN_CHUNK].astype(np.uint32)
        head = b"".join([
            np.uint32([len(sets), hot.sum()]).tobytes(), np.int64(ids).tobytes(),
            np.uint32([len(s) for s in sets]).tobytes(), tokens[hot].tobytes(), docs[hot].tobytes(),
        ])
        tokens, docs = tokens[~hot], docs[~hot]
        width = (1 << 64) // buckets + 1
        edges = np.array([min(b * width, (1 << 64) - 1) for b in range(1, buckets)], np.uint64)
        cut, hot_cut = np.r_[0, np.searchsorted(tokens, edges), len(tokens)], np.r_[0, np.searchsorted(hot_tokens, edges), len(hot_tokens)]
        rows = [
            (b, chunk, _planes(tokens[i:j]), docs[i:j].tobytes(), hot_tokens[p:q].tobytes(), hot_n[p:q].tobytes(), None)
            for b, (i, j, p, q) in enumerate(zip(cut[:-1], cut[1:], hot_cut[:-1], hot_cut[1:])) if j > i or q > p
        ]
        rows.append((int(shared.mixed(np.array([chunk], np.uint64))[0]) % buckets, chunk, None, None, None, None, head))
        types = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        names = ["bucket", "chunk", "tokens", "docs", "hot", "hot_n", "head"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, sets, size = shared.task_serial(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shared.shingle_hashes(shared.lower_words(text), WIDTH)
                if doc_id is None or not len(s):
                    continue
                ids.append(doc_id)
                sets.append(s)
                size += len(s)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield flush(chunk, ids, sets)
                    chunk, ids, sets, size = chunk + 1, [], [], 0
        if ids:
            yield flush(chunk, ids, sets)

    return pack


def _blob(cell) -> bytes:
    return cell.as_py() or b""


def _counted(table: pa.Table) -> pa.Table:
    """One bucket: count each token's documents, send back to every chunk those that are not unique."""
    heads = table.filter(pc.is_valid(table["head"]))
    table = table.filter(pc.is_null(table["head"]))
    chunks = table["chunk"].to_pylist()
    tokens = [_unplanes(_blob(x)) for x in table["tokens"]]
    docs = [np.frombuffer(_blob(x), np.uint16) for x in table["docs"]]
    hot = [np.frombuffer(_blob(x), np.uint64) for x in table["hot"]]
    hot_n = [np.frombuffer(_blob(x), np.uint32).astype(np.int64) for x in table["hot_n"]]
    out = [(c, None, None, None, None, None, h) for c, h in zip(heads["chunk"].to_pylist(), heads["head"].to_pylist())]
    if chunks:
        every = np.concatenate(tokens + hot)
        weight = np.concatenate([np.ones(sum(map(len, tokens)), np.int64)] + hot_n)
        known, where = np.unique(every, return_inverse=True)
        df = np.bincount(where, weight).astype(np.int64)
        level = np.where(df > 1, np.ceil(np.log2(df)), 0).astype(np.uint8)[where]
        at = np.cumsum([0] + [len(x) for x in tokens + hot])
        for k, c in enumerate(chunks):
            mine = level[at[k] : at[k + 1]]
            some = mine > 0
            spread = level[at[len(chunks) + k] : at[len(chunks) + k + 1]]
            if some.any() or len(spread):
                out.append((c, _planes(tokens[k][some]), docs[k][some].tobytes(), mine[some].tobytes(), hot[k].tobytes(), spread.tobytes(), None))
    types = [pa.int64()] + [pa.binary()] * 6
    names = ["chunk", "tokens", "docs", "level", "hot", "hot_level", "head"]
    columns = list(zip(*out)) if out else [()] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)


def _prefixes(table: pa.Table) -> pa.Table:
    """One chunk: its documents' shared tokens and prefixes, for documents that may link at all."""
    head = next(x for x in table["head"].to_pylist() if x is not None)
    n_docs, n_hot = np.frombuffer(head, np.uint32, 2).tolist()
    at = 8
    ids = np.frombuffer(head, np.int64, n_docs, at)
    sizes = np.frombuffer(head, np.uint32, n_docs, at := at + 8 * n_docs)
    hot_tokens = np.frombuffer(head, np.uint64, n_hot, at := at + 4 * n_docs)
    hot_docs = np.frombuffer(head, np.uint16, n_hot, at + 8 * n_hot)
    rows = [r for r in table.to_pylist() if r["head"] is None]
    tokens = np.concatenate([shared.NO_HASHES] + [_unplanes(r["tokens"]) for r in rows])
    docs = np.concatenate([np.zeros(0, np.uint16)] + [np.frombuffer(r["docs"], np.uint16) for r in rows])
    level = np.concatenate([np.zeros(0, np.uint8)] + [np.frombuffer(r["level"], np.uint8) for r in rows])
    if n_hot:
        known = np.concatenate([np.frombuffer(r["hot"], np.uint64) for r in rows])
        known_level = np.concatenate([np.frombuffer(r["hot_level"], np.uint8) for r in rows])
        order = np.argsort(known)
        hot_level = known_level[order][np.searchsorted(known[order], hot_tokens)]
        tokens, docs, level = np.r_[tokens, hot_tokens], np.r_[docs, hot_docs], np.r_[level, hot_level]
    by_doc = np.lexsort((tokens, docs))
    tokens, docs, level = tokens[by_doc], docs[by_doc], level[by_doc]
    cut = np.searchsorted(docs, np.arange(n_docs + 1))
    salted = [shared.mixed(tokens ^ np.uint64(k + 1)) for k in range(ORDERS)]
    out = []
    for d in range(n_docs):
        i, j, n = cut[d], cut[d + 1], int(sizes[d])
        room = prefix_length(n) - (n - (j - i))  # unique tokens come first in every order
        if room > 0 and j > i:
            firsts = [tokens[i:j][np.lexsort((s[i:j], level[i:j]))[:room]].astype(np.int64).tolist() for s in salted]
            out.append((int(ids[d]), n, tokens[i:j].tobytes(), *firsts))
    types = [pa.int64(), pa.int32(), pa.binary()] + [pa.list_(pa.int64())] * ORDERS
    names = ["doc_id", "n", "tokens"] + [f"p{k}" for k in range(ORDERS)]
    columns = list(zip(*out)) if out else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)


def rare_first(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n, tokens (those other documents hold too), p0, p1 … (prefixes): documents that may link."""
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_packed(buckets), BLOBS)
    counted = packed.groupBy("bucket").applyInArrow(
        _counted, "chunk long, tokens binary, docs binary, level binary, hot binary, hot_level binary, head binary"
    )
    return counted.groupBy("chunk").applyInArrow(_prefixes, PREFIXED)


# ------------------------------------------------------------------------------ verification
def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, outside = [], []
        for x, y, hub in zip(*(batch.column(c).to_pylist() for c in ("a_tokens", "b_tokens", "hub"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.isin(y, x, assume_unique=True)
            sizes.append(int(both.sum()))
            outside.append(y[~both].astype(np.int64) if hub else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("hub"), pa.array(sizes, pa.int32()), pa.array(outside, pa.list_(pa.int64()))],
            ["a", "b", "hub", "common", "outside"],
        )


def _of(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(side if c == "doc_id" else f"{side}_{c}") for c in df.columns])


def _needed(n: Column, m: Column) -> Column:
    """The smallest overlap that links sets of these sizes."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def _meetings(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs a, b to compare: all pairs of small buckets, the hub with all others of large ones (hub = true)."""
    rows = slim.select("doc_id", F.explode("p0").alias("token"), "shared")
    buckets = scratch.keep(rows.groupBy("token").agg(
        F.max_by("doc_id", F.struct("shared", -F.col("doc_id"))).alias("top"), F.count(F.lit(1)).alias("members")
    ).filter("members > 1"))
    large = rows.join(buckets.filter(F.col("members") > SMALL), "token").filter("doc_id != top")
    small = rows.join(buckets.filter(F.col("members") <= SMALL), "token").groupBy("token").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    pairs = small.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(
        F.slice("ids", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b"))
    )))).alias("p")).select("p.*", F.lit(False).alias("hub"))
    hubs = large.select(F.col("top").alias("a"), F.col("doc_id").alias("b"), F.lit(True).alias("hub"))
    return pairs.unionByName(hubs).groupBy("a", "b").agg(F.bool_or("hub").alias("hub"))


def _compare(pairs: DataFrame, slim: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, hub, common of the pairs that pass every order's filter; pairs with a hub are compared in any case."""
    sides = slim.select("doc_id", "n", "shared", *[f"p{k}" for k in range(1, ORDERS)])
    both = pairs.join(_of(sides, "a"), "a").join(_of(sides, "b"), "b")
    passes = _needed(F.col("a_n"), F.col("b_n")) <= F.least("a_shared", "b_shared")
    for k in range(1, ORDERS):
        passes = passes & F.arrays_overlap(f"a_p{k}", f"b_p{k}")
    left = scratch.keep(both.filter(F.col("hub") | passes).select("a", "b", "hub"))
    # Only the tokens of documents that are compared are moved.
    compared = left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    tokens = sets.select("doc_id", "tokens").filter(shared.may_be_in(scratch.keep(compared), F.col("doc_id")))
    return scratch.keep(left.join(_of(tokens, "a"), "a").join(_of(tokens, "b"), "b").mapInArrow(_common, "a long, b long, hub boolean, common int, outside array<long>"))


def _linked(compared: DataFrame, slim: DataFrame) -> DataFrame:
    n = slim.select("doc_id", "n")
    both = compared.join(_of(n, "a"), "a").join(_of(n, "b"), "b")
    return both.filter(100 * F.col("common") >= PERCENT * (F.col("a_n") + F.col("b_n") - F.col("common"))).select("a", "b")


def _only(rows: DataFrame, those: DataFrame) -> DataFrame:
    """One row of each doc_id, of those whose doc_id and n are among ``those``.

    Sizes are compared beside the join, not as its key: so rows meet and are made single in one shuffle by doc_id.
    """
    those = those.select(F.col("doc_id").alias("_id"), F.col("n").alias("_n"))
    met = rows.join(those, (F.col("doc_id") == F.col("_id")) & (F.col("n") <= F.col("_n")) & (F.col("n") >= F.col("_n")), "left_semi")
    return met.dropDuplicates(["doc_id"])


def verified_links(raw: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links a, b between the kept documents: enough of them to connect whatever links connect."""
    slim = raw.select("doc_id", "n", (F.length("tokens") / 8).cast("int").alias("shared"), *[f"p{k}" for k in range(ORDERS)])
    slim = scratch.keep(_only(slim, kept))
    met = scratch.keep(_meetings(slim, scratch))
    members = met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    members = scratch.keep(slim.select("doc_id", "n").join(members, "doc_id", "left_semi"))
    sets = raw.select("doc_id", "n", "tokens").filter(shared.may_be_in(members.select("doc_id"), F.col("doc_id")))
    sets = scratch.keep(_only(sets, members).select("doc_id", "tokens"))
    compared = _compare(met, slim, sets, scratch)
    links = scratch.keep(_linked(compared, slim))

    # Members of large buckets that are not connected to their hub, against the members they may still link with.
    label = components(links, scratch).select(F.col("node").alias("doc_id"), "label")
    named = slim.select("doc_id", "n", "shared").join(label, "doc_id", "left").select("doc_id", "n", "shared", F.coalesce("label", "doc_id").alias("label"))
    group = compared.filter("hub").select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), F.col("common").alias("inside"))
    group = group.join(named, "doc_id").join(named.select(F.col("doc_id").alias("hub"), F.col("label").alias("hub_label")), "hub")
    beyond = compared.filter("hub").select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), F.explode("outside").alias("token"))
    twice = scratch.keep(beyond.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    beyond = beyond.join(twice, ["hub", "token"]).groupBy("hub", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("outside"))
    group = group.join(beyond, ["hub", "doc_id"], "left").fillna(0, ["outside"])
    group = scratch.keep(group.withColumn("open", F.col("label") != F.col("hub_label")))
    x, y = _of(group.drop("hub_label"), "a"), _of(group.drop("hub_label"), "b")
    bound = F.least("a_inside", "b_inside") + F.least("a_outside", "b_outside")
    more = x.filter("a_open").join(y, F.col("a_hub") == F.col("b_hub")).filter(
        (F.col("a_label") != F.col("b_label")) & (~F.col("b_open") | (F.col("a") < F.col("b")))
        & (_needed(F.col("a_n"), F.col("b_n")) <= bound)
    )
    more = scratch.keep(more.select("a", "b", F.lit(False).alias("hub")).distinct())
    return links.unionByName(_linked(_compare(more, slim, sets, scratch), slim))


# ------------------------------------------------------------------------------ components
def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (smallest node of its component) for nodes of edges a, b; stars by min, no collected group."""
    def largest_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())

    edges = scratch.keep(largest_first(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(largest_first(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        edges = scratch.keep(largest_first(
            hung.select("u", F.col("m").alias("v")).unionByName(hung.select(F.col("v").alias("u"), F.col("m").alias("v")))
        ))
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now


def jaccard_components(docs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Components of the Jaccard join: doc_id, n_shingles (long), component_id, one row per input row.

    * Null, empty or blank texts have no shingles and link with nothing; their component is themselves.
    * A null doc_id names no document: the row keeps its size, its component_id is null, it links nothing.
    * Repeated rows are equal sets, hence one component; rows with one doc_id and different texts count
      as one document that links with the copies of each of its texts, and with the near copies of one of them.
    * Columns besides doc_id and text are ignored. An empty table gives an empty result.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    sizes = scratch.keep(set_sizes(docs))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(shared.shuffle_partitions(spark), -(-total // (2 * CHUNK_TOKENS)))
    firsts = sizes.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    known = scratch.keep(sizes.join(firsts, "set_key", "left"))
    # Copies leave here: the smallest doc_id stands for its set.
    kept = known.filter("first = doc_id").select("doc_id", "n").distinct()
    edges = verified_links(scratch.keep(rare_first(docs, buckets)), kept, scratch)
    twice = known.filter("first IS NOT NULL").groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a != b")
    edges = edges.unionByName(twice.select("a", "b"))
    labels = components(edges, scratch)
    start = F.coalesce("first", "doc_id")
    return known.withColumn("node", start).join(labels, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("component_id"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(shared.table(spark, sf_dir, "documents"), spark)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
"""
