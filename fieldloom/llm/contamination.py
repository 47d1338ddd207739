"""Benchmark decontamination: item-sized windows lined up by shared shingles, exact verification.

Windows are as long as the benchmark item they may hold. A window without one shingle of an item has similarity 0
with it, so only pairs of a window and an item that a shared shingle lines up are made: a fixed-size bit filter over
the benchmark's shingles tests every shingle of every document, and what passes is joined to the benchmark. The windows
so placed get SimHashes, which are sought in a multi-index of the items' SimHashes: of RADIUS + 1 blocks of bits, two
fingerprints within RADIUS share at least one. Weighted Jaccard (shingles weigh as often as they occur) decides each
pair found. Pairs that a shingle lines up beyond the radius are verified too, so that the index loses nothing. Native
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import let
from fieldloom.llm import shared
from fieldloom.llm.shared import Scratch

WIDTH = 5
SIMILARITY = 0.75
BITS = 64
RADIUS = 24  # Hamming distance within which the index finds items; beyond it, pairs lined up by a shingle are verified
SLACK = 1  # words by which a window may lie off the line-up of a shared shingle
FILTER_BITS = 1 << 20  # of the bit filter, whatever the benchmark's size: more items let more documents through
PROBES = 3


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; texts with fewer words have none."""
    def of(words: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)])
        return F.when(F.size(words) < WIDTH, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0))), gram)
        )

    return let(shared.split_words(F.lower(F.coalesce(text.cast("string"), F.lit("")))), of)


def simhash(hashes: Column) -> Column:
    """One bit per position: do more of the hashes have it set than not? Repeated hashes count repeatedly."""
    def of(hs: Column) -> Column:
        ones = lambda j: F.aggregate(hs, F.lit(0), lambda a, h: a + F.call_function("shiftright", h, j).bitwiseAND(F.lit(1)).cast("int"))
        bit = lambda j: F.when(2 * ones(j) > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda a, j: a.bitwiseOR(bit(j)))

    return let(hashes, of)


def numbered(hashes: Column) -> Column:
    """The hashes with repeats told apart, so that sets of them are multisets of hashes."""
    def of(hs: Column) -> Column:
        nth = lambda h, i: F.size(F.filter(F.slice(hs, F.lit(1), i), lambda x: x == h))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), hs).otherwise(
            F.transform(hs, lambda h, i: F.when(nth(h, i) > 0, F.xxhash64(h, nth(h, i))).otherwise(h))
        )

    return let(hashes, of)


def weighted_jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _probes(h: Column) -> list[Column]:
    return [F.pmod(F.call_function("shiftright", h, F.lit(k * 20)), F.lit(FILTER_BITS)) for k in range(PROBES)]


def _bit_filter(index: DataFrame) -> Column:
    """The benchmark's shingles as a literal of FILTER_BITS bits."""
    bit = index.select(F.explode(F.array(*_probes(F.col("hash")))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    set_bits = dict(tuple(r) for r in bit.groupBy((F.col("bit") / 64).cast("int").alias("at")).agg(F.bit_or(one)).collect())
    longs = ",".join(str(set_bits.get(k, 0)) for k in range(FILTER_BITS // 64))
    return F.split(F.lit(longs), ",").cast("array<bigint>")  # folded to one literal


def blocks(sim: Column, radius: int = RADIUS) -> Column:
    """The bits of a fingerprint as radius + 1 numbers; fingerprints within the radius agree in one at least."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[
        F.call_function("shiftrightunsigned", sim, F.lit(low)).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])
    ])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_items(windows: DataFrame, bench: DataFrame, radius: int = RADIUS) -> DataFrame:
    """row_hash, item_id, m, start: windows and items of one length within the radius, each pair once, by shared blocks."""
    probes = windows.select("row_hash", "m", "start", "sim", blocks(F.col("sim"), radius).alias("blocks"))
    probes = probes.select("*", F.posexplode("blocks").alias("block", "value"))
    index = bench.select("item_id", "m", F.col("sim").alias("item_sim"), blocks(F.col("sim"), radius).alias("item_blocks"))
    index = index.select("*", F.posexplode("item_blocks").alias("block", "value"))
    first = F.array_position(F.zip_with("blocks", "item_blocks", lambda a, b: a == b), True) - 1  # a pair counts in its first shared block
    return probes.join(index, ["m", "block", "value"]).filter(
        (F.col("block") == first) & (hamming(F.col("sim"), F.col("item_sim")) <= radius)
    ).select("row_hash", "item_id", "m", "start")


def row_hash() -> Column:
    """What tells rows apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def find_leaks(docs: DataFrame, items: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """doc_id, row_hash, item_id, start_word, n_words, hamming, similarity: the best window of each document and item.

    * Null and short texts (fewer than five words) and items hold no shingles and match nothing.
    * Rows are told apart by row_hash, a hash of doc_id and text; rows that repeat one another completely give one result.
      Of equally similar windows the first is reported. Equal items are all reported.
    * Other columns are ignored. Empty tables give an empty result.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "contamination")
    bench = items.select("item_id", shingles(F.col("text")).alias("grams")).filter(F.size("grams") > 0)
    bench = scratch.keep(bench.select("item_id", "grams", F.size("grams").alias("m"), simhash(F.col("grams")).alias("sim"), numbered(F.col("grams")).alias("bag")))
    index = bench.select("item_id", "m", F.posexplode("grams").alias("at", "hash")).distinct()
    longest = bench.agg(F.max("m")).first()[0] or 1
    bits = _bit_filter(index)

    def passes(h: Column) -> Column:
        found = F.lit(True)
        for p in _probes(h):
            found = found & (F.call_function("shiftright", F.get(bits, (p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found

    def seeds(grams: Column) -> Column:
        # Bound once: the lambdas below would otherwise compute the shingles anew for every element.
        at = lambda g: F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0)))
        return let(grams, lambda g: F.filter(at(g), lambda i: F.coalesce(passes(F.get(g, i)), F.lit(False))))

    texts = docs.select("doc_id", row_hash().alias("row_hash"), shingles(F.col("text")).alias("grams"))
    texts = scratch.keep(texts.withColumn("seeds", seeds(F.col("grams"))).filter(F.size("seeds") > 0))
    hits = texts.select("row_hash", F.size("grams").alias("n"), F.explode(F.transform("seeds", lambda i: F.struct(i.alias("pos"), F.get("grams", i).alias("hash")))).alias("s"))
    lined = hits.select("row_hash", "n", "s.*").join(index, "hash").select(
        "row_hash", "item_id", "m", "n", F.explode(F.sequence(F.col("pos") - F.col("at") - SLACK, F.col("pos") - F.col("at") + SLACK)).alias("start")
    )
    lined = lined.select("row_hash", "item_id", "m", F.greatest(F.least("start", F.col("n") - F.col("m")), F.lit(0)).alias("start"))
    lined = scratch.keep(lined.distinct())
    starts = lined.select("row_hash", "m", "start").distinct()
    # Overlapping segments of twice the longest item: each window lies in the one that it starts in.
    last = F.floor((F.size("grams") - 1) / longest).cast("int")
    parts = texts.select("doc_id", "row_hash", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda s: F.struct(s.alias("part"), F.slice("grams", s * longest + 1, F.lit(2 * longest)).alias("grams"))
    )).alias("p")).select("doc_id", "row_hash", "p.*").dropDuplicates(["row_hash", "part"])
    windows = starts.withColumn("part", F.floor(F.col("start") / longest).cast("int")).join(parts, ["row_hash", "part"]).select(
        "doc_id", "row_hash", "m", "start", F.slice("grams", F.col("start") - F.col("part") * longest + 1, F.col("m")).alias("w")
    )
    windows = scratch.keep(windows.select("doc_id", "row_hash", "m", "start", numbered(F.col("w")).alias("bag"), simhash(F.col("w")).alias("sim")))
    items_by_id = bench.select("item_id", F.col("bag").alias("item_bag"), F.col("sim").alias("item_sim"))
    beyond = lined.join(windows.select("row_hash", "m", "start", "sim"), ["row_hash", "m", "start"]).join(
        items_by_id.select("item_id", "item_sim"), "item_id"
    ).filter(hamming(F.col("sim"), F.col("item_sim")) > RADIUS).select("row_hash", "item_id", "m", "start")
    met = near_items(windows, bench).unionByName(beyond)
    checked = met.join(windows, ["row_hash", "m", "start"]).join(items_by_id, "item_id").withColumn(
        "similarity", weighted_jaccard(F.col("bag"), F.col("item_bag"))
    ).filter(F.col("similarity") >= SIMILARITY).withColumn("hamming", hamming(F.col("sim"), F.col("item_sim")))
    best = F.min_by(F.struct("start", "m", "hamming", "similarity"), F.struct(-F.col("similarity"), "start", "m", "hamming"))
    return checked.groupBy("doc_id", "row_hash", "item_id").agg(best.alias("b")).select(
        "doc_id", "row_hash", "item_id", F.col("b.start").alias("start_word"), (F.col("b.m") + WIDTH - 1).alias("n_words"),
        F.col("b.hamming").alias("hamming"), F.round("b.similarity", 6).alias("similarity"),
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"), spark)
    return leaks.drop("row_hash")
