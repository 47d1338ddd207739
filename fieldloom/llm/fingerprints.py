"""Document fingerprints: threshold-scaled sketches of hashed word shingles.

A sketch keeps every hash below a fixed fraction of the hash space. A text with too few of them keeps its
FLOOR smallest hashes instead, so short texts are described (nearly) completely. Two sketches are compared
below the smaller of their thresholds, where both are complete; that gives mergeable, unbiased estimates of
similarity and containment, also between very unequal texts.

Native expressions only. The next document of a table comes from one shuffle of whole texts into blocks of
neighbouring doc_ids; the first row of a block is sent to its neighbour too, so no block needs another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.functions.text import let
from fieldloom.llm import shared

SPACE = 1 << 32  # hashes are 32 bits
FRACTION = 8  # one hash in so many is below the threshold
FLOOR = 64
WIDTH = 5


def shingle_set(text: Column, width: int = WIDTH) -> Column:
    """Distinct 32-bit hashes of the word shingles; fewer words are one shingle, none give an empty array."""
    def of(words: Column) -> Column:
        def gram(i: Column) -> Column:
            return F.pmod(F.xxhash64(*[F.get(words, i + k) for k in range(width)]), F.lit(SPACE))

        last = F.greatest(F.size(words) - width, F.lit(0))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(0), last), gram))
        )

    return let(shared.split_words(F.lower(text)), of)


def sketch(text: Column) -> Column:
    """struct limit (the sketch is complete below it), hashes (sorted)."""
    def of(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < SPACE // FRACTION)
        some = F.slice(F.array_sort(hashes), 1, FLOOR)
        whole = F.size(hashes) <= FLOOR
        short = F.struct(F.when(whole, F.lit(SPACE)).otherwise(F.element_at(some, -1) + 1).cast("bigint").alias("limit"), some.alias("hashes"))
        return F.when(F.size(low) >= FLOOR, F.struct(F.lit(SPACE // FRACTION).cast("bigint").alias("limit"), F.array_sort(low).alias("hashes"))).otherwise(short)

    return let(shingle_set(text), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index of the texts of two sketches, 0 to 1; two empty sketches are alike."""
    both = F.least(a["limit"], b["limit"])
    below = lambda s: F.filter(s["hashes"], lambda h: h < both)
    common, x, y = F.size(F.array_intersect(below(a), below(b))), F.size(below(a)), F.size(below(b))
    return F.when(x + y == 0, F.when(a["hashes"] == b["hashes"], 1.0).otherwise(0.0)).otherwise(common / (x + y - common))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    both = F.least(a["limit"], b["limit"])
    below = lambda s: F.filter(s["hashes"], lambda h: h < both)
    x = F.size(below(a))
    return F.when(x == 0, 1.0).otherwise(F.size(F.array_intersect(below(a), below(b))) / x)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    both = F.least(a["limit"], b["limit"])
    return F.struct(both.alias("limit"), F.filter(F.array_sort(F.array_union(a["hashes"], b["hashes"])), lambda h: h < both).alias("hashes"))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """Adds ``next``: a struct of text and sketch of the next document by descending doc_id, after the last the first.

    Null doc_ids come last; equal ones are ordered by a hash of the text. A single document is its own next one.
    Blocks end at quantiles of the doc_ids: a few numbers on the driver, as many as there are blocks.
    """
    shares = [k / blocks for k in range(1, blocks)]
    row = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares or [0.5])), 10_000).alias("q"), F.max("doc_id").alias("top")).first()
    ends = sorted({int(q) for q in row["q"] or [] if q != row["top"]})  # largest doc_id of each block but the topmost
    # Blocks count down: 0 has the largest doc_ids, the last one the smallest and the null ones.
    below = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e >= F.col("doc_id"))) if ends else F.lit(0)
    own = F.when(F.col("doc_id").isNull(), len(ends)).otherwise(below).cast("int")
    # The first row of every block visits the block before it; the first of all visits the last.
    stay = F.struct(own.alias("block"), F.lit(0).alias("guest"))
    visit = F.when(F.col("doc_id").isin(ends), F.struct((own - 1).alias("block"), F.lit(1).alias("guest")))
    wrap = F.when(F.col("doc_id").eqNullSafe(F.lit(row["top"]).cast("long")), F.struct(F.lit(len(ends)).alias("block"), F.lit(2).alias("guest")))
    placed = docs.withColumn("place", F.explode(F.filter(F.array(stay, visit, wrap), lambda p: p.isNotNull())))
    window = W.partitionBy("place.block").orderBy("place.guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return placed.withColumn("next", F.lead(F.struct("text", "sketch")).over(window)).filter("place.guest = 0").drop("place")


def edited(text: Column, other: Column) -> Column:
    """The last third of a text replaced by as many of the first characters of another."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def fingerprints(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, sketch, edited text and sketch, next sketch: one row per input row.

    * Null texts are empty texts; texts without words have an empty sketch.
    * Ties and repeated rows: see `with_next`; equal texts have equal sketches.
    * Columns besides doc_id and text are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("sketch", sketch(F.col("text"))), blocks)
    return pairs.withColumn("edited", edited(F.col("text"), F.col("next.text"))).withColumn("edited_sketch", sketch(F.col("edited")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(shared.table(spark, sf_dir, "documents"), shared.shuffle_partitions(spark) * 2)
    own, edit = F.col("sketch"), F.col("edited_sketch")
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"), as_text(edit).alias("edited_fingerprint"),
        likeness(own, edit).alias("near_edited"), likeness(own, F.col("next.sketch")).alias("near_next"),
    )
