"""Mixing sources to target weights: pivotal dependent rounding in a distributed reduction tree.

A source whose target is r times its size takes every document floor(r) times and some once more. The
fractional part of r is the copy probability of each document; its mass (probability × words) is kept
as a whole number of 2^-20 words. Pivotal steps pair two documents and move mass from one to the other,
in a random direction that leaves each one's expected mass as it was, until one is at zero or full. Mass is
never lost, so the words a source takes differ from its target by at most one document's size.

A block of some hundred documents is folded to one undecided document; the undecided ones of the blocks
form the next, much smaller level, until a source has one left, which a weighted coin decides. Blocks are cut
by hash, so a source with a third of all rows is spread like any other. Draws are hashes: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldloom.llm import shared
from fieldloom.llm.shared import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and times of its size that a source may reach
UNIT = 1 << 20  # parts of a word
BLOCK = 128  # documents folded together, on average
SEED = 20


def word_count(text: Column) -> Column:
    """Number of runs of non-blanks."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(t, shared.WORD_PATTERN, "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


# ------------------------------------------------------------------------------ targets
def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``position``: the rank of ``source`` by code point, null last, from 0; no task sees all sources.

    Range partitions are ranked by themselves and shifted by the sizes of those before them.
    """
    ranged = sources.repartitionByRange(shared.shuffle_partitions(scratch.spark), F.col("source").asc_nulls_last())
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    shift = F.element_at(F.array(*map(F.lit, before or [0])), F.col("part") + 1)
    order = W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranged.withColumn("position", F.row_number().over(order) - 1 + shift).drop("part")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size → also target: the total shared by weight, what exceeds ``most`` times a size reshared."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    s = scratch.keep(ranked(sources, scratch).withColumn("weight", weight.cast("double")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None  # words per unit of weight; number of sources at their limit
    while True:
        capped = F.col("weight") * level > most * F.col("source_size")
        r = s.agg(F.count(F.when(capped, 1)).alias("n"), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)).alias("held"),
                  F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if r["n"] == full or not r["open"]:
            break
        full, level = r["n"], (total - r["held"]) / r["open"]
    return s.withColumn("target", F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double")))


# ------------------------------------------------------------------------------ pivotal rounding
def _pivot(a: Column, b: Column) -> tuple[Column, Column]:
    """Masses of a and b after a step; one of them is at zero or full."""
    up = F.least(a["room"] - a["mass"], b["mass"])  # what can move from b to a
    down = F.least(a["mass"], b["room"] - b["mass"])
    draw = F.pmod(F.xxhash64(F.lit(SEED), a["id"], b["id"], a["mass"], b["mass"]), F.greatest(up + down, F.lit(1)))
    moved = F.when(draw < down, up).otherwise(-down)
    return a["mass"] + moved, b["mass"] - moved


UNITS = "id long, room long, mass long"


def _folded(units: Column) -> Column:
    """Fold a block's units, large ones first, to decided units and at most one undecided one."""
    unit = f"struct<{UNITS.replace(' long', ':long')}>"
    units = F.reverse(F.array_sort(F.transform(units, lambda u: F.struct(u["room"].alias("room"), u["id"].alias("id"), u["mass"].alias("mass")))))
    start = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(f"array<{unit}>").alias("done"))

    def as_unit(u: Column, mass: Column) -> Column:
        return F.struct(u["id"].alias("id"), u["room"].alias("room"), mass.alias("mass"))

    def step(acc: Column, u: Column) -> Column:
        a = acc["open"]
        ma, mb = _pivot(a, u)
        undecided = lambda m, x: (m > 0) & (m < x["room"])
        both = F.array(as_unit(a, ma), as_unit(u, mb))
        rest = F.when(undecided(ma, a), as_unit(a, ma)).when(undecided(mb, u), as_unit(u, mb))
        ready = F.filter(both, lambda x: (x["mass"] <= 0) | (x["mass"] >= x["room"]))
        return F.when(a.isNull(), F.struct(as_unit(u, u["mass"]).alias("open"), acc["done"].alias("done"))).otherwise(
            F.struct(rest.alias("open"), F.concat(acc["done"], ready).alias("done"))
        )

    return F.aggregate(units, start, step)


def rounded(units: DataFrame, scratch: Scratch) -> DataFrame:
    """units (source, id, room, mass with 0 < mass < room) → id, taken (0 or 1), by pivotal steps in a tree."""
    decided, level = None, 0
    units = scratch.keep(units)
    while True:
        # The sizes of the sources at this level are joined on; a source larger than one block is cut by hash.
        blocks = units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        cut = F.pmod(F.xxhash64(F.lit(SEED + level), "id"), F.col("blocks")).alias("block")
        grouped = (
            units.join(scratch.keep(blocks.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
            .select("source", cut, F.struct("id", "room", "mass").alias("unit"))
            .groupBy("source", "block").agg(F.collect_list("unit").alias("units"))
        )
        folded = scratch.keep(grouped.select("source", _folded(F.col("units")).alias("f")))
        done = folded.select(F.explode("f.done").alias("u")).select("u.id", (F.col("u.mass") > 0).cast("int").alias("taken"))
        units = folded.filter("f.open IS NOT NULL").select("source", "f.open.*")
        if most == 1:  # one undecided unit per source: a coin
            coin = F.pmod(F.xxhash64(F.lit(SEED - 1), "id"), F.col("room")) < F.col("mass")
            last = units.select("id", coin.cast("int").alias("taken"))
            return done.unionByName(last) if decided is None else decided.unionByName(done).unionByName(last)
        decided, level = done if decided is None else decided.unionByName(done), level + 1
    return decided if decided is not None else units.select("id", F.lit(0).alias("taken")).limit(0)


def row_hash() -> Column:
    """What tells rows apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))


def mix_sources(docs: DataFrame, spark: SparkSession | None = None, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, row_hash, size, source_size, target, copies (0 … most), taken (size × copies): one row per input row.

    * Null and empty texts have size 0 and are taken 0 times; a null source is a source, ranked last.
    * Rows are told apart by doc_id, source and text, so null or repeated doc_ids are served too; rows that
      repeat one another completely are one unit and share its fate.
    * Columns besides doc_id, text and source are ignored. An empty table gives an empty result.
    """
    spark = spark or docs.sparkSession
    scratch = Scratch(spark, "mixing")
    own = docs.select("doc_id", F.col("source").cast("string"), word_count(F.col("text")).alias("size"),
                      row_hash().alias("id"))
    own = scratch.keep(own)
    sources = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = scratch.keep(targets(sources, scratch, weights, most).select(F.col("source").alias("of"), "source_size", "target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = own.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    repeats = planned.groupBy("source", "id").agg((F.sum("size")).alias("words"), F.first("part").alias("part"))
    units = repeats.select("source", "id", (F.col("words") * UNIT).alias("room"), F.floor(F.col("words") * UNIT * F.col("part")).alias("mass"))
    extra = rounded(units.filter("mass > 0 AND mass < room"), scratch)
    copies = F.least(F.col("whole") + F.coalesce("taken", F.lit(0)), F.lit(most)).cast("int")
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return planned.join(extra, "id", "left").select(
        "doc_id", F.col("id").alias("row_hash"), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return mix_sources(docs, spark).select("doc_id", "size", "source_size", "target", "taken")
