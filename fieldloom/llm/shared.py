"""Helpers of the training-data operators: hashed words, shared scratch tables, safe column names."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import shared_dir

_MIX = np.uint64(0x9E3779B97F4A7C15)
NO_HASHES = np.zeros(0, np.uint64)


# ------------------------------------------------------------------------------ scratch tables
class Scratch:
    """Tables written to the shared folder, so that a lost executor never loses a stage's input."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write once and read back: cuts the lineage, fixes the rows."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------------------ row filters
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 23
PROBES = 3


def _bits_of(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits)) for k in range(PROBES)]


def may_be_in(keys: DataFrame, key: Column) -> Column:
    """Is ``key`` perhaps among ``keys`` (one column)? False is certain, also for null.

    The keys fill a bit filter that travels as a literal of at most MOST_BITS bits, whatever their number: a fuller one
    answers true more often. So rows that are not concerned stay where they are, and the others are joined exactly.
    """
    name = keys.columns[0]
    keys = keys.filter(F.col(name).isNotNull())
    bits = min(max(1 << (16 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    bit = keys.select(F.explode(F.array(*_bits_of(F.col(name), bits))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    set_bits = dict(map(tuple, bit.groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.bit_or(one)).collect()))  # at most MOST_BITS / 64 rows
    words = F.split(F.lit(",".join(str(set_bits.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")  # folded to one literal
    found = key.isNotNull()
    for b in _bits_of(key, bits):
        found = found & (F.call_function("shiftright", F.get(words, F.floor(b / 64).cast("int")), (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(found, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------------------ native words
# The blanks that separate words, and the letters that are lower-cased.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column) -> Column:
    """Words between ASCII blanks; an empty array for null, empty or blank texts."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


# ------------------------------------------------------------------------------ hashed words
def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks with A-Z lower-cased; bytes methods treat just these characters so."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """The set of hashed word shingles, sorted; a shorter text is one shingle, no words give none."""
    if not words:
        return NO_HASHES
    h = word_hashes(words)
    if len(h) < width:
        h, width = mixed(h), len(h)
    rolled = h[: len(h) - width + 1]
    for k in range(1, width):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(rolled + np.uint64(width)))


def task_serial() -> int:
    """A number that a rerun of the same task repeats; tasks of one stage differ in it."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 24
