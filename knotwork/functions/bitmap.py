"""Bitmaps as rows ``(key, block, mask)`` of 64-bit words; set algebra is joins and bit operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def pack(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, block, mask)`` of non-negative values."""
    bit = F.expr(f"shiftleft(1L, cast({value} % {WORD} as int))")
    return rows.where(F.col(value) >= 0).groupBy(F.col(key).alias("key"), F.expr(f"{value} div {WORD}").alias("block")).agg(F.bit_or(bit).alias("mask"))


def unpack(bitmaps: DataFrame) -> DataFrame:
    """``(key, value)``."""
    at = F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("at")
    bits = bitmaps.select("key", "block", "mask", at).where(F.expr("shiftrightunsigned(mask, at) & 1 = 1"))
    return bits.select("key", (F.col("block") * WORD + F.col("at")).alias("value"))


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``and``, ``or``, ``xor`` or ``andnot`` of bitmaps with equal keys; empty words are left out."""
    both = a.withColumnRenamed("mask", "__a").join(b.withColumnRenamed("mask", "__b"), ["key", "block"], "inner" if op == "and" else "full")
    x, y = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
    mask = {"and": x.bitwiseAND(y), "or": x.bitwiseOR(y), "xor": x.bitwiseXOR(y), "andnot": x.bitwiseAND(F.bitwise_not(y))}[op]
    return both.select("key", "block", mask.alias("mask")).where("mask <> 0")


def complement(bitmaps: DataFrame, size: int) -> DataFrame:
    """Within 0..size-1, for the keys there are."""
    blocks = (size + WORD - 1) // WORD
    every = bitmaps.select("key").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))))).withColumn("block", F.col("block").cast("long"))
    tail = size % WORD
    last = -1 if tail == 0 else (1 << tail) - 1
    valid = F.when(F.col("block") == blocks - 1, F.lit(last).cast("long")).otherwise(F.lit(-1).cast("long"))
    found = every.join(bitmaps, ["key", "block"], "left")
    return found.select("key", "block", F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long"))).bitwiseAND(valid).alias("mask")).where(F.col("mask") != 0)


def cardinality(bitmaps: DataFrame) -> DataFrame:
    """``(key, count)``."""
    return bitmaps.groupBy("key").agg(F.sum(F.bit_count("mask")).cast("long").alias("count"))


def union_all(bitmaps: DataFrame) -> DataFrame:
    """``(block, mask)``: the or over all keys."""
    return bitmaps.groupBy("block").agg(F.bit_or("mask").alias("mask"))


def intersects(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(key)`` of bitmaps that share a value."""
    both = a.withColumnRenamed("mask", "__a").join(b.withColumnRenamed("mask", "__b"), ["key", "block"])
    return both.where(F.col("__a").bitwiseAND(F.col("__b")) != 0).select("key").distinct()


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(key, jaccard)`` of bitmaps with equal keys."""
    common = cardinality(combine(a, b, "and")).withColumnRenamed("count", "c")
    either = cardinality(combine(a, b, "or")).withColumnRenamed("count", "e")
    return either.join(common, "key", "left").select("key", (F.coalesce("c", F.lit(0)) / F.col("e")).alias("jaccard"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(key, equal)`` for every key of either: whether both bitmaps hold the same values."""
    own, other = (x.where("mask <> 0").groupBy("key", "block").agg(F.bit_or("mask").alias(name)) for x, name in ((a, "__a"), (b, "__b")))
    return own.join(other, ["key", "block"], "full").groupBy("key").agg(F.every(F.col("__a").eqNullSafe(F.col("__b"))).alias("equal"))


def append(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Bitmaps of ``size`` bits followed by those of ``b``: each value of ``b`` comes ``size`` later."""
    shift, words = size % WORD, size // WORD
    low = b.select("key", (F.col("block") + words).alias("block"), F.shiftleft("mask", shift).alias("mask"))
    if shift:
        high = b.select("key", (F.col("block") + words + 1).alias("block"), F.shiftrightunsigned("mask", WORD - shift).alias("mask"))
        low = low.unionByName(high)
    return a.select("key", "block", "mask").unionByName(low.where("mask <> 0")).groupBy("key", "block").agg(F.bit_or("mask").alias("mask"))


def statistics(bitmaps: DataFrame, size: int) -> DataFrame:
    """``(key, dirty_words, empty_words, full_words, runs)`` of bitmaps of ``size`` bits, as a run-length form would count them.

    Dirty words hold both ones and zeros; ``runs`` are stretches of dirty words, each of which ends a stretch of clean ones.
    """
    words, tail = -(-size // WORD), size % WORD
    full = F.when(F.col("block") == words - 1, F.lit(-1 if not tail else (1 << tail) - 1)).otherwise(F.lit(-1)).cast("long")
    rows = bitmaps.where("mask <> 0").withColumn("dirty", F.col("mask") != full)
    before = F.lag("block").over(Window.partitionBy("key", "dirty").orderBy("block"))
    rows = rows.withColumn("starts", F.col("dirty") & (before.isNull() | (before < F.col("block") - 1)))
    dirty, whole = F.count_if("dirty"), F.count_if(~F.col("dirty"))
    return rows.groupBy("key").agg(dirty.alias("dirty_words"), (F.lit(words) - F.count("*")).alias("empty_words"), whole.alias("full_words"), F.count_if("starts").alias("runs"))
