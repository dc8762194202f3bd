"""Run-length bitmaps: rows ``(key, segment, runs)``, where ``runs`` is one binary value for SEGMENT bits of a key's bitmap.

A value is a sequence of 64-bit little-endian words: a marker, then its literal words, and so on. A marker's lowest bit is the
fill (all zeros or all ones), the next 32 bits say how many filled words come first, and the highest 31 bits how many literal words follow. Words after the last are
zeros, and empty segments have no row, so equal bitmaps have equal rows. A segment bounds what a task holds of a bitmap, however long that is.

Operations work on runs: both values' stretches are cut at each other's ends, one word of each decides for a whole stretch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.bitmap import WORD

SEGMENT_WORDS = 1 << 14
SEGMENT = SEGMENT_WORDS * WORD
_ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_ROWS = "key long, segment long, runs binary"

Stretches = tuple[np.ndarray, np.ndarray]  #: first places of stretches, ascending from 0, and the word that each repeats
_OPS: dict[str, Callable] = {"and": np.bitwise_and, "or": np.bitwise_or, "xor": np.bitwise_xor, "andnot": lambda x, y: x & ~y}


def stretches(words: np.ndarray, places: np.ndarray) -> Stretches:
    """Of the ``words`` at ascending ``places``; zeros everywhere else."""
    after = places + 1
    gaps = after[~np.isin(after, places, assume_unique=True)] if len(places) else after
    start = np.concatenate((np.zeros(0 if len(places) and places[0] == 0 else 1, dtype=np.int64), places, gaps[gaps < SEGMENT_WORDS]))
    word = np.concatenate((np.zeros(len(start) - len(places) - int((gaps < SEGMENT_WORDS).sum()), dtype=np.uint64), words, np.zeros(int((gaps < SEGMENT_WORDS).sum()), dtype=np.uint64)))
    order = np.argsort(start, kind="stable")
    return _merged(start[order], word[order])


def _merged(start: np.ndarray, word: np.ndarray) -> Stretches:
    """Neighbouring stretches of zeros, or of ones, become one."""
    same = np.concatenate(([False], (word[1:] == word[:-1]) & ((word[1:] == 0) | (word[1:] == _ONES))))
    return start[~same], word[~same]


def to_bytes(value: Stretches) -> bytes | None:
    """The serialised form; None for an empty segment."""
    start, word = value
    length = np.diff(np.concatenate((start, [SEGMENT_WORDS])))
    fill = (word == 0) | (word == _ONES)
    if fill[-1] and word[-1] == 0:
        start, word, length, fill = start[:-1], word[:-1], length[:-1], fill[:-1]
    if not len(start):
        return None
    # A marker stands before each fill, and before literals that follow none.
    begins = fill | np.concatenate(([True], np.zeros(len(fill) - 1, dtype=bool)))
    at = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    literals = np.bincount(group[~fill], minlength=len(at)).astype(np.uint64)
    filled = np.where(fill[at], length[at], 0).astype(np.uint64)
    marker = (word[at] == _ONES).astype(np.uint64) | filled << np.uint64(1) | literals << np.uint64(33)
    out = np.empty(len(at) + int(literals.sum()), dtype="<u8")
    place = np.arange(len(at)) + np.concatenate(([0], np.cumsum(literals)[:-1])).astype(np.int64)
    out[place] = marker
    rest = np.ones(len(out), dtype=bool)
    rest[place] = False
    out[rest] = word[~fill]
    return out.tobytes()


def from_bytes(raw: bytes | None) -> Stretches:
    """The inverse of :func:`to_bytes`."""
    words = np.frombuffer(raw or b"", dtype="<u8")
    start, word, at, here = [], [], 0, 0
    while at < len(words):
        marker = int(words[at])
        filled, literals = marker >> 1 & 0xFFFF_FFFF, marker >> 33
        if filled:
            start.append(np.array([here]))
            word.append(np.array([_ONES if marker & 1 else 0], dtype=np.uint64))
        start.append(here + filled + np.arange(literals))
        word.append(words[at + 1 : at + 1 + literals])
        at, here = at + 1 + literals, here + filled + literals
    if here < SEGMENT_WORDS:
        start.append(np.array([here]))
        word.append(np.array([0], dtype=np.uint64))
    return _merged(np.concatenate(start).astype(np.int64), np.concatenate(word).astype(np.uint64))


def combined(a: Stretches, b: Stretches, op: str) -> Stretches:
    start = np.union1d(a[0], b[0])
    of = lambda x: x[1][np.searchsorted(x[0], start, side="right") - 1]
    return _merged(start, _OPS[op](of(a), of(b)))


def inverted(value: Stretches, bits: int) -> Stretches:
    """Within the first ``bits`` of the segment."""
    whole, tail = divmod(min(bits, SEGMENT), WORD)
    limit = np.arange(whole, whole + (tail > 0))
    inside = stretches(np.full(1, (1 << tail) - 1, dtype=np.uint64)[: len(limit)], limit)
    ones = (np.array([0, whole]), np.array([_ONES, 0], dtype=np.uint64)) if 0 < whole < SEGMENT_WORDS else (np.array([0]), np.array([_ONES if whole else 0], dtype=np.uint64))
    return combined(combined(ones, inside, "or"), value, "andnot")


def _ones(value: Stretches) -> int:
    return int((np.bitwise_count(value[1]) * np.diff(np.concatenate((value[0], [SEGMENT_WORDS])))).sum())


def compress(bitmaps: DataFrame) -> DataFrame:
    """``(key, segment, runs)`` of a bitmap's rows ``(key, block, mask)``."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        value = to_bytes(stretches(rows["mask"].to_numpy().view(np.uint64), rows["block"].to_numpy() % SEGMENT_WORDS))
        return pd.DataFrame({"key": rows["key"].iloc[:1], "segment": rows["segment"].iloc[:1], "runs": [value]})

    once = bitmaps.where("mask <> 0").groupBy("key", "block").agg(F.bit_or("mask").alias("mask"))
    segments = once.select("key", F.expr(f"block div {SEGMENT_WORDS}").alias("segment"), "block", "mask")
    return segments.groupBy("key", "segment").applyInPandas(pack, _ROWS)


def expand(runs: DataFrame) -> DataFrame:
    """``(key, block, mask)``: the bitmap's words that hold a one."""

    def unpack(batches):
        for rows in batches:
            for key, segment, raw in zip(rows["key"], rows["segment"], rows["runs"], strict=True):
                start, word = from_bytes(raw)
                length = np.diff(np.concatenate((start, [SEGMENT_WORDS])))
                held = word != 0
                begin, count = start[held], length[held]
                block = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                yield pd.DataFrame({"key": key, "block": segment * SEGMENT_WORDS + block, "mask": np.repeat(word[held], count).view(np.int64)})

    return runs.mapInPandas(unpack, "key long, block long, mask long")


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``and``, ``or``, ``xor`` or ``andnot`` of bitmaps with equal keys; one join on (key, segment)."""
    if op not in _OPS:
        raise ValueError(f"unknown operation {op!r}")
    both = a.withColumnRenamed("runs", "x").join(b.withColumnRenamed("runs", "y"), ["key", "segment"], {"and": "inner", "andnot": "left"}.get(op, "full"))

    @F.pandas_udf("binary")
    def joined(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([to_bytes(combined(from_bytes(p), from_bytes(q), op)) for p, q in zip(x, y, strict=True)], dtype=object)

    return both.select("key", "segment", joined("x", "y").alias("runs")).where("runs is not null")


def union_all(runs: DataFrame, fan_in: int = 64) -> DataFrame:
    """``(segment, runs)``: the or over all keys, by groups of keys first, so that no task holds all keys of a segment."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        value = from_bytes(None)
        for raw in rows["runs"]:
            value = combined(value, from_bytes(raw), "or")
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "runs": [to_bytes(value)]})

    def partly(batches):
        for rows in batches:
            for _, group in rows.groupby("segment"):
                yield merge(group)

    few = runs.select("segment", "runs").mapInPandas(partly, "segment long, runs binary")
    salted = few.withColumn("salt", F.pmod(F.xxhash64("runs"), F.lit(fan_in)))
    once = salted.groupBy("segment", "salt").applyInPandas(merge, "segment long, runs binary")
    return once.groupBy("segment").applyInPandas(merge, "segment long, runs binary")


def complement(runs: DataFrame, size: int) -> DataFrame:
    """Within 0..size-1, for the keys there are."""
    last = max(0, (size - 1) // SEGMENT)
    every = runs.select("key").distinct().withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))

    @F.pandas_udf("binary")
    def flipped(segment: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([to_bytes(inverted(from_bytes(x), size - int(s) * SEGMENT)) for s, x in zip(segment, raw, strict=True)], dtype=object)

    return every.join(runs, ["key", "segment"], "left").select("key", "segment", flipped("segment", "runs").alias("runs")).where("runs is not null")


def cardinality(runs: DataFrame) -> DataFrame:
    """``(key, count)``."""

    @F.pandas_udf("long")
    def ones(raw: pd.Series) -> pd.Series:
        return pd.Series([_ones(from_bytes(x)) for x in raw], dtype="int64")

    return runs.select("key", ones("runs").alias("k")).groupBy("key").agg(F.sum("k").alias("count"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(key, equal)`` for every key of either: equal bitmaps are equal bytes."""
    both = a.withColumnRenamed("runs", "x").join(b.withColumnRenamed("runs", "y"), ["key", "segment"], "full")
    return both.groupBy("key").agg(F.every(F.col("x").eqNullSafe(F.col("y"))).alias("equal"))


def sizes(runs: DataFrame) -> DataFrame:
    """``(key, segments, words)``: 64-bit words that the values take, markers included."""
    return runs.groupBy("key").agg(F.count("*").alias("segments"), F.sum(F.expr("length(runs) div 8")).alias("words"))
