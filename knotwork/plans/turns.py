"""Work that moves many times its input: in turns, and with filters ahead of the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.plans.materialize import written

#: 64-bit words of a filter's row; fixed, so that what travels with a row does not grow with the table.
WORDS = 8


def in_turns(rows: DataFrame, by: str, turns: int, work: Callable[[DataFrame], DataFrame], label: str = "turn") -> DataFrame:
    """``work`` over all of ``rows``, a share of them at a time: rows with one hash of ``by`` go together.

    What a turn shuffles is deleted when its result is written, so disk holds a share of it at once. The results are written, and one table of all turns. ``rows`` are read
    once a turn. ``work`` must give the same over shares as over the whole.
    """
    share = F.pmod(F.xxhash64(F.lit("turn"), by), F.lit(turns))
    out: DataFrame | None = None
    for turn in range(max(turns, 1)):
        part = written(work(rows if turns <= 1 else rows.where(share == turn)), label)
        out = part if out is None else out.unionByName(part)
    return out


def turns_for(moved: int | None, most: int) -> int:
    """So many turns that each moves about ``most`` or less."""
    return max(1, -(-int(moved or 0) // max(most, 1)))


def _code(value: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("mark"), value), F.lit(64 * WORDS))


def marks(rows: DataFrame, key: str, value: str, *more: Column, into: str = "__m") -> DataFrame:
    """``(key, __m0, __m1, ...)``: 64 * WORDS bits for each key, one set for each of its values' hashes; and ``more`` aggregates."""
    return coded(rows, value).groupBy(key).agg(*more, *(F.bit_or(F.when(F.col("__word") == i, F.col("__bit")).otherwise(F.lit(0).cast("long"))).alias(f"{into}{i}") for i in range(WORDS)))


def coded(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with the word and the bit of ``value``, for :func:`may_hold`."""
    own = rows.columns
    at = rows.withColumn("__code", _code(F.col(value)))
    return at.select(*own, F.shiftright("__code", 6).alias("__word"), F.expr("shiftleft(1L, cast(__code & 63 as int))").alias("__bit"))


def may_hold(into: str = "__m") -> Column:
    """Whether a row's marks have the bit of a coded row. Some do by chance; no value that is there is lost."""
    word = F.col(f"{into}{WORDS - 1}")
    for i in range(WORDS - 2, -1, -1):
        word = F.when(F.col("__word") == i, F.col(f"{into}{i}")).otherwise(word)
    return word.bitwiseAND(F.col("__bit")) != 0
