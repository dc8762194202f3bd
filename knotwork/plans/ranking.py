"""Global ranks and running sums without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans.materialize import written

PART_BITS = 33  # of monotonically_increasing_id: rows within a partition


def ranked(rows: DataFrame, *order: Column | str, into: str = "position") -> DataFrame:
    """``rows`` with their place from 0 by ``order``, which should tell all rows apart.

    A range-partitioned sort numbers the rows of each partition; the partitions' sizes, one row for each, are summed up apart.
    """
    own = rows.columns
    sorted_rows = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", PART_BITS)
    sizes = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__k"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__start"))
    placed = sorted_rows.withColumn("__part", part).join(starts, "__part")
    return placed.select(*own, (F.col("__start") + F.col("__at").bitwiseAND((1 << PART_BITS) - 1)).cast("long").alias(into))


def running_sums(rows: DataFrame, order: list[Column | str], amounts: dict[str, str]) -> DataFrame:
    """``rows`` with, for each ``amount: into``, the sum of ``amount`` over the rows before by ``order``, which should tell all rows apart.

    Like :func:`ranked`: windows run within the partitions of a sort, and over one row for each partition.
    """
    own = rows.columns
    sorted_rows = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sums").withColumn("__part", F.shiftright("__at", PART_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    sums = sorted_rows.groupBy("__part").agg(*(F.sum(c).alias(f"__sum_{into}") for c, into in amounts.items()))
    starts = sums.select("__part", *(F.coalesce(F.sum(f"__sum_{into}").over(before), zero).alias(f"__start_{into}") for into in amounts.values()))
    placed = sorted_rows.select("*", *(F.coalesce(F.sum(c).over(within), zero).alias(f"__within_{into}") for c, into in amounts.items())).join(starts, "__part")
    return placed.select(*own, *((F.col(f"__within_{into}") + F.col(f"__start_{into}")).alias(into) for into in amounts.values()))
