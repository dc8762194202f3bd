"""The filters of the Jaccard join under later token orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import jaccard_join
from knotwork.llm.jaccard_join import _SEEDS, _enough_shared, _in_buckets_of, apart_by_buckets, order_prefix

ROW = ", ".join(f"{x}_n int, {x}_second array<smallint>, {x}_second_end long" for x in "ab")


def _pair(rng, shared: int, only_a: int, only_b: int, percent: int):
    tokens = rng.integers(0, 1 << 63, shared + only_a + only_b, dtype=np.uint64)
    row = []
    for own in (tokens[: shared + only_a], np.concatenate((tokens[:shared], tokens[shared + only_a :]))):
        first, end = order_prefix(np.unique(own), _SEEDS[1], percent)
        row += [len(own), first.tolist(), end]
    return row


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_similar_sets_pass(spark, percent):
    rng = np.random.default_rng(percent)
    rows = []
    for _ in range(150):
        shared = int(rng.integers(1, 400))
        others = int(rng.integers(0, shared * (100 - percent) // percent + 1))
        only_a = int(rng.integers(0, others + 1))
        rows.append(_pair(rng, shared, only_a, others - only_a, percent))
    rows.append(_pair(rng, 20_000 * percent // 100, 20_000 - 20_000 * percent // 100, 0, percent))
    found = spark.createDataFrame(rows, ROW).where(_enough_shared("second", percent)).count()
    assert found == len(rows)


@pytest.mark.parametrize("n", [300, 3_000, 20_000])
def test_sets_that_share_a_passage_fall(spark, n):
    rng = np.random.default_rng(n)
    rows = [_pair(rng, n // 6, n - n // 6, n - n // 6, 75) for _ in range(20)]
    assert spark.createDataFrame(rows, ROW).where(_enough_shared("second", 75)).count() == 0


def test_buckets_lose_no_asked_row(spark, monkeypatch):
    rows, asked = spark.range(5_000).withColumnRenamed("id", "key"), spark.range(0, 5_000, 7).withColumnRenamed("id", "key")
    for buckets in (1, 64, 1 << 20):
        monkeypatch.setattr(jaccard_join, "ASKED_BUCKETS", buckets)
        left = _in_buckets_of(rows, asked, "key")
        assert left.join(asked, "key", "left_semi").count() == asked.count()
    assert left.count() < 800
    none = spark.createDataFrame([(None,), (1,)], "key long")
    assert {r.key for r in _in_buckets_of(none, none.where(F.col("key") == 1), "key").collect()} >= {1}


def test_buckets_part_all_rows(spark, monkeypatch):
    """Few of the rows that nothing asks for are held to be asked, also with more keys than 2^20 buckets could tell apart, and nulls are rows as others are."""
    rows = spark.range(3_000_000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("more"))
    may, cannot = apart_by_buckets(rows, rows.where("more < 2"), "key", "more")
    assert may.where("more < 2").count() == 2_000_000 and cannot.where("more < 2").count() == 0
    assert cannot.count() > 900_000 and may.columns == cannot.columns == rows.columns
    none = spark.createDataFrame([(None, 1), (1, None), (2, 2)], "key long, more long")
    for buckets in (1, 1 << 26):
        monkeypatch.setattr(jaccard_join, "ASKED_BUCKETS", buckets)
        may, cannot = apart_by_buckets(none, none.where("key = 1"), "key", "more")
        assert may.unionByName(cannot).count() == 3 and may.where("key = 1").count() == 1
        assert apart_by_buckets(none, none.limit(0), "key")[1].count() == 3
