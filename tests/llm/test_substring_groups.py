"""Matching of anchor groups in large Arrow batches, and the factors themselves."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from knotwork.llm import substring_dedup


def packed(hashes):
    return b"".join(h.to_bytes(substring_dedup.HASH_BYTES, "little") for h in hashes)


def test_groups_on_a_cut_are_matched_whole():
    groups = 90_000
    n = 2 * groups
    anchor = np.repeat(np.arange(groups), 2)
    columns = {"anchor": pa.array(anchor), "salt": pa.array(np.zeros(n, np.int32)), "salted": pa.array(np.zeros(n, bool)), "doc_id": pa.array(np.arange(n) % 2), "text_key": pa.array(np.zeros(n, np.int64)), "start": pa.array(anchor.astype(np.int32)), "windows": pa.array([packed([7, 8, 9])] * n, pa.binary())}
    found = [r for batch in substring_dedup._match(50)(iter([pa.record_batch(columns)])) for r in batch.to_pylist()]
    assert sorted(r["start"] for r in found) == list(range(groups)) and {(r["doc_id"], r["ref_id"], r["ref_start"] - r["start"], r["end"] - r["start"]) for r in found} == {(1, 0, 0, 52)}


@pytest.mark.parametrize("seed", range(6))
def test_factors_cover_what_repeats_and_are_as_long_as_their_reference_allows(seed):
    """Rows of windows of one word each."""
    rng = random.Random(seed)
    rows = [[rng.randrange(4) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    n = len(rows)
    found = substring_dedup.Block(np.zeros(n, np.int64), np.arange(n), pa.array([packed(r) for r in rows], pa.binary()))
    covered = [[False] * len(r) for r in rows]
    for row, at, length, ref, ref_at in zip(*(x.tolist() for x in found.factors()), strict=True):
        assert ref < row and rows[row][at : at + length] == rows[ref][ref_at : ref_at + length]
        ends = at + length == len(rows[row]) or ref_at + length == len(rows[ref])
        assert ends or rows[row][at + length] != rows[ref][ref_at + length]
        assert not any(covered[row][at : at + length])
        covered[row][at : at + length] = [True] * length
    assert covered == [[any(x in rows[o] for o in range(i)) for x in r] for i, r in enumerate(rows)]


def test_nothing_is_removed_on_a_hash_alone(spark, monkeypatch):
    """Factors of other words are found out by the digests of theirs."""
    texts = [" ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60)), " ".join(f"a{i}" for i in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r["doc_id"]: r["k"] for r in docs.selectExpr("doc_id", "xxhash64(text) as k").collect()}
    false = spark.createDataFrame([(1, keys[1], 0, 60, 0, keys[0], 0), (2, keys[2], 0, 55, 0, keys[0], 0)], "doc_id long, text_key long, start int, end int, ref_id long, ref_key long, ref_start int")
    monkeypatch.setattr(substring_dedup, "find_factors", lambda *args, **options: false)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_duplicate_spans(docs).collect()) == [(0, 0), (1, 0), (2, 55)]
