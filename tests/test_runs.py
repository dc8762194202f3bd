"""Run-length bitmaps against Python sets and the plain bitmaps."""

from __future__ import annotations

import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.functions import bitmap, runs

SIZE = 3 * runs.SEGMENT + 77
spans = st.lists(st.tuples(st.integers(0, runs.SEGMENT_WORDS - 1), st.integers(1, 200), st.sampled_from([1, 2**64 - 1, 6])), max_size=6)


def words_of(parts):
    held = {}
    for at, n, word in parts:
        held |= {p: word for p in range(at, min(at + n, runs.SEGMENT_WORDS))}
    places = sorted(held)
    return runs.stretches(runs.np.array([held[p] for p in places], dtype="uint64"), runs.np.array(places, dtype="int64")), held


@settings(max_examples=60, deadline=None)
@given(spans, spans)
def test_words(one, two):
    (a, held_a), (b, held_b) = words_of(one), words_of(two)
    for value in (a, b):
        back = runs.from_bytes(runs.to_bytes(value))
        assert [x.tolist() for x in back] == [x.tolist() for x in value]
    for op, f in {"and": operator.and_, "or": operator.or_, "xor": operator.xor, "andnot": lambda x, y: x & ~y}.items():
        start, word = runs.from_bytes(runs.to_bytes(runs.combined(a, b, op)))
        dense = runs.np.repeat(word, runs.np.diff([*start, runs.SEGMENT_WORDS]))
        assert {p: int(w) for p, w in enumerate(dense) if w} == {p: w for p in held_a | held_b if (w := f(held_a.get(p, 0), held_b.get(p, 0)))}


@pytest.fixture(scope="module")
def bitmaps(spark):
    sets = {1: {*range(5_000), runs.SEGMENT - 1, runs.SEGMENT, 2 * runs.SEGMENT + 5}, 2: {3, *range(64, 640), SIZE - 1}, 3: set(range(0, 2 * runs.SEGMENT, 4_099))}
    other = {1: {*range(4_000, 9_000), 2 * runs.SEGMENT + 5}, 2: sets[2], 4: {9}}
    table = lambda s: bitmap.pack(spark.createDataFrame([(k, v) for k, vs in s.items() for v in vs], "k long, v long"), "k", "v")
    return sets, other, table(sets), table(other)


def as_sets(blocks):
    out = {}
    for r in bitmap.unpack(blocks).collect():
        out.setdefault(r["key"], set()).add(r["value"])
    return out


def test_rows(spark, bitmaps):
    sets, other, a, b = bitmaps
    x, y = runs.compress(a), runs.compress(b)
    assert as_sets(runs.expand(x)) == sets
    for op, f in {"and": set.__and__, "or": set.__or__, "xor": set.__xor__, "andnot": set.__sub__}.items():
        expected = {k: s for k in sets | other if (s := f(sets.get(k, set()), other.get(k, set())))}
        assert as_sets(runs.expand(runs.combine(x, y, op))) == expected
    assert dict(map(tuple, runs.cardinality(x).collect())) == {k: len(s) for k, s in sets.items()}
    assert dict(map(tuple, runs.equal(x, y).collect())) == {1: False, 2: True, 3: False, 4: False}
    left = {r["key"]: r["count"] for r in runs.cardinality(runs.complement(x, SIZE)).collect()}
    assert left == {k: SIZE - len(s) for k, s in sets.items()}
    assert as_sets(runs.expand(runs.union_all(x, fan_in=2).selectExpr("0L AS key", "segment", "runs"))) == {0: set.union(*sets.values())}
    words = {r["key"]: r["words"] for r in runs.sizes(x).collect()}
    assert words[1] < 10 and words[3] > 500  # 5,000 ones in a row take two words
    assert runs.compress(a.limit(0)).count() == 0
