"""Queries over every line, on small tables of lines of few pieces and of hot ones, against plain computations."""

from __future__ import annotations

import itertools
import random

import pytest

from knotwork.queries import QUERIES
from knotwork.sources.derive import line_chains
from tests.test_graph import neighbours, rows


LINES = "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_suppkey long"


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(6)
    return [(order, rng.randrange(30) + 100 * (order % 2), float(rng.randrange(1, 51)), rng.choice("RAN"), order % 5) for order in range(60) for _ in range(rng.randrange(1, 5))]


@pytest.fixture(scope="module")
def folder(spark, lines, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.fixture(scope="module")
def nbrs(lines):
    return neighbours([(a[1], b[1]) for a, b in itertools.combinations(lines, 2) if a[0] == b[0]])


def test_edges_and_triangles(spark, folder, nbrs):
    edges = sorted((a, b) for a in nbrs for b in nbrs[a] if a < b)
    assert rows(QUERIES["edges"](spark, folder)) == edges
    cn = [(a, b, len(nbrs[a] & nbrs[b])) for a, b in edges]
    for name in ("", "_array", "_wedge", "_block", "_hybrid"):
        assert rows(QUERIES[f"common_neighbors{name}"](spark, folder)) == cn
    assert QUERIES["triangle_count"](spark, folder).first()[0] * 3 == sum(c for _, _, c in cn)


def test_components(spark, folder, nbrs):
    expected = {}
    for start in sorted(nbrs):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = expected.get(start, start)
                todo += nbrs[x]
    assert dict(rows(QUERIES["components"](spark, folder))) == expected


def test_sets(spark, folder, lines):
    returned, accepted = ({(p, s) for _, p, _, f, s in lines if f == flag} for flag in "RA")
    for name, expected in (("intersect", returned & accepted), ("union", returned | accepted), ("difference", returned - accepted)):
        assert rows(QUERIES[f"set_{name}"](spark, folder)) == sorted(expected)


def test_bfs_levels_to_the_fixed_point(spark, tmp_path):
    path = [(i, part, 1.0, "N", 1) for i in range(12) for part in (i, i + 1)]
    spark.createDataFrame(path, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(QUERIES["bfs_levels"](spark, str(tmp_path))) == [(i, i) for i in range(13)]


def test_bitmap_complement_of_all_parts(spark, tmp_path):
    lines = [(1, 3, 1.0, "R", 7), (1, 190, 1.0, "R", 7), (2, 64, 1.0, "R", 8), (3, 321, 1.0, "A", 9)]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = set(map(tuple, QUERIES["bitmap_complement"](spark, str(tmp_path)).collect()))
    assert found == {(7, v) for v in range(322) if v not in (3, 190)} | {(8, v) for v in range(322) if v != 64}


def test_lines_of_many_documents_and_short_lines(spark, tmp_path):
    """A line of 250 documents, a short one of two, and groups of copies."""
    texts = [f"the line that all of them hold\nonly here {i}" for i in range(240)] + ["the line that all of them hold\nand another that ten hold"] * 10
    texts += ["and another that ten hold", "short", "short\nelse", "alone", "", "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [set(t.split("\n")) - {""} for t in texts]
    nbrs = neighbours([(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if lines[a] & lines[b]])
    edges = [(a, b, len(nbrs[a] & nbrs[b])) for a in sorted(nbrs) for b in sorted(nbrs[a]) if a < b]
    assert len(edges) == 250 * 249 // 2 + 10 + 1
    assert rows(QUERIES["common_neighbors_docs_all"](spark, str(tmp_path))) == edges
    assert QUERIES["triangle_count_docs_all"](spark, str(tmp_path)).first()[0] * 3 == sum(cn for _, _, cn in edges)
    assert rows(QUERIES["degree_decades_all"](spark, str(tmp_path))) == [(0, 2), (1, 1), (3, 250)]
    assert QUERIES["dense_vertices_all"](spark, str(tmp_path)).count() == 250
    chains = sorted({pair for line in set().union(*lines) for holders in [[i for i, own in enumerate(lines) if line in own]] for pair in zip(holders, holders[1:], strict=False)})
    near = neighbours(chains)
    assert rows(QUERIES["common_neighbors_docs"](spark, str(tmp_path))) == [(a, b, len(near[a] & near[b])) for a, b in chains]


def test_chains_across_ranges_of_ids(spark, tmp_path):
    ids = [3, 4095, 4096, 9000, 9001, 50_000]
    spark.createDataFrame([(i, "one line") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(line_chains(spark, str(tmp_path)).edges) == list(zip(ids, ids[1:], strict=False))
