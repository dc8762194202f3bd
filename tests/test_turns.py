"""Plans that work in turns, against plain set computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.operators import counting, relational
from knotwork.plans import turns
from tests.test_graph import graph_of, neighbours, random_pairs, rows


def in_many_turns(monkeypatch):
    """Turns of a few rows; the labels of what is written."""
    labels: list[str] = []
    monkeypatch.setattr(counting, "TRAVEL", 0)
    monkeypatch.setattr(counting, "LEAST_TRAVEL", 600)
    plain = turns.written
    monkeypatch.setattr(turns, "written", lambda df, label="table": labels.append(label) or plain(df, label))
    return labels


def cn_of(pairs):
    nbrs = neighbours(pairs)
    return sorted((a, b, len(nbrs[a] & nbrs[b])) for a in nbrs for b in nbrs[a] if a < b)


def test_array_strategy_in_turns(spark, monkeypatch):
    labels = in_many_turns(monkeypatch)
    pairs = random_pairs(50, 260, 11)
    assert rows(counting.common_neighbors(graph_of(spark, pairs), "array")) == cn_of(pairs)
    assert labels.count("met") > 2


def test_wedge_strategy_in_turns_and_filtered(spark, monkeypatch):
    """A hub's far ends are told apart by 512 bits where 64 would all be set."""
    labels = in_many_turns(monkeypatch)
    pairs = random_pairs(50, 260, 12)
    assert rows(counting.common_neighbors(graph_of(spark, pairs), "wedge")) == cn_of(pairs)
    assert labels.count("apexes") > 2
    # 1 points to 2 and to 1000 odd ends; 2 points to 100 even ends of the same range: no wedge closes.
    out = spark.createDataFrame([(1, 2)] + [(1, 2 * i + 1) for i in range(10, 1010)] + [(2, 20 * i) for i in range(1, 101)], "src long, dst long")
    passed = counting.out_wedges(out, starts=out.where("src = 1 and dst = 2")).count()
    assert passed < 350


def test_block_strategy_in_segments_and_turns(spark, monkeypatch):
    """Ids over several segments of block numbers."""
    labels = in_many_turns(monkeypatch)
    pairs = [(a * 40_007, b * 40_007) for a, b in random_pairs(50, 260, 13)] + [(a, b) for a, b in random_pairs(200, 500, 14)]
    assert rows(counting.common_neighbors(graph_of(spark, pairs), "block")) == cn_of(pairs)
    assert labels.count("met") > 2


def test_hybrid_strategy_in_turns(spark, monkeypatch):
    labels = in_many_turns(monkeypatch)
    pairs = random_pairs(60, 260, 15) + [(100, i) for i in range(60)]
    assert rows(counting.common_neighbors(graph_of(spark, pairs), "hybrid", dense=12)) == cn_of(pairs)
    assert labels.count("met") > 3


def test_array_sets_in_turns(spark, monkeypatch):
    labels = in_many_turns(monkeypatch)
    pairs = random_pairs(50, 260, 16)
    graph, nbrs, ops = graph_of(spark, pairs), neighbours(pairs), relational.array_sets(F.col("a"), F.col("b"))
    met = counting.meeting_lists(graph.edges, graph.symmetric(), lambda met: met.select("src", "dst", ops["intersection_count"], F.size(ops["union"]), F.size(ops["difference"])))
    assert rows(met) == sorted((a, b, len(nbrs[a] & nbrs[b]), len(nbrs[a] | nbrs[b]), len(nbrs[a] - nbrs[b])) for a in nbrs for b in nbrs[a] if a < b)
    assert labels.count("met") > 2


def test_multiway_join_in_turns_and_marked(spark):
    """Triangles of text ids, with nulls; a row that no later relation closes is dropped before its next join is shuffled."""
    pairs = [(a, b) for a, b in random_pairs(40, 200, 17) if a < b]
    edges = spark.createDataFrame([*((f"n{a}", f"n{b}") for a, b in set(pairs)), (None, "n1"), ("n1", None)], "src string, dst string")
    relations = [edges.toDF("a", "b"), edges.toDF("b", "c"), edges.toDF("a", "c")]
    held = set(pairs)
    expected = sorted((f"n{a}", f"n{b}", f"n{c}") for a, b in held for x, c in held if x == b and (a, c) in held)
    for turn in (1, 3):
        assert rows(relational.multiway_join(relations, turns=turn).select("a", "b", "c")) == expected
    assert "shiftleft" in relational.multiway_join(relations)._jdf.queryExecution().optimizedPlan().toString()


def test_clique_counts_list_each_size_once(spark, monkeypatch):
    import itertools

    labels: list[str] = []
    plain = counting.written
    monkeypatch.setattr(counting, "written", lambda df, label="table": labels.append(label) or plain(df, label))
    pairs = random_pairs(25, 180, 18)
    nbrs = neighbours(pairs)
    found = {k: sum(all(b in nbrs[a] for a, b in itertools.combinations(c, 2)) for c in itertools.combinations(sorted(nbrs), k)) for k in (3, 4, 5)}
    assert rows(counting.clique_counts(graph_of(spark, pairs), 5)) == sorted(found.items())
    assert labels.count("out-lists") == 1 and labels.count("cliques") == 2
