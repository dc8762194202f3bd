"""Cuthill-McKee and merging by modularity against serial versions on small graphs."""

from __future__ import annotations

import math
import random

import pytest

from knotwork.operators import bisection, merging, ordering, stats, truss
from knotwork.operators.graph import Graph
from knotwork.operators.kcore import coreness
from knotwork.plans.materialize import written


def graph_of(spark, edges, vertices=()):
    g = Graph.from_pairs(spark.createDataFrame(edges, "src long, dst long"))
    return Graph(g.edges, g.vertices.union(spark.createDataFrame([(v,) for v in vertices], "id long")).distinct()) if vertices else g


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def serial_cuthill_mckee(near, vertices):
    """A queue: each vertex in turn appends its unseen neighbours by (degree, id)."""
    order, seen = [], set()
    for start in sorted(vertices):
        queue = [] if start in seen else [start]
        seen.update(queue)
        while queue:
            x = queue.pop(0)
            order.append(x)
            fresh = sorted(near.get(x, set()) - seen, key=lambda y: (len(near[y]), y))
            seen.update(fresh)
            queue += fresh
    return {x: i for i, x in enumerate(order)}


def test_cuthill_mckee(spark):
    rng = random.Random(4)
    grid = [(5 * i + j, 5 * i + j + d) for i in range(5) for j in range(5) for d in ([1] if j < 4 else []) + ([5] if i < 4 else [])]
    names = list(range(25))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in grid] + [(200, 201), (201, 202), (200, 203), (203, 202), (202, 204)]
    graph = graph_of(spark, edges, vertices=[300])
    near = neighbours(edges)
    expected = serial_cuthill_mckee(near, [*near, 300])
    assert dict(map(tuple, ordering.cuthill_mckee_order(graph, reverse=False, peripheral=False).collect())) == expected
    perm = ordering.cuthill_mckee_order(graph).cache()
    ordering.check_permutation(perm, graph.vertices)
    assert stats.bandwidth(graph.relabelled(perm)).first()["bandwidth"] <= 8 < stats.bandwidth(graph).first()["bandwidth"]


def gains_left(near, community):
    m2 = sum(map(len, near.values()))
    between, strength = {}, {}
    for x in near:
        strength[community[x]] = strength.get(community[x], 0) + len(near[x])
        for y in near[x]:
            if community[x] != community[y]:
                key = community[x], community[y]
                between[key] = between.get(key, 0) + 1
    return [k for k, w in between.items() if m2 * w > strength[k[0]] * strength[k[1]]]


def modularity(near, community):
    m2 = sum(map(len, near.values()))
    inner = sum(community[x] == community[y] for x in near for y in near[x])
    total = {}
    for x in near:
        total[community[x]] = total.get(community[x], 0) + len(near[x])
    return inner / m2 - sum((s / m2) ** 2 for s in total.values())


def test_merging(spark):
    rng = random.Random(9)
    blocks = [(20 * b + i, 20 * b + j) for b in range(3) for i in range(20) for j in range(i) if rng.random() < 0.4]
    edges = blocks + [(rng.randrange(60), rng.randrange(60)) for _ in range(12)] + [(500, 501 + i) for i in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    graph, near = graph_of(spark, edges), neighbours(edges)
    forest = merging.merge_by_modularity(graph)
    found = dict(map(tuple, forest.communities().select("id", "community").collect()))
    assert set(found) == set(near) and not gains_left(near, found)
    labels = dict(map(tuple, ordering.communities(graph).select("id", "community").collect()))
    assert modularity(near, found) > modularity(near, labels) and modularity(near, found) > 0.5
    assert len(forest.rounds) < 25  # a star's thirty leaves do not come one by one
    place = dict(map(tuple, forest.order().collect()))
    assert sorted(place.values()) == list(range(len(near)))
    for c in set(found.values()):  # a community is an interval, its own vertex first
        mine = sorted(place[x] for x in found if found[x] == c)
        assert mine == list(range(mine[0], mine[0] + len(mine))) and place[c] == mine[0]


@pytest.mark.parametrize("edges", [[], [(1, 2)]])
def test_merging_of_little(spark, edges):
    graph = graph_of(spark, edges, vertices=[7, 8])
    forest = merging.merge_by_modularity(graph, rounds=6)
    assert sorted(r["new_id"] for r in forest.order().collect()) == list(range(2 + 2 * len(edges)))
    ordering.check_permutation(ordering.cuthill_mckee_order(graph), graph.vertices)


def serial_truss(near):
    """Remove edges with fewer than k - 2 triangles, for k = 3, 4, ..."""
    left = {x: set(ys) for x, ys in near.items()}
    out, k = {}, 2
    while any(left.values()):
        weak = [(a, b) for a in left for b in left[a] if a < b and len(left[a] & left[b]) < k - 1]
        if not weak:
            k += 1
        for a, b in weak:
            out[a, b] = k
            left[a].discard(b)
            left[b].discard(a)
    return out


def test_truss(spark):
    rng = random.Random(6)
    clique = [(a, b) for b in range(7) for a in range(b)]
    edges = list({(min(p), max(p)) for p in clique + [(rng.randrange(24), rng.randrange(24)) for _ in range(90)] + [(40, 41)] if p[0] != p[1]})
    found = {(r["src"], r["dst"]): r["truss"] for r in truss.truss_numbers(graph_of(spark, edges)).collect()}
    assert found == serial_truss(neighbours(edges)) and found[0, 1] >= 7 and found[40, 41] == 2
    assert truss.truss_numbers(graph_of(spark, [(1, 2)]).relabelled(spark.createDataFrame([], "old_id long, new_id long"))).count() == 0


def log_gaps(near, place):
    total = 0.0
    for x in near:
        at = sorted(place[y] for y in near[x])
        total += sum(math.log2(b - a) for a, b in zip(at, at[1:], strict=False))
    return total


def test_bisections(spark):
    """Four blocks whose ids are mixed up come together, and every order is a permutation."""
    rng = random.Random(3)
    ids = rng.sample(range(1000), 160)
    edges = [(ids[40 * b + i], ids[40 * b + j]) for b in range(4) for i in range(40) for j in range(i) if rng.random() < 0.3]
    graph, near = graph_of(spark, edges, vertices=[2001, 2002]), neighbours(edges)
    given = {x: at for at, x in enumerate(sorted([*near, 2001, 2002]))}
    for perm in (bisection.gap_bisection_order(graph), bisection.walk_bisection_order(graph)):
        perm = written(perm, "perm")
        ordering.check_permutation(perm, graph.vertices)
        assert log_gaps(near, dict(map(tuple, perm.collect()))) < 0.8 * log_gaps(near, given)


@pytest.mark.parametrize("edges", [[], [(1, 2)]])
def test_bisections_of_little(spark, edges):
    graph = graph_of(spark, edges, vertices=[7, 8])
    for order in (bisection.gap_bisection_order, bisection.walk_bisection_order):
        for leaf in (2, 32):
            ordering.check_permutation(order(graph, leaf=leaf), graph.vertices)
    assert bisection.gap_bisection_order(graph_of(spark, [], vertices=[])).count() == 0


def test_no_limit_of_rounds(spark):
    """A path needs a round of coreness for every two vertices, and hubs one at a time still end."""
    path = graph_of(spark, [(i, i + 1) for i in range(24)])
    assert {r["core"] for r in coreness(path).collect()} == {1}
    ordering.check_permutation(ordering.slashburn_order(path, hubs_per_round=4), path.vertices)
