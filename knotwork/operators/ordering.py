"""Permutations of vertices, and applying them.

Every ordering is a table ``perm(old_id, new_id)``, a bijection onto 0..n-1. Ranks come from a range-partitioned
sort and the sizes of its partitions, so no window spans the table. Orders that walk the whole graph vertex by vertex are not here; breadth-first,
hub-first and community orders are expressed level by level instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.components import connected_components
from knotwork.operators.graph import Graph, InvalidGraph
from knotwork.operators.kcore import coreness
from knotwork.operators.relational import bfs_levels
from knotwork.plans.materialize import dropped, written
from knotwork.plans.ranking import ranked


def _perm(rows: DataFrame, *order: Column | str) -> DataFrame:
    """By ``order``, ties by id."""
    return ranked(rows, *order, "id", into="new_id").select(F.col("id").alias("old_id"), "new_id")


def original_order(graph: Graph) -> DataFrame:
    return _perm(graph.vertices)


def degree_order(graph: Graph, descending: bool = True) -> DataFrame:
    """Ties by id."""
    return _perm(graph.degrees(), F.desc("deg") if descending else F.asc("deg"))


def core_order(graph: Graph, by_degree_product: bool = False) -> DataFrame:
    """Coreness descending, or coreness times (degree + 1) descending; ties by id."""
    rows = coreness(graph).join(graph.degrees(), "id")
    return _perm(rows, (F.col("core") * (F.col("deg") + 1)).desc() if by_degree_product else F.desc("core"))


def random_order(graph: Graph, seed: int = 0) -> DataFrame:
    return _perm(graph.vertices, F.md5(F.concat_ws(":", F.lit(seed), "id")))


def given_order(graph: Graph, perm: DataFrame) -> DataFrame:
    """A stored permutation, checked against the graph's vertices."""
    check_permutation(perm, graph.vertices)
    return perm


def bfs_order(graph: Graph, reverse: bool = False, peripheral: bool = False) -> DataFrame:
    """Components by smallest id, in each levels from that vertex, within a level degree ascending, ties by id.

    ``reverse`` numbers from the end, like reverse Cuthill-McKee does. ``peripheral`` starts each component from one end of a long
    path through it (:func:`peripheral_sources`).
    """
    edges = written(graph.edges, "edges")
    parts = written(connected_components(edges), "parts")
    sources = peripheral_sources(graph, parts).select("id") if peripheral else parts.select("component").distinct().withColumnRenamed("component", "id")
    levels = bfs_levels(edges, sources)
    rows = graph.vertices.join(parts, "id", "left").join(levels, "id", "left").join(graph.degrees(), "id")
    perm = _perm(rows, F.coalesce("component", "id"), F.coalesce("level", F.lit(0)), "deg")
    return reversed_order(perm) if reverse else perm


def cuthill_mckee_order(graph: Graph, reverse: bool = True, peripheral: bool = True) -> DataFrame:
    """Cuthill-McKee: components by smallest id; within each, levels from a source, and within a level by the place of the first parent, then degree, then id.

    Places are carried from level to level: a vertex that is reached takes the least place among its neighbours of the level before, and a range-partitioned sort
    numbers the level, of all components at once. ``reverse`` numbers from the end. ``peripheral`` starts from :func:`peripheral_sources`, otherwise from each component's smallest id.
    """
    edges, deg = written(graph.symmetric(), "edges"), written(graph.degrees(), "degrees")
    parts = written(graph.vertices.join(connected_components(graph.edges), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "parts")
    sources = parts.groupBy("component").agg(F.min("id").alias("id"))
    if peripheral:
        far = peripheral_sources(graph, parts).select("component", F.col("id").alias("far"))
        sources = sources.join(far, "component", "left").select("component", F.coalesce("far", "id").alias("id"))
    front = written(ranked(sources, "component", into="rank").withColumn("level", F.lit(0).cast("long")), "front")
    seen, level = front, 0
    while not front.isEmpty():
        level += 1
        reached = edges.join(front.select(F.col("id").alias("src"), "component", "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("rank").alias("parent"), F.first("component").alias("component"))
        fresh = reached.join(seen, "id", "left_anti").join(deg, "id")
        front = written(ranked(fresh, "parent", "deg", "id", into="rank").select("component", "id", "rank", F.lit(level).cast("long").alias("level")), "front")
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = written(seen, "seen")
    perm = _perm(seen, "component", "level", "rank")
    return reversed_order(perm) if reverse else perm


def reversed_order(perm: DataFrame) -> DataFrame:
    """The last first."""
    return perm.crossJoin(F.broadcast(perm.agg(F.max("new_id").alias("last")))).select("old_id", (F.col("last") - F.col("new_id")).alias("new_id"))


def farthest_of(graph: Graph, parts: DataFrame, sources: DataFrame) -> DataFrame:
    """``(component, depth, end)``: of each component that ``sources(id)`` start from, the farthest vertex (smallest degree, then id) and how far it is."""
    levels = bfs_levels(graph.edges, sources).join(parts, "id").join(graph.degrees(isolated=False), "id")
    return levels.groupBy("component").agg(F.max("level").alias("depth"), F.min_by("id", F.struct((-F.col("level")).alias("l"), "deg", "id")).alias("end"))


def peripheral_sources(graph: Graph, parts: DataFrame, sweeps: int = 2) -> DataFrame:
    """``(component, id, depth)``: of each component of ``parts(id, component)`` a vertex with far others, and how far the farthest is.

    Starts from the smallest id; a sweep moves to the farthest vertex (smallest degree, then id), if others are farther from there.
    """
    graph = Graph(written(graph.edges, "edges"), graph.vertices)

    def farthest(sources: DataFrame) -> DataFrame:
        return farthest_of(graph, parts, sources)

    start = parts.groupBy("component").agg(F.min("id").alias("id"))
    best = written(start.join(farthest(start.select("id")), "component"), "sources")
    for _ in range(sweeps):
        moved = best.select("component", F.col("end").alias("id"))
        tried = moved.join(farthest(moved.select("id")), "component").select("component", *(F.col(c).alias(f"new_{c}") for c in ("id", "depth", "end")))
        grown = F.col("new_depth") > F.col("depth")
        best = written(best.join(tried, "component").select("component", *(F.when(grown, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("id", "depth", "end"))), "sources")
    return best.select("component", "id", "depth")


def hybrid_order(graph: Graph) -> DataFrame:
    """Degree descending, ties by breadth-first place."""
    places = bfs_order(graph).select(F.col("old_id").alias("id"), F.col("new_id").alias("place"))
    return _perm(graph.degrees().join(places, "id"), F.desc("deg"), "place")


def slashburn_order(graph: Graph, hubs_per_round: int | None = None, share: float = 0.005) -> DataFrame:
    """Rounds that put the top-degree hubs in front and all but the giant component behind, until it is small.

    A round takes ``hubs_per_round``, or that ``share`` of all vertices, so that rounds end by themselves: after ``1 / share`` at the latest.
    """
    n = graph.vertices.count()
    k = max(1, int(n * share) if hubs_per_round is None else hubs_per_round)
    edges = written(graph.edges, "edges")
    left = written(graph.vertices, "left")
    placed: list[DataFrame] = []  # (id, side, round, size, group)
    parts_before = sizes_before = None
    round_no = -1
    while not left.isEmpty():
        round_no += 1
        here = Graph(edges, left)
        hubs = written(ranked(here.degrees(), F.desc("deg"), "id", into="rank").where(F.col("rank") < k), "hubs")
        placed.append(hubs.select("id", F.lit(0).alias("side"), F.lit(round_no).alias("round"), F.col("rank").cast("long").alias("size"), F.lit(0).cast("long").alias("group")))
        rest = left.join(hubs, "id", "left_anti")
        edges = written(edges.join(hubs.select(F.col("id").alias("src")), "src", "left_anti").join(hubs.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
        parts = written(rest.join(connected_components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("group")), "parts")
        sizes = written(parts.groupBy("group").agg(F.count("*").alias("size")), "sizes")
        giant = sizes.orderBy(F.desc("size"), "group").first()
        if giant is None:
            break
        keep = giant["group"] if giant["size"] > k else None
        out = parts.join(sizes, "group").where(F.lit(True) if keep is None else F.col("group") != keep)
        placed.append(written(out.select("id", F.lit(1).alias("side"), F.lit(-round_no).alias("round"), F.col("size"), "group"), "spokes"))
        if keep is None:
            break
        left = written(parts.where(F.col("group") == keep).select("id"), "left")
        inner, edges = edges, written(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi"), "edges")
        dropped(inner, parts_before, sizes_before)
        parts_before, sizes_before = parts, sizes
    if not placed:
        return original_order(graph)
    rows = placed[0]
    for more in placed[1:]:
        rows = rows.unionByName(more)
    return _perm(rows, "side", "round", F.when(F.col("side") == 1, -F.col("size")).otherwise(F.col("size")), "group")


def communities(graph: Graph, rounds: int = 5) -> DataFrame:
    """``(id, community)`` by label propagation: the commonest label among neighbours, the smallest on ties."""
    sym = written(graph.symmetric(), "sym")
    label = written(graph.vertices.select("id", F.col("id").alias("community")), "label")
    for number in range(rounds):
        votes = sym.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count("*").alias("k"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col("community"))).alias("b")).select("id", F.col("b.community").alias("new"))
        # Half of the vertices move in a round (by id hash), so that pairs do not swap labels forever.
        moves = F.md5(F.concat_ws(":", F.lit(number), "id")) < "8"
        before, label = label, written(label.join(best, "id", "left").select("id", F.when(F.col("new").isNotNull() & moves, F.col("new")).otherwise(F.col("community")).alias("community")), "label")
        dropped(before)
    return label


def community_order(graph: Graph, rounds: int = 5) -> DataFrame:
    return _perm(communities(graph, rounds), F.col("community"))


def check_permutation(perm: DataFrame, vertices: DataFrame) -> None:
    """Raise :class:`InvalidGraph` unless ``perm`` maps the vertices one to one onto 0..n-1."""
    n = vertices.count()
    found = perm.agg(F.count("*").alias("k"), F.count_distinct("old_id").alias("o"), F.count_distinct("new_id").alias("p"), F.min("new_id").alias("low"), F.max("new_id").alias("high")).first()
    if n and (found["k"], found["o"], found["p"], found["low"], found["high"]) != (n, n, n, 0, n - 1):
        raise InvalidGraph("not a permutation")
    if not vertices.join(perm.select(F.col("old_id").alias("id")), "id", "left_anti").isEmpty():
        raise InvalidGraph("a vertex without a new id")
