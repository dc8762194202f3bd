"""Common neighbours of every edge, and triangles.

``cn(u, v)`` is the number of common neighbours of the ends of an edge; edges without one stay, with 0. Five
physical strategies give the same rows:

- ``array``: adjacency arrays meet at each edge, ``size(array_intersect)``, a share of the edges at a time; simple, for moderate degrees;
- ``wedge``: out-wedges of the degree-oriented graph that pass a filter of their far end's range and hashes, closed by a semi join with the edges, in turns, then counted per edge;
- ``scatter``: triangles found once, by intersecting out-lists of the degree-oriented graph, and scattered to their three edges;
- ``block``: neighbours as 64-bit blocks, met by segments of block numbers in turns, the common bits counted; for dense ids;
- ``hybrid``: ``block`` for edges with a vertex of ``dense`` neighbours or more, ``array`` for the others, so that no array is longer than that.

The oriented strategies bound out-degrees by the square root of twice the number of edges, so hubs do not multiply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.graph import Graph
from knotwork.plans.materialize import dropped, kept, written
from knotwork.plans.turns import coded, in_turns, marks, may_hold, turns_for

#: Neighbour lists (or filters) that travel with edges go in turns, of at most so many times the lists themselves, or so many items where that is more.
TRAVEL, LEAST_TRAVEL = 8, 1 << 27
#: Block numbers in a row of the block strategy; a short holds a place in it.
SEGMENT = 1024
STRATEGIES = ("scatter", "array", "wedge", "block", "hybrid")


def closings(graph: Graph) -> DataFrame:
    """``(u, v, closing)`` of edges in the orientation: the vertices to which both ends point. Each triangle is there once, at its first two corners.

    Edges that close none are left out. An out-list travels with each of its edges; the orientation bounds it by the square root of twice the number of edges. The lists go in turns.
    """
    lists = written(graph.oriented().groupBy(F.col("src").alias("u")).agg(F.collect_list("dst").alias("own")), "out-lists")
    far = lists.select(F.col("u").alias("v"), F.col("own").alias("other"))
    items, moved = lists.agg(F.sum(F.size("own").cast("long")), F.sum(F.pow(F.size("own"), 2))).first()

    def closed(part: DataFrame) -> DataFrame:
        met = part.select("u", "own", F.explode("own").alias("v")).join(far, "v").select("u", "v", F.array_intersect("own", "other").alias("closing"))
        return met.where(F.size("closing") > 0)

    found = in_turns(lists, "u", turns_for(moved, max(LEAST_TRAVEL, TRAVEL * (items or 0))), closed, "closings")
    dropped(lists)
    return found


def triangles(graph: Graph) -> DataFrame:
    """Each triangle once, as ``(a, b, c)`` with a < b < c."""
    ends = F.sort_array(F.array("u", "v", "w"))
    return closings(graph).select("u", "v", F.explode("closing").alias("w")).select(ends.alias("e")).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"), F.col("e")[2].alias("c"))


def triangle_count(graph: Graph) -> DataFrame:
    """One row, ``triangles``."""
    return closings(graph).agg(F.coalesce(F.sum(F.size("closing")), F.lit(0)).cast("long").alias("triangles"))


def triangle_count_of_classes(graph: Graph, classes: DataFrame) -> DataFrame:
    """One row, ``triangles``, of the graph in which each vertex stands for ``members`` linked twins, by ``classes(id, members)``."""
    size = lambda c: classes.select(F.col("id").alias(c), F.col("members").alias(f"n_{c}"))
    within = classes.select(F.expr("members * (members - 1) div 2 * (members - 2) div 3").alias("k"))
    pairs = graph.edges.join(size("src"), "src").join(size("dst"), "dst").select(F.expr("n_src * n_dst * (n_src + n_dst - 2) div 2").alias("k"))
    across = triangles(graph).join(size("a"), "a").join(size("b"), "b").join(size("c"), "c").select(F.expr("n_a * n_b * n_c").alias("k"))
    return within.unionByName(pairs).unionByName(across).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("triangles"))


def _scatter(graph: Graph) -> DataFrame:
    """An edge's own closings are counted where they are found; each of them is also one for the two edges from it."""
    found = closings(graph)
    own = found.select("u", "v", F.size("closing").cast("long").alias("k"))
    pair = lambda x: F.struct(F.col(x).alias("u"), F.col("w").alias("v"), F.lit(1).cast("long").alias("k"))
    others = found.select("u", "v", F.explode("closing").alias("w")).select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.*")
    none = graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(0).cast("long").alias("k"))
    return own.unionByName(others).unionByName(none).groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.sum("k").alias("cn"))


def meeting_lists(edges: DataFrame, directed: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``meet`` over rows ``(src, dst, a, b)``: each edge with the neighbour lists of its ends in ``directed``.

    A list travels with each of its edges, which is many times the lists; so edges go in turns, by their first end.
    """
    edges = kept(edges.select("src", "dst") if edges.columns != ["src", "dst"] else edges, "edges")
    adj = written(directed.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("nbrs")), "lists")
    own, other = adj.select(F.col("id").alias("src"), F.col("nbrs").alias("a")), adj.select(F.col("id").alias("dst"), F.col("nbrs").alias("b"))
    items, moved = adj.agg(F.sum(F.size("nbrs").cast("long")), F.sum(F.pow(F.size("nbrs"), 2)) / 2).first()
    return in_turns(edges, "src", turns_for(moved, max(LEAST_TRAVEL, TRAVEL * (items or 0))), lambda part: meet(part.join(own, "src").join(other, "dst")), "met")


def _array(graph: Graph, edges: DataFrame | None = None, directed: DataFrame | None = None) -> DataFrame:
    """Over ``edges`` of the graph, with the neighbour lists of ``directed``."""
    edges, directed = graph.edges if edges is None else edges, graph.symmetric() if directed is None else directed
    return meeting_lists(edges, directed, lambda met: met.select("src", "dst", F.size(F.array_intersect("a", "b")).cast("long").alias("cn")))


def out_wedges(out: DataFrame, filtered: bool = True, starts: DataFrame | None = None) -> DataFrame:
    """``(u, v, x)``: edges u->v and u->x of the orientation ``out``, which an edge v->x would close; u->v of ``starts`` only, if given.

    ``filtered`` keeps of these only what ``v`` may point to: its least and greatest out-neighbour and 512 bits, one for each hash of an out-neighbour, travel with the edge
    and drop most wedges that do not close before they are shuffled. Some pass by chance; none that closes is lost.
    """
    far = out.select(F.col("src").alias("u"), F.col("dst").alias("x"))
    start = (out if starts is None else starts).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if not filtered:
        return start.join(far, "u").where("x <> v")
    own = out.select(F.col("src").alias("v"), F.col("dst").alias("x"))
    held = marks(own, "v", "x", F.min("x").alias("low"), F.max("x").alias("high"))
    allowed = F.col("x").between(F.col("low"), F.col("high")) & may_hold()
    return start.join(held, "v").join(coded(far, "x"), "u").where((F.col("x") != F.col("v")) & allowed).select("u", "v", "x")


def _wedge(graph: Graph) -> DataFrame:
    out = written(graph.oriented(), "oriented")
    degrees = out.groupBy("src").agg(F.count("*").alias("k"))
    n_edges, wedges = degrees.agg(F.sum("k"), F.sum(F.col("k") * F.col("k"))).first()
    closed = out.select(F.col("src").alias("v"), F.col("dst").alias("x"))
    apexes = in_turns(out, "src", turns_for(wedges, max(LEAST_TRAVEL, 2 * TRAVEL * (n_edges or 0))), lambda part: out_wedges(out, starts=part).join(closed, ["v", "x"], "left_semi").select("u", "v", "x"), "apexes")
    dropped(out)
    # (u, v, x): edges u->v, u->x, v->x; x counts for (u, v), v for (u, x), u for (v, x).
    side = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    hits = apexes.select(F.explode(F.array(side("u", "v"), side("u", "x"), side("v", "x"))).alias("e")).select("e.*", F.lit(1).cast("long").alias("k"))
    return hits.unionByName(graph.edges.select("src", "dst", F.lit(0).cast("long").alias("k"))).groupBy("src", "dst").agg(F.sum("k").alias("cn"))


def neighbour_blocks(directed: DataFrame) -> DataFrame:
    """``(id, block, mask)``: neighbours of each source as 64-bit masks."""
    bit = F.expr("shiftleft(1L, cast(dst % 64 as int))")
    return directed.groupBy(F.col("src").alias("id"), F.expr("dst div 64").alias("block")).agg(F.bit_or(bit).alias("mask"))


def _common_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The common bits of rows ``(src, dst, at_a, words_a, at_b, words_b)``; places within a segment ascend."""
    for batch in batches:
        column = lambda name: batch.column(name)  # noqa: B023, E731
        spots, words, rows = {}, {}, {}
        for side in "ab":
            at = column(f"at_{side}")
            rows[side] = np.repeat(np.arange(len(batch)), at.value_lengths().to_numpy(zero_copy_only=False))
            spots[side] = rows[side] * SEGMENT + at.flatten().to_numpy(zero_copy_only=False)
            words[side] = column(f"words_{side}").flatten().to_numpy(zero_copy_only=False)
        if not len(spots["b"]):
            continue
        place = np.minimum(np.searchsorted(spots["b"], spots["a"]), len(spots["b"]) - 1)
        both = spots["b"][place] == spots["a"]
        ones = np.bitwise_count(words["a"][both].view(np.uint64) & words["b"][place[both]].view(np.uint64))
        counts = np.bincount(rows["a"][both], weights=ones, minlength=len(batch)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([column("src"), column("dst"), pa.array(counts)], ["src", "dst", "k"])


def _block(graph: Graph, edges: DataFrame | None = None) -> DataFrame:
    """The blocks of SEGMENT block numbers are one row, so that an edge meets its ends' words by segments, and no row grows with a hub. Edges go in turns."""
    edges = kept(graph.edges if edges is None else edges, "edges")
    entry = F.struct((F.col("block") - F.col("seg") * SEGMENT).cast("short").alias("at"), F.col("mask").alias("word"))
    blocks = neighbour_blocks(graph.symmetric()).withColumn("seg", F.expr(f"block div {SEGMENT}"))
    held = blocks.groupBy("id", "seg").agg(F.sort_array(F.collect_list(entry)).alias("w"), F.sum(F.bit_count("mask")).alias("ones"))
    held = written(held.select("id", "seg", F.col("w.at").alias("at"), F.col("w.word").alias("words"), "ones"), "segments")
    sizes = held.groupBy("id").agg(F.sum(F.size("at").cast("long")).alias("w"), F.sum("ones").alias("d"))
    items, moved = sizes.agg(F.sum("w"), F.sum(F.col("w") * F.col("d")) / 2).first()
    own, other = (held.select(F.col("id").alias(end), "seg", F.col("at").alias(f"at_{side}"), F.col("words").alias(f"words_{side}")) for end, side in (("src", "a"), ("dst", "b")))

    def counted(part: DataFrame) -> DataFrame:
        met = part.join(own, "src").join(other, ["dst", "seg"]).select("src", "dst", "at_a", "words_a", "at_b", "words_b").mapInArrow(_common_bits, "src long, dst long, k long")
        return met.unionByName(part.select("src", "dst", F.lit(0).cast("long").alias("k"))).groupBy("src", "dst").agg(F.sum("k").alias("cn"))

    return in_turns(edges.select("src", "dst"), "src", turns_for(moved, max(LEAST_TRAVEL, TRAVEL * (items or 0))), counted, "met")


def _hybrid(graph: Graph, dense: int) -> DataFrame:
    hubs = graph.degrees(isolated=False).where(F.col("deg") >= dense).select("id", F.lit(True).alias("hub"))
    flag = lambda c: hubs.select(F.col("id").alias(c), F.col("hub").alias(f"hub_{c}"))
    split = written(graph.edges.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").select("src", "dst", F.coalesce("hub_src", "hub_dst", F.lit(False)).alias("hub")), "split")
    sparse = graph.symmetric().join(hubs.select(F.col("id").alias("src")), "src", "left_anti")
    return _array(graph, split.where("not hub").select("src", "dst"), sparse).unionByName(_block(graph, split.where("hub").select("src", "dst")))


def common_neighbors(graph: Graph, strategy: str = "scatter", dense: int = 1_000) -> DataFrame:
    """``(src, dst, cn)`` for every edge, ``src < dst``."""
    if strategy == "hybrid":
        return _hybrid(graph, dense)
    return {"scatter": _scatter, "array": _array, "wedge": _wedge, "block": _block}[strategy](graph)


def cliques4(graph: Graph) -> DataFrame:
    """Each 4-clique once, ``(a, b, c, d)`` ascending."""
    return _extended(triangles(graph), graph.edges, ["a", "b", "c"], "d")


def _extended(cliques: DataFrame, edges: DataFrame, names: list[str], new: str) -> DataFrame:
    """Cliques of one vertex more: two that differ in their last vertex only, and an edge between these two."""
    *shared, last = names
    other = cliques.select(*shared, F.col(last).alias(new))
    return cliques.join(other, shared).where(F.col(last) < F.col(new)).join(edges.select(F.col("src").alias(last), F.col("dst").alias(new)), [last, new], "left_semi").select(*names, new)


def cliques(graph: Graph, k: int) -> DataFrame:
    """Each k-clique once, as columns v1 < ... < vk."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    names = [f"v{i}" for i in range(1, k + 1)]
    if k == 2:
        return graph.edges.toDF(*names)
    out = triangles(graph).toDF(*names[:3])
    for n in range(3, k):
        out = _extended(out, graph.edges, names[:n], names[n])
    return out


def clique_counts(graph: Graph, most: int) -> DataFrame:
    """``(k, cliques)`` for k from 3 to ``most``; the cliques of a size are listed once, from those of one vertex less."""
    count = lambda found, k: found.agg(F.lit(k).cast("long").alias("k"), F.count("*").alias("cliques"))
    listed = triangles(graph).toDF("v1", "v2", "v3")
    out = None
    for k in range(3, most + 1):
        if k > 3:
            listed = _extended(listed, graph.edges, [f"v{i}" for i in range(1, k)], f"v{k}")
        if k < most:
            listed = written(listed, "cliques")
        counted = written(count(listed, k), "counts")
        out = counted if out is None else out.unionByName(counted)
    return out
