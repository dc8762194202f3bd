"""Graphs as DataFrames: canonical edges, vertices, degrees, adjacency, orientation, checks.

An undirected simple graph is a table ``edges(src, dst)`` with ``src < dst`` and no repeats, and a table ``vertices(id)``
which may hold isolated ids. Everything else is derived by lazy plans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InvalidGraph(ValueError):
    """Input that breaks a graph invariant."""


def canonical_edges(pairs: DataFrame, src: str = "src", dst: str = "dst", strict_half: bool = False) -> DataFrame:
    """Edges ``src < dst``, distinct; loops and nulls go.

    By default a pair counts in either direction. ``strict_half`` keeps only pairs written with the smaller id first.
    """
    rows = pairs.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
    if strict_half:
        return rows.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return rows.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


@dataclass(frozen=True)
class Graph:
    """An undirected simple graph over DataFrames."""

    edges: DataFrame
    vertices: DataFrame

    @staticmethod
    def from_pairs(pairs: DataFrame, src: str = "src", dst: str = "dst", universe: str = "endpoints", strict_half: bool = False) -> Graph:
        """``universe``: ``endpoints`` (ids that have edges) or ``range`` (0 to the largest id)."""
        edges = canonical_edges(pairs, src, dst, strict_half)
        return Graph(edges, vertices_of(edges, universe))

    def symmetric(self) -> DataFrame:
        """Each edge in both directions."""
        return self.edges.select("src", "dst").unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def degrees(self, isolated: bool = True) -> DataFrame:
        """``(id, deg)``; isolated vertices have degree 0 unless left out."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
        if not isolated:
            return ends
        return self.vertices.join(ends, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))

    def adjacency(self) -> DataFrame:
        """``(id, nbrs)`` with sorted neighbour arrays."""
        return self.symmetric().groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))

    def oriented(self) -> DataFrame:
        """Each edge from the end of smaller (degree, id) to the larger: ``(src, dst)``; no vertex has many out-edges."""
        deg = self.degrees(isolated=False)
        both = self.edges.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("d_src")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("d_dst")), "dst")
        forward = (F.col("d_src") < F.col("d_dst")) | ((F.col("d_src") == F.col("d_dst")) & (F.col("src") < F.col("dst")))
        return both.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"))

    def relabelled(self, perm: DataFrame) -> Graph:
        """The graph under ``perm(old_id, new_id)``."""
        new = lambda c: perm.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}"))
        moved = self.edges.join(new("src"), "src").join(new("dst"), "dst")
        edges = moved.select(F.least("new_src", "new_dst").alias("src"), F.greatest("new_src", "new_dst").alias("dst"))
        return Graph(edges, self.vertices.join(perm.withColumnRenamed("old_id", "id"), "id").select(F.col("new_id").alias("id")))


def vertices_of(edges: DataFrame, universe: str = "endpoints") -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if universe == "endpoints":
        return ends.distinct()
    if universe == "range":
        most = ends.agg(F.max("id")).first()[0]
        return edges.sparkSession.range(0 if most is None else most + 1)
    raise ValueError(f"unknown universe {universe!r}")


def check_adjacency(adjacency: DataFrame) -> None:
    """Raise :class:`InvalidGraph` unless lists are strictly ascending, without loops, and symmetric."""
    rows = adjacency.select("id", F.posexplode("nbrs").alias("at", "nbr"))
    if not rows.where("id = nbr").isEmpty():
        raise InvalidGraph("self loop")
    descents = adjacency.where(F.exists(F.zip_with(F.slice("nbrs", F.lit(1), F.greatest(F.size("nbrs") - 1, F.lit(0))), F.slice("nbrs", F.lit(2), F.greatest(F.size("nbrs") - 1, F.lit(0))), lambda a, b: a >= b), lambda bad: bad))
    if not descents.isEmpty():
        raise InvalidGraph("neighbour list out of order, or with repeats")
    if not asymmetric_rows(rows.select(F.col("id").alias("src"), F.col("nbr").alias("dst"))).isEmpty():
        raise InvalidGraph("an edge without its reverse")


def asymmetric_rows(directed: DataFrame) -> DataFrame:
    """Rows ``(src, dst)`` whose reverse is missing."""
    back = directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return directed.join(back, ["src", "dst"], "left_anti")
