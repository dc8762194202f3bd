"""K-core decomposition by iterated h-indices.

A vertex's coreness is the fixed point of: the largest h such that h neighbours have value h or more, starting from
degrees. After the first, a round looks only at vertices of which a neighbour fell below their own value: one join and one aggregate over their
edges. A hub's neighbours are counted by
value before they meet, so a group holds at most as many rows as there are different values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.graph import Graph
from knotwork.plans.materialize import dropped, written


def coreness(graph: Graph) -> DataFrame:
    """``(id, core)`` of every vertex; isolated ones have 0."""
    sym = written(graph.symmetric(), "sym")
    value = written(graph.degrees(isolated=False).withColumnRenamed("deg", "core"), "core")
    falling = Window.partitionBy("src").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0)
    near: DataFrame | None = None
    before: DataFrame | None = None
    while True:
        own = sym if near is None else sym.join(near, "src", "left_semi")
        seen = own.join(value.withColumnRenamed("id", "dst"), "dst").groupBy("src", "core").agg(F.count("*").alias("k"))
        index = seen.withColumn("at_least", F.sum("k").over(falling)).groupBy(F.col("src").alias("id")).agg(F.max(F.least("core", "at_least")).alias("h"))
        fallen = written(value.join(index, "id").where("h < core").select("id", F.col("h").alias("core")), "fallen")
        if fallen.isEmpty():
            break
        new = written(value.join(fallen.withColumnRenamed("core", "h"), "id", "left").select("id", F.coalesce("h", "core").alias("core")), "core")
        # A vertex is looked at again if a neighbour fell below its own value.
        touched = sym.join(fallen.select(F.col("id").alias("dst"), F.col("core").alias("low")), "dst").groupBy("src").agg(F.min("low").alias("low"))
        near = touched.join(new.select(F.col("id").alias("src"), "core"), "src").where("low < core").select("src")
        dropped(value, before)
        value, before = new, fallen
    dropped(sym, before)
    return graph.vertices.join(value, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def k_core(graph: Graph, k: int) -> DataFrame:
    """Edges of the subgraph whose vertices all have coreness ``k`` or more.

    Vertices with fewer than ``k`` neighbours left go, round by round, until none does; a round looks at the edges of the vertices that went in the one before. There is no limit
    to the rounds, and they are no more than those of :func:`coreness`. Where no vertex goes, the edges are read once.
    """
    left = written(graph.degrees(isolated=False).select("id", "deg", F.lit(False).alias("gone")), "left")
    first = True
    while not left.where(~F.col("gone") & (F.col("deg") < k)).isEmpty():
        if first:
            sym, first = written(graph.symmetric(), "sym"), False
        weak = left.where(~F.col("gone") & (F.col("deg") < k)).select(F.col("id").alias("src"))
        lost = sym.join(weak, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("lost"))
        rest = left.join(lost, "id", "left").select("id", (F.col("deg") - F.coalesce("lost", F.lit(0))).alias("deg"), (F.col("gone") | (F.col("deg") < k)).alias("gone"))
        new = written(rest, "left")
        dropped(left)
        left = new
    edges = graph.edges.select("src", "dst")
    if first:
        dropped(left)
        return edges
    dropped(sym)
    gone = left.where("gone").select("id")
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
