"""Connected components by repeated contraction.

Each round hashes the remaining groups to random priorities, lets every group adopt its
smallest-priority neighbour (one step further along that neighbour's own choice), and rewrites
the edges between the merged groups. Inner edges vanish, so the edge table shrinks geometrically in
expectation whatever the ids look like; long paths need no more rounds than stars. Of every round the merges
are written to the shared folder, which keeps plans short and survives lost executors; the vertices' labels are composed once, from the
last merges back, so a round costs what is left of the graph. A hub's
neighbours are pre-aggregated by a plain ``min`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.plans.materialize import dropped, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges``; a component is named by its smallest id.

    Null endpoints and self loops link nothing (a loop's vertex still gets its row).
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    pairs = ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = left = written(pairs, "cc-edges")
    left = left.where("u <> v")
    table, merges = None, []
    for round_no in range(max_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_no)).alias("p"), F.col(c).alias("x"))
        choice = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        parent = written(choice.select("u", F.least(F.col("best"), rank("u"))["x"].alias("to")), "cc-parent")
        onward = parent.select(F.col("u").alias("to"), F.col("to").alias("further"))
        merge = written(parent.join(onward, "to").select("u", F.col("further").alias("to")), "cc-merge")
        merges.append(merge)
        left = written(
            left.join(merge.withColumnRenamed("to", "a"), "u")
            .join(merge.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
            .where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
            .distinct(),
            "cc-edges",
        )
        dropped(parent, table)
        table = left
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = first.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    if not merges:
        return label.select("id", F.col("id").alias("component"))
    whole = merges[-1]
    for merge in reversed(merges[:-1]):
        whole = merge.join(whole.select(F.col("u").alias("to"), F.col("to").alias("end")), "to", "left").select("u", F.coalesce("end", "to").alias("to"))
    label = written(label.join(whole.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("to", "id").alias("label")), "cc-label")
    dropped(table, *merges)
    least = label.groupBy("label").agg(F.min("id").alias("component"))
    return label.join(least, "label").select("id", "component")
