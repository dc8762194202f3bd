"""Statistics of graphs, counts, and vertex orders: plain aggregates and windows within a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.graph import Graph
from knotwork.plans.materialize import written
from knotwork.plans.ranking import running_sums


def graph_summary(graph: Graph) -> DataFrame:
    """One row: n_vertices, n_edges, avg_degree, max_degree, max_out_degree (oriented)."""
    deg = graph.degrees().agg(F.count("*").alias("n_vertices"), F.avg("deg").alias("avg_degree"), F.max("deg").alias("max_degree"))
    edges = graph.edges.agg(F.count("*").alias("n_edges"))
    out = graph.oriented().groupBy("src").count().agg(F.max("count").alias("max_out_degree"))
    return deg.crossJoin(edges).crossJoin(out).select("n_vertices", "n_edges", "avg_degree", "max_degree", "max_out_degree")


def support_summary(counts: DataFrame) -> DataFrame:
    """One row over ``(src, dst, cn)``: max_cn, sum_cn, empty_edges, empty_share."""
    empty = F.count_if(F.col("cn") == 0)
    return counts.agg(F.max("cn").alias("max_cn"), F.sum("cn").alias("sum_cn"), empty.alias("empty_edges"), (empty / F.count("*")).alias("empty_share"))


def histogram(counts: DataFrame, col: str) -> DataFrame:
    """``(value, rows)``."""
    return counts.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("rows"))


def greedy_bins(hist: DataFrame, share: float = 0.1, descending: bool = False) -> DataFrame:
    """Consecutive values gathered until a bin holds more than ``share`` of all rows: (bin, low, high, rows).

    Works on a histogram (one row a value: degrees and counts of a graph of E edges have no more than about the square root of 2 E different
    values), folded in one row; each bin starts where the last one closed.
    """
    values = F.array_sort(F.collect_list(F.struct("value", "rows")))
    folded = hist.agg(values.alias("v"), F.sum("rows").alias("n"))
    ordered = F.reverse("v") if descending else F.col("v")
    kind = "array<struct<low:bigint,high:bigint,rows:bigint>>"
    start = F.struct(F.array().cast(kind).alias("bins"), F.lit(None).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("held"))

    def step(acc, x):
        first, held = F.coalesce(acc["first"], x["value"]), acc["held"] + x["rows"]
        closes = held > F.lit(share) * F.col("n")
        made = F.array(F.struct(F.least(first, x["value"]).alias("low"), F.greatest(first, x["value"]).alias("high"), held.alias("rows")))
        return F.struct(
            F.when(closes, F.concat(acc["bins"], made)).otherwise(acc["bins"]).alias("bins"),
            F.when(closes, F.lit(None).cast("bigint")).otherwise(first).alias("first"),
            F.when(closes, F.lit(0).cast("bigint")).otherwise(held).alias("held"),
        )

    last = F.element_at("v", 1 if descending else -1)["value"]
    end = lambda acc: F.when(acc["held"] > 0, F.concat(acc["bins"], F.array(F.struct(F.least(acc["first"], last).alias("low"), F.greatest(acc["first"], last).alias("high"), acc["held"].alias("rows"))))).otherwise(acc["bins"])
    bins = folded.where("n > 0").select(F.posexplode(F.aggregate(ordered, start, step, end)).alias("bin", "b"))
    return bins.select(F.col("bin").cast("long").alias("bin"), "b.low", "b.high", "b.rows")


def _with_degrees(graph: Graph) -> DataFrame:
    deg = graph.degrees(isolated=False)
    return graph.edges.join(deg.select(F.col("id").alias("src"), F.col("deg").alias("d_u")), "src").join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("d_v")), "dst")


def edge_skew(graph: Graph, ratio: int = 50) -> DataFrame:
    """One row: n_edges, and skewed_edges whose degrees (plus 1) differ by more than ``ratio`` times, in whole numbers."""
    rows = _with_degrees(graph).select((F.col("d_u") + 1).alias("a"), (F.col("d_v") + 1).alias("b"))
    skewed = (F.expr(f"a div {ratio}") > F.col("b")) | (F.expr(f"b div {ratio}") > F.col("a"))
    return rows.agg(F.count("*").alias("n_edges"), F.count_if(skewed).alias("skewed_edges"))


def oriented_skew(graph: Graph, ratio: int = 32) -> DataFrame:
    """The same on out-degrees (plus 1) of the oriented graph."""
    out = graph.oriented()
    deg = out.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    rows = out.join(deg.select(F.col("id").alias("src"), (F.col("deg") + 1).alias("a")), "src").join(deg.select(F.col("id").alias("dst"), (F.col("deg") + 1).alias("deg_b")), "dst", "left")
    rows = rows.withColumn("b", F.coalesce("deg_b", F.lit(1)))
    skewed = (F.expr(f"a div {ratio}") > F.col("b")) | (F.expr(f"b div {ratio}") > F.col("a"))
    return rows.agg(F.count("*").alias("n_edges"), F.count_if(skewed).alias("skewed_edges"))


def intersection_stats(graph: Graph, counts: DataFrame) -> DataFrame:
    """Per bin of floor(log10(d_u + d_v)): edges, and min, max and mean of selectivity cn / min(d) and of degree skew."""
    rows = _with_degrees(graph).join(counts, ["src", "dst"])
    small, large = F.least("d_u", "d_v"), F.greatest("d_u", "d_v")
    rows = rows.select(F.floor(F.log10(F.col("d_u") + F.col("d_v"))).cast("long").alias("bin"), (F.col("cn") / small).alias("sel"), F.floor(large / small).cast("long").alias("skew"))
    return rows.groupBy("bin").agg(
        F.count("*").alias("edges"), F.min("sel").alias("min_sel"), F.max("sel").alias("max_sel"), F.round(F.avg("sel"), 9).alias("avg_sel"),
        F.min("skew").alias("min_skew"), F.max("skew").alias("max_skew"), F.round(F.avg("skew"), 9).alias("avg_skew"),
    )


def dense_vertices(graph: Graph, least_degree: int = 16, per_block: int = 2, width: int = 64) -> DataFrame:
    """``(id, deg, blocks)`` of vertices of some degree whose neighbours share id blocks of ``width``."""
    rows = graph.symmetric().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"), F.count_distinct(F.expr(f"dst div {width}")).alias("blocks"))
    return rows.where((F.col("deg") >= least_degree) & (F.col("deg") > per_block * F.col("blocks")))


def balanced_ranges(graph: Graph, parts: int, filtered: bool = False) -> DataFrame:
    """``(part, first_id, last_id, weight)``: id ranges of about equal summed weight of their vertices.

    A vertex weighs its degree + 2; ``filtered``: the sum of that over its neighbours of larger id.
    """
    weights = graph.degrees().select("id", (F.col("deg") + 2).alias("w"))
    if filtered:
        ahead = graph.edges.join(weights.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("w"))
        weights = graph.vertices.join(ahead, "id", "left").select("id", F.coalesce("w", F.lit(0)).cast("long").alias("w"))
    weights = written(weights, "weights")
    total = weights.agg(F.sum("w")).first()[0] or 1
    placed = running_sums(weights, ["id"], {"w": "upto"}).withColumn("part", F.least(F.expr(f"(upto * {parts}) div {total}"), F.lit(parts - 1).cast("long")))
    return placed.groupBy("part").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("w").alias("weight"))


def order_compression(graph: Graph, width: int = 32) -> DataFrame:
    """One row: distinct id blocks per list (from larger to smaller ends, and back), and the ratio to the edges."""
    ahead = graph.edges.select("src", F.expr(f"dst div {width}").alias("b")).distinct().agg(F.count("*").alias("out_blocks"))
    back = graph.edges.select("dst", F.expr(f"src div {width}").alias("b")).distinct().agg(F.count("*").alias("in_blocks"))
    edges = graph.edges.agg(F.count("*").alias("n_edges"))
    return ahead.crossJoin(back).crossJoin(edges).select("n_edges", "out_blocks", "in_blocks", ((F.col("out_blocks") + F.col("in_blocks")) / F.col("n_edges")).alias("ratio"))


def big_nodes(graph: Graph, ratio: float) -> DataFrame:
    """One row: the fewest vertices, by degree downwards, that hold ``ratio`` of all degrees: n, avg and variance of degrees."""
    by_deg = graph.degrees(isolated=False).groupBy("deg").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("deg"))
    run = by_deg.select("deg", "k", F.sum(F.col("deg") * F.col("k")).over(w).alias("upto"), F.sum(F.col("deg") * F.col("k")).over(Window.partitionBy()).alias("total"))
    need = F.lit(ratio) * F.col("total")
    before = F.col("upto") - F.col("deg") * F.col("k")
    taken = F.when(F.col("upto") <= need, F.col("k")).when(before < need, F.least("k", F.ceil((need - before) / F.col("deg")))).otherwise(0)
    used = run.select("deg", taken.cast("long").alias("t")).where("t > 0")
    n, s, q = F.sum("t"), F.sum(F.col("t") * F.col("deg")), F.sum(F.col("t") * F.col("deg") * F.col("deg"))
    return used.agg(n.alias("n_vertices"), F.round(s / n, 9).alias("avg_degree"), F.round(q / n - (s / n) * (s / n), 6).alias("var_degree"))


def sqrt_degree_weights(graph: Graph) -> DataFrame:
    """``(id, weight)``: square roots of degrees, scaled to sum to 1."""
    deg = graph.degrees(isolated=False).select("id", F.sqrt(F.col("deg").cast("double")).alias("r"))
    return deg.crossJoin(deg.agg(F.sum("r").alias("total"))).select("id", (F.col("r") / F.col("total")).alias("weight"))


def degree_decades(graph: Graph) -> DataFrame:
    """``(decade, vertices)``: degrees in (0, 1], (1, 10], (10, 100], ... (decade 0, 1, 2, ...)."""
    deg = graph.degrees(isolated=False)
    decade = F.length(F.regexp_replace((F.col("deg") - 1).cast("string"), "^0$", "")).cast("long")
    return deg.groupBy(decade.alias("decade")).agg(F.count("*").alias("vertices"))


def _gaps(graph: Graph) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dst")
    return graph.symmetric().select("src", (F.col("dst") - F.lag("dst").over(w)).alias("gap")).where("gap is not null")


def gap_entropy(graph: Graph) -> DataFrame:
    """One row: entropy in bits of neighbour gaps, and the mean log2 gap, under the current ids."""
    gaps = _gaps(graph).groupBy("gap").agg(F.count("*").alias("k"))
    total = gaps.agg(F.sum("k").alias("n"))
    p = F.col("k") / F.col("n")
    return gaps.crossJoin(total).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), F.round(F.sum(F.col("k") * F.log2("gap")) / F.max("n"), 6).alias("avg_log_gap"))


def locality(graph: Graph, window: int = 5) -> DataFrame:
    """One row, ``score``: common and direct neighbours over pairs of ids at most ``window`` apart."""
    sym = graph.symmetric()
    near = sym.select("src", F.col("dst").alias("w"), F.explode(F.sequence(F.lit(1), F.lit(window))).alias("step"))
    shared = near.select((F.col("src") + F.col("step")).alias("src"), "w").join(sym.select("src", F.col("dst").alias("w")), ["src", "w"]).agg(F.count("*").alias("c"))
    direct = graph.edges.where(F.col("dst") - F.col("src") <= window).agg(F.count("*").alias("d"))
    return shared.crossJoin(direct).select((F.col("c") + F.col("d")).alias("score"))


def modularity(graph: Graph, groups: DataFrame) -> DataFrame:
    """One row, ``modularity`` of ``groups(id, community)``."""
    com = lambda c: groups.select(F.col("id").alias(c), F.col("community").alias(f"c_{c}"))
    both = written(graph.symmetric().join(com("src"), "src").join(com("dst"), "dst").select("c_src", "c_dst"), "communities")
    per = both.groupBy("c_src").agg(F.count_if(F.col("c_src") == F.col("c_dst")).alias("inner"), F.count("*").alias("every"))
    total = both.agg(F.count("*").alias("m2"))
    term = F.col("inner") / F.col("m2") - F.pow(F.col("every") / F.col("m2"), 2)
    return per.crossJoin(total).agg(F.round(F.sum(term), 9).alias("modularity"))


def bandwidth(graph: Graph) -> DataFrame:
    """One row: bandwidth (largest id distance of an edge), avg_width (mean spread of a row), max_degree."""
    rows = graph.symmetric().groupBy("src").agg(F.max(F.abs(F.col("src") - F.col("dst"))).alias("b"), (F.max("dst") - F.min("dst")).alias("w"), F.count("*").alias("d"))
    return rows.agg(F.max("b").alias("bandwidth"), F.round(F.avg("w"), 6).alias("avg_width"), F.max("d").alias("max_degree"))


def leaf_count(graph: Graph) -> DataFrame:
    """One row, ``leaves``: vertices with one edge to a larger id or one to a smaller."""
    ahead = graph.edges.groupBy(F.col("src").alias("id")).count().where("count = 1").select("id")
    back = graph.edges.groupBy(F.col("dst").alias("id")).count().where("count = 1").select("id")
    return ahead.union(back).distinct().agg(F.count("*").alias("leaves"))


def csr_offsets(graph: Graph) -> DataFrame:
    """``(id, offset, deg)``: where each vertex's neighbours begin in the concatenated adjacency."""
    return running_sums(graph.degrees(), ["id"], {"deg": "offset"}).select("id", F.col("offset").cast("long").alias("offset"), "deg")


def intersection_waste(graph: Graph) -> DataFrame:
    """One row over the oriented graph, where each edge's end lists are intersected: ``triangles``, ``empty_edges`` that close none, ``mismatch``
    (neighbours looked up without a hit) and its share ``ratio`` of 3 for each triangle and 1 for each mismatch."""
    out = written(graph.oriented(), "oriented")
    ends = out.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("k"))
    probed = out.join(ends, "dst").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("probed"))
    second, third = out.select(F.col("src").alias("dst"), F.col("dst").alias("w")), out.select("src", F.col("dst").alias("w"))
    hits = out.join(second, "dst").join(third, ["src", "w"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("k"))
    hits = hits.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("triangles"), F.count("*").alias("closing"))
    row = hits.crossJoin(probed).crossJoin(out.agg(F.count("*").alias("edges"))).withColumn("mismatch", F.col("probed") - F.col("triangles"))
    work = F.col("triangles") * 3 + F.col("mismatch")
    return row.select("triangles", (F.col("edges") - F.col("closing")).alias("empty_edges"), "mismatch", F.when(work > 0, F.col("mismatch") / work).alias("ratio"))
