"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.operators.graph import Graph, vertices_of
from knotwork.plans.materialize import written


def co_occurrence_pairs(rows: DataFrame, group: str, item: str) -> DataFrame:
    """``(src, dst)``: items that share a group, ``src < dst``, distinct."""
    own = rows.select(F.col(group).alias("g"), F.col(item).cast("long").alias("i")).where("g is not null and i is not null").distinct()
    return own.select("g", F.col("i").alias("src")).join(own.select("g", F.col("i").alias("dst")), "g").where("src < dst").select("src", "dst").distinct()


def _paired(pairs: DataFrame) -> Graph:
    """The graph of co-occurrence pairs, which are canonical and distinct already."""
    return Graph(pairs, vertices_of(pairs))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that share an order."""
    return _paired(co_occurrence_pairs(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_partkey"))


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line, doc_id)``, distinct: lines by digest that are not empty and that 2 documents or more hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and text is not null")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    keyed = written(lines.select("doc_id", F.md5("line").alias("line")).distinct(), "line-holders")
    some = keyed.groupBy("line").agg(F.count("*").alias("k")).where("k >= 2").select("line")
    return keyed.join(some, "line")


def line_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents that share a line: all pairs, so k(k - 1)/2 edges for a line of k documents. :func:`line_chains` for lines without a bound."""
    return _paired(co_occurrence_pairs(shared_lines(spark, sf_dir), "line", "doc_id"))


def line_chains(spark: SparkSession, sf_dir: str) -> Graph:
    """Documents linked to the next one by id that holds the same line: at most one edge for each line of a document, however many hold it.

    A line's documents are cut into ranges of ids, so that a hot line is no single window; a range's last document is linked to the next range's first.
    """
    held = written(shared_lines(spark, sf_dir).withColumn("part", F.col("doc_id").bitwiseAND(-4096)), "lines")
    within = held.select(F.col("doc_id").alias("src"), F.lead("doc_id").over(Window.partitionBy("line", "part").orderBy("doc_id")).alias("dst"))
    ends = held.groupBy("line", "part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.partitionBy("line").orderBy("part")).alias("dst"))
    return Graph.from_pairs(within.unionByName(across))


def line_classes(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The line graph by classes of documents with equal shared lines, and ``(id, members)`` of each class.

    A class is named by its smallest document. Documents of one class are all linked, and to the same others, so a
    line in thousands of like documents is one vertex here.
    """
    held = written(shared_lines(spark, sf_dir), "lines")
    sets = held.groupBy("doc_id").agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_list("line")))).alias("lines"))
    classes = written(sets.groupBy("lines").agg(F.min("doc_id").cast("long").alias("id"), F.count("*").alias("members")).select("id", "members"), "classes")
    pairs = co_occurrence_pairs(held.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), "line", "doc_id")
    return Graph(written(pairs, "class-edges"), classes.select("id")), classes


def rmat_graph(spark: SparkSession, scale: int, edges: int, seed: int = 0, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> Graph:
    """A random graph of 2**scale ids by recursive quadrant choice; loops and repeats go.

    The choices of an edge are the bytes of an MD5 of the seed and its number, 16 levels to a digest.
    """
    rows = spark.range(edges).withColumns({f"d{i}": F.md5(F.concat_ws(":", F.lit(seed), "id", F.lit(i))) for i in range(-(-scale // 16))})
    src = dst = F.lit(0).cast("long")
    for level in range(scale):
        u = F.conv(F.substring(f"d{level // 16}", 2 * (level % 16) + 1, 2), 16, 10).cast("int") / 256
        down, right = u >= a + b, ((u >= a) & (u < a + b)) | (u >= a + b + c)
        src = src * 2 + down.cast("long")
        dst = dst * 2 + right.cast("long")
    return Graph.from_pairs(rows.select(src.alias("src"), dst.alias("dst")))
