"""Readers and writers of graph files.

Text files go through Spark's readers line by line. Binary files hold fixed-size little-endian items; a file, or a folder of parts in the
order of their names, is read in ranges of items, each by whichever task gets it, so that files of any size split. Written binary
tables are such folders: one part for each partition of a sort, and a leading part with the counts. Paths are URIs that pyarrow's file systems
know (``file:``, ``hdfs:``, ``s3:`` and others; without a scheme, a folder that driver and executors share).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.graph import Graph, InvalidGraph, check_adjacency
from knotwork.operators.stats import csr_offsets
from knotwork.plans.materialize import written
from knotwork.plans.ranking import PART_BITS, ranked, running_sums

RANGE_ITEMS = 1 << 20
HEAD, PART = "part-0-head.bin", "part-1-{:05d}.bin"


def read_edge_text(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """``(src, dst)`` as written: two whole numbers a line, split by blanks; comment lines (``#``) and others go.

    ``base`` is the smallest id in the file's numbering (0 or 1).
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("src"), F.get(parts, F.lit(1)).try_cast("long").alias("dst"))
    return rows.where("src is not null and dst is not null").select((F.col("src") - base).alias("src"), (F.col("dst") - base).alias("dst"))


def read_edge_csv(spark: SparkSession, path: str, sep: str = "\t", weighted: bool = False, malformed: str = "FAILFAST") -> DataFrame:
    """``malformed``: lines that are no edge end the read (``FAILFAST``), or go (``DROPMALFORMED``), or give nulls (``PERMISSIVE``)."""
    schema = "src long, dst long" + (", weight double" if weighted else "")
    return spark.read.csv(path, sep=sep, schema=schema, mode=malformed)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of a folder's parts in order of their names."""
    system, root = pafs.FileSystem.from_uri(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(pafs.FileSelector(root)) if info.type == pafs.FileType.Directory else [info]
    scheme = path.split("://")[0] + "://" if "://" in path else "file://" if path.startswith("file:") else ""
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".bin") or f is info)


def read_records(spark: SparkSession, path: str, kind: str, columns: list[str]) -> DataFrame:
    """``(pos, *columns)`` of records of as many items of a numpy ``kind`` (such as ``<i4``) as there are columns."""
    item, width = np.dtype(kind), len(columns)
    size, first, ranges = item.itemsize * width, 0, []
    for name, length in _files(path):
        if length % size:
            raise InvalidGraph(f"{name} has no whole number of records")
        ranges.append((name, first, length // size))
        first += length // size
    files = spark.createDataFrame(ranges, "file string, first long, n long").where("n > 0")
    steps = files.select("file", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANGE_ITEMS).cast("long"))).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = pafs.FileSystem.from_uri(row["file"])
                n = min(RANGE_ITEMS, row["n"] - row["at"])
                with system.open_input_file(place) as f:
                    items = np.frombuffer(f.read_at(n * size, row["at"] * size), dtype=item).reshape(n, width).astype(np.int64)
                pos = np.arange(n) + row["first"] + row["at"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pos, *items.T)], names=["pos", *columns])

    tasks = max(1, min(first // RANGE_ITEMS + 1, 1 << 14))
    return steps.repartition(tasks, "file", "at").mapInArrow(read, ", ".join(f"{c} long" for c in ("pos", *columns)))


def write_records(rows: DataFrame, path: str, kind: str, columns: list[str], order: list[str], head: bytes = b"") -> None:
    """``columns`` of ``rows`` by ``order``, as items of ``kind``: a part with ``head``, and one for each partition of the sort.

    A part is written under a name of its own and moved to its place, so a repeated task leaves the same file.
    """
    placed = written(rows.select(*dict.fromkeys([*columns, *order])).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "records")
    numbered = placed.select(F.shiftright("__at", PART_BITS).cast("int").alias("part"), "__at", *columns)
    system, root = pafs.FileSystem.from_uri(path)
    system.create_dir(root, recursive=True)

    def put(name: str, data: bytes) -> None:
        system, root = pafs.FileSystem.from_uri(path)
        draft = f"{root}/.{name}.{np.random.default_rng().integers(1 << 62):x}"
        with system.open_output_stream(draft) as f:
            f.write(data)
        system.move(draft, f"{root}/{name}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            items = np.stack([batch.column(i + 2).to_numpy() for i in range(len(columns))], axis=1).astype(kind)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin < end:
                    if part is not None and numbers[begin] != part:
                        put(PART.format(part), b"".join(held))
                        held = []
                    part = int(numbers[begin])
                    held.append(items[begin:end].tobytes())
        if part is not None:
            put(PART.format(part), b"".join(held))
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], names=["part"])

    numbered.repartition("part").sortWithinPartitions("part", "__at").mapInArrow(write, "part int").write.format("noop").mode("overwrite").save()
    put(HEAD, head)


def write_edge_binary(edges: DataFrame, path: str) -> None:
    """A 64-bit count and then 32-bit pairs, by (src, dst)."""
    write_records(edges, path, "<i4", ["src", "dst"], ["src", "dst"], np.array([edges.count()], dtype="<i8").tobytes())


def read_edge_binary(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of a file with a 64-bit count and then 32-bit pairs."""
    rows = written(read_records(spark, path, "<i4", ["src", "dst"]), "records")
    head = rows.where("pos = 0").first()
    n = (head["src"] & 0xFFFFFFFF) | (head["dst"] << 32) if head else 0
    found = rows.where("pos > 0").select("src", "dst")
    if found.count() != n:
        raise InvalidGraph(f"the file says {n} edges")
    return found


def write_permutation_binary(perm: DataFrame, path: str) -> None:
    """A 64-bit count and then a 32-bit new id for each old id; old ids are 0..n-1."""
    write_records(perm, path, "<i4", ["new_id"], ["old_id"], np.array([perm.count()], dtype="<i8").tobytes())


def read_permutation_binary(spark: SparkSession, path: str) -> DataFrame:
    """``(old_id, new_id)`` of a file with a 64-bit count and then a 32-bit new id for each old id."""
    rows = read_records(spark, path, "<i4", ["value"])
    return rows.where("pos >= 2").select((F.col("pos") - 2).alias("old_id"), F.col("value").alias("new_id"))


def write_csr_binary(graph: Graph, degree_path: str, adjacency_path: str) -> None:
    """Degrees (after item size, n and m) and sorted neighbour lists, 32-bit each, for vertices 0..n-1."""
    deg = graph.degrees()
    n, m = graph.vertices.count(), 2 * graph.edges.count()
    write_records(deg, degree_path, "<i4", ["deg"], ["id"], np.array([4, n, m], dtype="<u4").tobytes())
    write_records(graph.symmetric(), adjacency_path, "<i4", ["dst"], ["src", "dst"])


def read_csr_binary(spark: SparkSession, degree_path: str, adjacency_path: str, check: bool = True) -> Graph:
    """A graph from its degree file (item size, n, m, degrees) and adjacency file, 32-bit each."""
    raw = written(read_records(spark, degree_path, "<i4", ["deg"]), "degrees")
    head = {r["pos"]: r["deg"] for r in raw.where("pos < 3").collect()}
    if head.get(0) != 4:
        raise InvalidGraph("items of 4 bytes expected")
    deg = raw.where("pos >= 3").select((F.col("pos") - 3).alias("id"), "deg")
    if deg.count() != head[1]:
        raise InvalidGraph(f"the file says {head[1]} vertices")
    # Each entry finds its vertex through pages: vertices whose lists touch the same 4096 entries.
    vertices = deg.select("id")
    offsets = written(running_sums(deg, ["id"], {"deg": "offset"}), "offsets")
    entries = written(read_records(spark, adjacency_path, "<i4", ["nbr"]), "entries")
    if entries.count() != (head[2] & 0xFFFFFFFF):
        raise InvalidGraph(f"the file says {head[2] & 0xFFFFFFFF} entries")
    spans = offsets.where("deg > 0").select("id", "offset", "deg", F.explode(F.sequence(F.expr("offset div 4096"), F.expr("(offset + deg - 1) div 4096"))).alias("page"))
    found = entries.withColumn("page", F.expr("pos div 4096")).join(spans, "page").where("pos >= offset and pos < offset + deg")
    directed = written(found.select(F.col("id").alias("src"), F.col("nbr").alias("dst"), (F.col("pos") - F.col("offset")).alias("at")), "directed")
    if check:
        lists = directed.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("at", "dst"))).alias("l"))
        check_adjacency(lists.select("id", F.col("l.dst").alias("nbrs")))
    return Graph(directed.where("src < dst").select("src", "dst"), vertices)


def write_graph(graph: Graph, path: str) -> None:
    """Parquet tables ``edges``, ``vertices``, and ``csr`` (id, offset, neighbours) below ``path``."""
    graph.edges.write.parquet(f"{path}/edges")
    graph.vertices.write.parquet(f"{path}/vertices")
    csr_offsets(graph).join(graph.adjacency(), "id", "left").write.parquet(f"{path}/csr")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices"))


def write_edge_text(edges: DataFrame, path: str, sep: str = " ", base: int = 0) -> None:
    edges.select(F.concat_ws(sep, F.col("src") + base, F.col("dst") + base).alias("value")).write.text(path)


def result_lines(rows: DataFrame) -> DataFrame:
    """The lines of a clustering result, in order: a heading, cores by id, members by cluster and id."""
    body = rows.select(
        F.when(F.col("kind") == "c", 1).otherwise(2).alias("part"), F.when(F.col("kind") == "n", F.col("cluster_id")).otherwise(F.lit(0)).alias("major"), "vertex_id",
        F.concat_ws(" ", "kind", "vertex_id", "cluster_id").alias("value"),
    ).distinct()
    head = rows.sparkSession.createDataFrame([(0, 0, 0, "c/n vertex_id cluster_id")], "part int, major long, vertex_id long, value string")
    return head.unionByName(body).orderBy("part", "major", "vertex_id").select("value")


def write_result_text(rows: DataFrame, path: str) -> None:
    """:func:`result_lines` as text parts whose names follow the order."""
    result_lines(rows).write.text(path)


def read_result_text(spark: SparkSession, path: str) -> DataFrame:
    """``(file, kind, vertex_id, cluster_id)`` of the lines but the heading; ``file`` is the part's name."""
    parts = F.split("value", " ")
    lines = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value").where(~F.col("value").startswith("c/n"))
    return lines.select("file", parts[0].alias("kind"), parts[1].cast("long").alias("vertex_id"), parts[2].cast("long").alias("cluster_id"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(kind, vertex_id, cluster_id, line)``: numbers from 1 in the order of the file, part by part, within a part as read."""
    placed = ranked(lines.withColumn("__row", F.monotonically_increasing_id()), "file", "__row", into="line")
    return placed.select("kind", "vertex_id", "cluster_id", (F.col("line") + 1).alias("line"))


def result_name(eps: float, mu: int) -> str:
    return f"result-{eps:f}".rstrip("0") + f"-{mu}.txt"
