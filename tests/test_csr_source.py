"""The CSR data source, and counts that are kept up on a stream."""

from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from knotwork.operators.graph import Graph
from knotwork.sources import csr_source, formats
from knotwork.streaming import counts


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(3, 90), rng.randrange(3, 90)) for _ in range(400)] + [(120, 121)]
    g = Graph.from_pairs(spark.createDataFrame(edges, "src long, dst long"))
    return Graph(g.edges, g.vertices.union(spark.createDataFrame([(140,), (100,)], "id long")))


def pairs(df):
    return sorted(map(tuple, df.select("src", "dst").collect()))


@pytest.mark.parametrize("base", [0, 1])
def test_there_and_back(spark, graph, tmp_path, base):
    csr_source.register(spark)
    path = str(tmp_path / "g")
    rows = csr_source.csr_rows(graph, parts=1 + 4 * base)
    rows.write.format("csr").option("base", base).mode("append").save(path)
    read = spark.read.format("csr").option("base", base).load(path)
    assert pairs(read) == pairs(graph.symmetric())
    assert pairs(read.where("src between 30 and 60")) == pairs(graph.symmetric().where("src between 30 and 60"))
    assert pairs(read.where("src in (7, 120) and dst > 8")) == pairs(graph.symmetric().where("src in (7, 120) and dst > 8"))
    assert pairs(read.where("src > 1000")) == []
    assert not [f for f in os.listdir(path) if f.startswith(".drafts")]
    if not base:  # the older reader takes the same files; ids that no row names have degree 0
        whole = formats.read_csr_binary(spark, f"{path}/degree", f"{path}/adjacency")
        assert pairs(whole.edges) == pairs(graph.edges) and whole.vertices.count() == 141
    with pytest.raises(Exception, match="holds a graph already"):
        rows.write.format("csr").mode("append").save(path)
    few = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long").coalesce(1)
    few.write.format("csr").option("base", base).mode("overwrite").save(path)
    assert pairs(spark.read.format("csr").option("base", base).load(path)) == [(1, 2), (2, 1)]


def test_in_a_new_thread(spark, graph, tmp_path):
    """Spark looks sources up by the session that is active in the thread; a new thread has none."""

    def there_and_back():
        csr_source.register(spark)
        csr_source.csr_rows(graph).write.format("csr").mode("append").save(str(tmp_path / "g"))
        return pairs(spark.read.format("csr").load(str(tmp_path / "g")))

    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(there_and_back).result() == pairs(graph.symmetric())


def test_filters_leave_parts_out(spark, graph, tmp_path):
    csr_source.register(spark)
    csr_source.csr_rows(graph, parts=5).write.format("csr").mode("append").save(str(tmp_path / "g"))
    whole, some = (csr_source.CsrReader(str(tmp_path / "g"), 0) for _ in "ab")
    list(some.pushFilters([ds.EqualTo(("src",), 120), ds.EqualTo(("dst",), 1)]))
    assert len(some.partitions()) == 1 < len(whole.partitions())
    assert sum(b.num_rows for part in some.partitions() for b in some.read(part)) == 1


@pytest.mark.parametrize("rows", [[(1, 2), (0, 1)], [(1, 3), (1, 2)], [(1, 2), (1, 2)], [(None, 1)], [(-1, 2)]])
def test_failed_write_leaves_nothing(spark, tmp_path, rows):
    csr_source.register(spark)
    path = str(tmp_path / "g")
    with pytest.raises(Exception, match="out of order|repeats|null src|negative"):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.format("csr").mode("append").save(path)
    assert not any(files for _, _, files in os.walk(path))
    with pytest.raises(Exception, match="index.json"):
        spark.read.format("csr").load(path).count()


def test_partitions_that_share_a_vertex(spark, tmp_path):
    csr_source.register(spark)
    path = str(tmp_path / "g")
    rows = spark.range(2, numPartitions=2).select(F.lit(5).cast("long").alias("src"), "id").toDF("src", "dst")
    with pytest.raises(Exception, match="share vertices"):
        rows.write.format("csr").mode("append").save(path)
    assert not any(files for _, _, files in os.walk(path))


def test_empty_graph(spark, tmp_path):
    csr_source.register(spark)
    spark.createDataFrame([], "src long, dst long").write.format("csr").mode("append").save(str(tmp_path / "g"))
    assert spark.read.format("csr").load(str(tmp_path / "g")).count() == 0


def test_counts_after_each_batch(spark, tmp_path):
    """Equal to a recount; edges again, turned around, late, as loops and with nulls; a batch run again."""
    rng = random.Random(2)
    batches = [[(rng.randrange(14), rng.randrange(14)) for _ in range(n)] for n in (12, 25, 1, 30)] + [[], [(1, 1), (None, 2), (3, None)]]
    batches[3] += [(b, a) for a, b in batches[0]] + batches[1]
    folder, seen = str(tmp_path), set()
    for number, batch in enumerate(batches):
        table = spark.createDataFrame(batch, "src long, dst long")
        for _ in range(2 if number in (1, 3) else 1):
            counts.upkeep(table, number, folder)
        seen |= {(min(p), max(p)) for p in batch if None not in p and p[0] != p[1]}
        near = {x: {y for p in seen for y in p if x in p and y != x} for p in seen for x in p}
        triangles = sum(len(near[a] & near[b]) for a, b in seen) // 3
        got = {r["batch"]: (r["edges"], r["triangles"]) for r in counts.totals(spark, folder).collect()}
        assert got[number] == (len(seen), triangles)
        assert dict(map(tuple, counts.degrees(spark, folder).collect())) == {x: len(ys) for x, ys in near.items()}


def test_degrees_alone_look_for_no_triangles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "closed_triangles", None)
    for number, batch in enumerate(([(1, 2), (2, 3)], [(3, 1), (2, 1)], [(4, 1)])):
        counts.upkeep(spark.createDataFrame(batch, "src long, dst long"), number, str(tmp_path), triangles=False)
    assert dict(map(tuple, counts.degrees(spark, str(tmp_path)).collect())) == {1: 3, 2: 2, 3: 2, 4: 1}
