"""Graph operators on hand-made graphs, and properties against plain set computations."""

from __future__ import annotations

import itertools
import random
import struct

import pytest

from knotwork.functions import bitmap
from knotwork.operators import counting, ordering, relational, scan, stats
from knotwork.operators.components import connected_components
from knotwork.operators.graph import Graph, InvalidGraph, check_adjacency
from knotwork.operators.kcore import coreness
from knotwork.plans import materialize, ranking
from knotwork.sources import formats
from knotwork.sources.derive import rmat_graph

BOWTIE = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (6, 0), (6, 3)]


def graph_of(spark, pairs, n=None):
    g = Graph.from_pairs(spark.createDataFrame(pairs, "src long, dst long"))
    return Graph(g.edges, spark.range(n)) if n is not None else g


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def neighbours(pairs):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def test_canonical_edges(spark):
    pairs = [(1, 2), (2, 1), (2, 2), (1, 2), (3, 1), (None, 4)]
    assert rows(graph_of(spark, pairs).edges) == [(1, 2), (1, 3)]
    strict = Graph.from_pairs(spark.createDataFrame(pairs, "src long, dst long"), strict_half=True)
    assert rows(strict.edges) == [(1, 2)]
    whole = Graph.from_pairs(spark.createDataFrame([(1, 3)], "src long, dst long"), universe="range")
    assert rows(whole.vertices) == [(0,), (1,), (2,), (3,)]


@pytest.mark.parametrize("strategy", counting.STRATEGIES)
def test_common_neighbors(spark, strategy):
    pairs = random_pairs(40, 200, 1)
    nbrs = neighbours(pairs)
    expected = sorted((a, b, len(nbrs[a] & nbrs[b])) for a in nbrs for b in nbrs[a] if a < b)
    assert rows(counting.common_neighbors(graph_of(spark, pairs), strategy)) == expected


def test_triangles_and_cliques(spark):
    pairs = random_pairs(25, 140, 2)
    nbrs = neighbours(pairs)
    g = graph_of(spark, pairs)
    expected = [c for c in itertools.combinations(sorted(nbrs), 3) if all(b in nbrs[a] for a, b in itertools.combinations(c, 2))]
    assert rows(counting.triangles(g)) == expected
    four = [c for c in itertools.combinations(sorted(nbrs), 4) if all(b in nbrs[a] for a, b in itertools.combinations(c, 2))]
    assert rows(counting.cliques4(g)) == four == rows(counting.cliques(g, 4))
    total = counting.common_neighbors(g).groupBy().sum("cn").first()[0]
    assert total == 3 * len(expected)


def test_empty_graph(spark):
    g = graph_of(spark, [])
    assert rows(counting.common_neighbors(g)) == [] and counting.triangle_count(g).first()[0] == 0
    assert rows(connected_components(g.edges)) == [] and rows(coreness(g)) == []
    assert scan.cluster(g, 0.5, 2).result_rows().count() == 0


def test_bowtie_clustering(spark):
    found = scan.cluster(graph_of(spark, BOWTIE), 0.8, 2)
    assert rows(found.clusters) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]
    assert {r["id"]: r["role"] for r in found.roles.collect()}[6] == "HUB"
    assert rows(found.members) == []
    lines = [r[0] for r in formats.result_lines(found.result_rows()).collect()]
    assert lines[0] == "c/n vertex_id cluster_id" and lines[1:] == [f"c {i} {i // 3 * 3}" for i in range(6)]


def test_single_edge_and_isolated(spark):
    found = scan.cluster(graph_of(spark, [(0, 1)]), 1.0, 1)
    assert rows(found.clusters) == [(0, 0), (1, 0)]
    wide = graph_of(spark, [(0, 1), (0, 2), (1, 2)], n=5)
    assert rows(scan.cluster(wide, 0.5, 2).roles)[3:] == [(3, 0, "UNCLASSIFIED"), (4, 0, "UNCLASSIFIED")]
    assert {r["role"] for r in scan.cluster(wide, 0.5, 0).roles.collect()} == {"CORE"}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 400)
    pairs = list(zip(ids[:199], ids[1:200], strict=True)) + [(ids[200], x) for x in ids[201:]] + [(7_000_000, 7_000_000)]
    expected = {i: min(ids[:200]) for i in ids[:200]} | {i: min(ids[200:]) for i in ids[200:]} | {7_000_000: 7_000_000}
    assert dict(rows(connected_components(spark.createDataFrame(pairs, "src long, dst long")))) == expected


def test_coreness(spark):
    pairs = random_pairs(60, 260, 4)
    nbrs = {k: set(v) for k, v in neighbours(pairs).items()}
    expected, k = {}, 0
    while nbrs:
        k += 1
        while low := [v for v in nbrs if len(nbrs[v]) < k]:
            for v in low:
                expected[v] = k - 1
                for w in nbrs.pop(v):
                    if w in nbrs:
                        nbrs[w].discard(v)
    assert dict(rows(coreness(graph_of(spark, pairs)))) == expected


def test_orders_are_permutations(spark):
    g = graph_of(spark, random_pairs(50, 90, 5), n=50)
    orders = [ordering.degree_order(g), ordering.core_order(g), ordering.random_order(g, 1), ordering.bfs_order(g), ordering.bfs_order(g, reverse=True), ordering.slashburn_order(g), ordering.community_order(g)]
    cn = sorted(r["cn"] for r in counting.common_neighbors(g).collect())
    for perm in orders:
        ordering.check_permutation(perm, g.vertices)
    moved = g.relabelled(orders[0])
    assert sorted(r["cn"] for r in counting.common_neighbors(moved).collect()) == cn
    with pytest.raises(InvalidGraph):
        ordering.given_order(g, spark.range(50).selectExpr("id old_id", "id div 2 new_id"))


def test_invalid_adjacency(spark):
    make = lambda lists: spark.createDataFrame(lists, "id long, nbrs array<long>")
    check_adjacency(make([(0, [1]), (1, [0])]))
    for bad in ([(0, [0])], [(0, [2, 1]), (1, [0]), (2, [0])], [(0, [1, 1]), (1, [0])], [(0, [1])]):
        with pytest.raises(InvalidGraph):
            check_adjacency(make(bad))


def test_text_and_binary_files(spark, tmp_path):
    text = tmp_path / "e.txt"
    text.write_text("# c\n1 2\n2\t1\n2 2\n1 2\nx y\n3 1")
    assert rows(Graph.from_pairs(formats.read_edge_text(spark, str(text))).edges) == [(1, 2), (1, 3)]
    edges = tmp_path / "e.bin"
    edges.write_bytes(struct.pack("<qiiii", 2, 0, 1, 1, 2))
    assert rows(formats.read_edge_binary(spark, str(edges))) == [(0, 1), (1, 2)]
    (tmp_path / "p.dict").write_bytes(struct.pack("<qiii", 3, 2, 0, 1))
    assert rows(formats.read_permutation_binary(spark, str(tmp_path / "p.dict"))) == [(0, 2), (1, 0), (2, 1)]
    deg, adj = tmp_path / "d.bin", tmp_path / "a.bin"
    deg.write_bytes(struct.pack("<iiiiiii", 4, 4, 4, 1, 2, 1, 0))
    adj.write_bytes(struct.pack("<iiii", 1, 0, 2, 1))
    g = formats.read_csr_binary(spark, str(deg), str(adj))
    assert rows(g.edges) == [(0, 1), (1, 2)] and g.vertices.count() == 4
    adj.write_bytes(struct.pack("<iiii", 1, 2, 0, 1))
    with pytest.raises(InvalidGraph):
        formats.read_csr_binary(spark, str(deg), str(adj))
    formats.write_graph(g, str(tmp_path / "g"))
    assert rows(formats.read_graph(spark, str(tmp_path / "g")).edges) == rows(g.edges)
    with pytest.raises(FileNotFoundError):
        formats.read_edge_binary(spark, str(tmp_path / "nothing.bin"))
    assert formats.result_name(0.2, 5) == "result-0.2-5.txt"


def test_rmat_is_simple_and_repeatable(spark):
    a, b = (rows(rmat_graph(spark, 6, 300, seed=9).edges) for _ in range(2))
    assert a == b and all(0 <= x < y < 64 for x, y in a) and len(set(a)) == len(a)


def test_bitmaps(spark):
    make = lambda values: bitmap.pack(spark.createDataFrame([(1, v) for v in values], "k long, v long"), "k", "v")
    x, y = {0, 63, 64, 200}, {63, 65, 200}
    for op, expected in (("and", x & y), ("or", x | y), ("xor", x ^ y), ("andnot", x - y)):
        assert {r["value"] for r in bitmap.unpack(bitmap.combine(make(x), make(y), op)).collect()} == expected
    assert {r["value"] for r in bitmap.unpack(bitmap.complement(make(x), 130)).collect()} == set(range(130)) - x


def test_greedy_bins(spark):
    hist = spark.createDataFrame([(1, 3), (2, 1), (3, 1), (4, 5)], "value long, rows long")
    assert rows(stats.greedy_bins(hist, 0.35)) == [(0, 1, 2, 4), (1, 3, 4, 6)]
    assert rows(stats.greedy_bins(hist, 0.35, descending=True)) == [(0, 4, 4, 5), (1, 1, 3, 5)]


def test_relational(spark):
    values = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    codes = relational.dictionary(values, "v")
    assert rows(codes) == [("a", 0), ("b", 1)]
    back = relational.decode(relational.encode(values, "v", codes), "v", codes)
    assert sorted(str(r[0]) for r in back.collect()) == ["None", "a", "b", "b"]
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    one = spark.createDataFrame([(1,)], "id long")
    assert rows(relational.bfs_levels(edges, one)) == [(0, 1), (1, 0), (2, 1), (3, 2)]
    assert rows(relational.bfs_levels(edges, one, directed=True)) == [(1, 0), (2, 1), (3, 2)]


def test_streamed_edges(spark, tmp_path):
    from knotwork.streaming.edges import stream_edges, windowed_degrees

    data = [(1, 2, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:10:00"), (2, 3, "2024-01-01 00:20:00"), (3, 3, "2024-01-01 00:30:00")]
    spark.createDataFrame(data, "src long, dst long, t string").selectExpr("src", "dst", "cast(t as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long, ts timestamp").parquet(str(tmp_path / "in"))
    query = windowed_degrees(stream_edges(stream)).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["id"], r["deg"]) for r in spark.table("deg").collect()) == [(1, 1), (2, 2), (3, 1)]


def test_written_binary_tables_are_read_back(spark, tmp_path, monkeypatch):
    """Parts, their counts, and ranges within a part."""
    monkeypatch.setattr(formats, "RANGE_ITEMS", 7)
    g = Graph.from_pairs(spark.createDataFrame(random_pairs(30, 90, 11), "src long, dst long").repartition(3), universe="range")
    formats.write_edge_binary(g.edges, str(tmp_path / "edges"))
    assert rows(formats.read_edge_binary(spark, str(tmp_path / "edges"))) == rows(g.edges)
    formats.write_csr_binary(g, str(tmp_path / "deg"), str(tmp_path / "adj"))
    back = formats.read_csr_binary(spark, str(tmp_path / "deg"), str(tmp_path / "adj"))
    assert rows(back.edges) == rows(g.edges) and rows(back.vertices) == rows(g.vertices)
    perm = ordering.random_order(g, seed=1)
    formats.write_permutation_binary(perm, str(tmp_path / "perm"))
    assert rows(formats.read_permutation_binary(spark, str(tmp_path / "perm"))) == rows(perm)


def test_binary_layout_is_the_plain_one(spark, tmp_path):
    formats.write_edge_binary(spark.createDataFrame([(1, 2), (0, 1)], "src long, dst long"), f"file://{tmp_path}/e")
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "e").iterdir())) == struct.pack("<qiiii", 2, 0, 1, 1, 2)


def test_more_of_bitmaps(spark):
    make = lambda values: bitmap.pack(spark.createDataFrame([(1, v) for v in values], "k long, v long"), "k", "v")
    full = set(range(128)) | {200, 300}
    assert rows(bitmap.equal(make(full), make(full))) == [(1, True)] and rows(bitmap.equal(make(full), make(full - {5}))) == [(1, False)]
    for size in (301, 320):
        assert {r["value"] for r in bitmap.unpack(bitmap.append(make(full), make({0, 63, 64}), size)).collect()} == full | {size, size + 63, size + 64}
    assert rows(bitmap.statistics(make(full), 301)) == [(1, 2, 1, 2, 1)]
    assert rows(bitmap.statistics(make(set(range(130))), 130)) == [(1, 0, 0, 3, 0)]


def test_running_sums(spark):
    data = [(i * 7 % 50, i) for i in range(50)]
    found = ranking.running_sums(spark.createDataFrame(data, "k long, v long").repartition(5), ["k"], {"v": "before"})
    ordered = sorted(data)
    assert rows(found) == [(k, v, sum(x for _, x in ordered[:i])) for i, (k, v) in enumerate(ordered)]
    assert rows(ranking.running_sums(spark.createDataFrame([], "k long, v long"), ["k"], {"v": "before"})) == []


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Cluster:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        materialize.shared_dir(Session())
    table = materialize.written(spark.range(3), "t")
    assert table.count() == 3
    materialize.dropped(table, None, spark.range(2))
    materialize.dropped(table)


def test_peripheral_sources_of_a_path(spark):
    path = [3, 1, 0, 2, 4, 5, 9, 7]
    g = graph_of(spark, list(zip(path, path[1:], strict=False)))
    assert rows(ordering.peripheral_sources(g, connected_components(g.edges))) == [(0, 7, 7)]
    assert [r["old_id"] for r in ordering.bfs_order(g, peripheral=True).orderBy("new_id").collect()] == path[::-1]


def test_filtered_wedges(spark):
    """No wedge that closes is lost; most others go before the closing join, on random graphs of three sizes."""
    from knotwork.operators.counting import out_wedges
    from knotwork.plans.materialize import written
    from knotwork.sources.derive import rmat_graph

    for scale in (8, 9, 10):
        out = written(rmat_graph(spark, scale, 8 << scale, seed=3).oriented(), "out")
        closing = out.toDF("v", "x")
        every, some = (written(out_wedges(out, filtered), "wedges") for filtered in (False, True))
        assert rows(every.join(closing, ["v", "x"], "left_semi").select("u", "v", "x")) == rows(some.join(closing, ["v", "x"], "left_semi").select("u", "v", "x"))
        print(scale, every.count(), some.count(), every.join(closing, ["v", "x"], "left_semi").count())
        assert some.count() < 0.6 * every.count()


def test_k_core_looks_only_at_what_goes(spark, monkeypatch):
    """The k-core against plain peeling; a graph from which nothing goes takes one table of vertices and no rounds of h-indices."""
    from knotwork.operators import kcore

    pairs = random_pairs(60, 110, 5) + [(i, i + 1) for i in range(100, 112)]  # and a path, which goes from its ends
    for k in (1, 2, 3, 5):
        left = neighbours(pairs)
        while weak := {a for a, near in left.items() if len(near) < k}:
            left = {a: near - weak for a, near in left.items() if a not in weak}
        assert rows(kcore.k_core(graph_of(spark, pairs), k)) == sorted((a, b) for a in left for b in left[a] if a < b)
    labels: list[str] = []
    plain = kcore.written
    monkeypatch.setattr(kcore, "written", lambda df, label="table": labels.append(label) or plain(df, label))
    ring = [(i, (i + 1) % 30) for i in range(30)]
    assert len(rows(kcore.k_core(graph_of(spark, ring), 2))) == 30 and labels == ["left"]
