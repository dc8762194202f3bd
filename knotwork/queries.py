"""Queries over the graph operators; ``QUERIES`` and ``ORACLE_SQL`` are by query name.

The graphs are parts that share an order; ``NAME_docs``: documents linked to the next one that holds the same line; ``NAME_docs_all``: all pairs of
documents that share a line. Every line counts that is not empty, however many documents hold it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions import bitmap, runs
from knotwork.operators import bisection, counting, merging, multiway, ordering, relational, scan, semiring, stats, truss
from knotwork.operators.components import connected_components
from knotwork.operators.graph import Graph, vertices_of
from knotwork.operators.kcore import coreness, k_core
from knotwork.plans.materialize import written
from knotwork.plans.turns import turns_for
from knotwork.sources.derive import line_chains, line_classes, line_graph, order_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_EDGES = """l AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem),
e AS (SELECT DISTINCT a.i AS src, b.i AS dst FROM l a JOIN l b ON a.g = b.g AND a.i < b.i)"""
_LINES = r"""l AS (SELECT DISTINCT doc_id AS i, line AS g FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '')"""
_DOC_EDGES = _LINES + """,
e AS (SELECT DISTINCT src, dst FROM (SELECT i AS src, lead(i) OVER (PARTITION BY g ORDER BY i) AS dst FROM l) WHERE dst IS NOT NULL)"""
_ALL_DOC_EDGES = _LINES + """,
k AS (SELECT g FROM l GROUP BY g HAVING count(*) >= 2),
e AS (SELECT DISTINCT a.i AS src, b.i AS dst FROM l a JOIN l b ON a.g = b.g AND a.i < b.i WHERE a.g IN (SELECT g FROM k))"""
_BASE = """s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
d AS (SELECT src AS id, count(*) AS deg FROM s GROUP BY src),
n AS (SELECT e.src, e.dst, count(b.src) AS cn FROM e LEFT JOIN s a ON a.src = e.src LEFT JOIN s b ON b.src = e.dst AND b.dst = a.dst GROUP BY e.src, e.dst)"""
_ORIENTED = """f AS (SELECT CASE WHEN (x.deg, e.src) < (y.deg, e.dst) THEN e.src ELSE e.dst END AS src, CASE WHEN (x.deg, e.src) < (y.deg, e.dst) THEN e.dst ELSE e.src END AS dst
  FROM e JOIN d x ON x.id = e.src JOIN d y ON y.id = e.dst)"""
_TRIANGLES = """td AS (SELECT id, count(*) AS deg FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
tf AS MATERIALIZED (SELECT CASE WHEN (x.deg, e.src) < (y.deg, e.dst) THEN e.src ELSE e.dst END AS src, CASE WHEN (x.deg, e.src) < (y.deg, e.dst) THEN e.dst ELSE e.src END AS dst
  FROM e JOIN td x ON x.id = e.src JOIN td y ON y.id = e.dst),
t AS (SELECT v[1] AS a, v[2] AS b, v[3] AS c FROM (SELECT list_sort([x.src, x.dst, y.dst]) AS v FROM tf x JOIN tf y ON y.src = x.src AND x.dst < y.dst SEMI JOIN e ON e.src = x.dst AND e.dst = y.dst))"""


def _sql(body: str, *parts: str, edges: str = _EDGES) -> str:
    return "WITH RECURSIVE " + ",\n".join([edges, *(parts or (_BASE,))]) + "\n" + body


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _simple(edges: DataFrame) -> Graph:
    """The graph of written edges, which are canonical and distinct already."""
    return Graph(edges, vertices_of(edges))


def _orders(spark: SparkSession, sf_dir: str) -> Graph:
    return _simple(written(order_graph(spark, sf_dir).edges, "orders"))


def _docs(spark: SparkSession, sf_dir: str) -> Graph:
    return _simple(written(line_chains(spark, sf_dir).edges, "docs"))


def _all_docs(spark: SparkSession, sf_dir: str) -> Graph:
    return _simple(written(line_graph(spark, sf_dir).edges, "docs"))


@_query("edges", _sql("SELECT src, dst FROM e", _BASE))
def edges(spark, sf_dir):
    return order_graph(spark, sf_dir).edges


@_query("symmetric_edges", _sql("SELECT src, dst FROM s", _BASE))
def symmetric_edges(spark, sf_dir):
    return order_graph(spark, sf_dir).symmetric()


@_query("degrees", _sql("SELECT id, deg FROM d"))
def degrees(spark, sf_dir):
    return _orders(spark, sf_dir).degrees()


@_query("adjacency", _sql("SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs FROM s GROUP BY src"))
def adjacency(spark, sf_dir):
    return order_graph(spark, sf_dir).adjacency().select("id", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@_query("csr_offsets", _sql("SELECT id, coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", deg FROM d"))
def csr_offsets(spark, sf_dir):
    return stats.csr_offsets(_orders(spark, sf_dir))


@_query("oriented_edges", _sql("SELECT src, dst FROM f", _BASE, _ORIENTED))
def oriented_edges(spark, sf_dir):
    return _orders(spark, sf_dir).oriented()


_CN = _sql("SELECT src, dst, cn FROM n")


@_query("common_neighbors", _CN)
def common_neighbors(spark, sf_dir):
    return counting.common_neighbors(_orders(spark, sf_dir))


def _cn_by(strategy: str):
    return lambda spark, sf_dir: counting.common_neighbors(_orders(spark, sf_dir), strategy, dense=64)


for _strategy in ("array", "wedge", "block", "hybrid"):
    _query(f"common_neighbors_{_strategy}", _CN)(_cn_by(_strategy))


@_query("common_neighbors_docs", _sql("SELECT src, dst, cn FROM n", edges=_DOC_EDGES))
def common_neighbors_docs(spark, sf_dir):
    return counting.common_neighbors(_docs(spark, sf_dir))


@_query("common_neighbors_docs_all", _sql("SELECT src, dst, cn FROM n", edges=_ALL_DOC_EDGES))
def common_neighbors_docs_all(spark, sf_dir):
    return counting.common_neighbors(_all_docs(spark, sf_dir))


@_query("common_neighbors_mirrored", _sql("SELECT src, dst, cn FROM n UNION ALL SELECT dst, src, cn FROM n"))
def common_neighbors_mirrored(spark, sf_dir):
    cn = counting.common_neighbors(_orders(spark, sf_dir))
    return cn.unionByName(cn.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cn"))


@_query("triangles", _sql("SELECT a, b, c FROM t", _TRIANGLES))
def triangles(spark, sf_dir):
    return counting.triangles(_orders(spark, sf_dir))


@_query("triangle_count", _sql("SELECT count(*) AS triangles FROM t", _TRIANGLES))
def triangle_count(spark, sf_dir):
    return counting.triangle_count(_orders(spark, sf_dir))


@_query("triangle_count_docs", _sql("SELECT count(*) AS triangles FROM t", _TRIANGLES, edges=_DOC_EDGES))
def triangle_count_docs(spark, sf_dir):
    return counting.triangle_count(_docs(spark, sf_dir))


@_query("triangle_count_docs_all", _sql("SELECT count(*) AS triangles FROM t", _TRIANGLES, edges=_ALL_DOC_EDGES))
def triangle_count_docs_all(spark, sf_dir):
    return counting.triangle_count_of_classes(*line_classes(spark, sf_dir))


_FOUR = "w AS MATERIALIZED (SELECT * FROM t), q AS (SELECT x.a, x.b, x.c, y.c AS d FROM w x JOIN w y ON x.a = y.a AND x.b = y.b AND x.c < y.c SEMI JOIN e ON e.src = x.c AND e.dst = y.c)"


@_query("cliques4", _sql("SELECT a, b, c, d FROM q", _TRIANGLES, _FOUR))
def cliques4(spark, sf_dir):
    return counting.cliques4(_orders(spark, sf_dir))


@_query("clique_counts", _sql("SELECT 3::BIGINT AS k, count(*) AS cliques FROM w UNION ALL SELECT 4, count(*) FROM q", _TRIANGLES, _FOUR))
def clique_counts(spark, sf_dir):
    return counting.clique_counts(_orders(spark, sf_dir), 4)


# --- structural clustering -------------------------------------------------------------------------

_SIM = "m AS (SELECT n.src, n.dst, cn, (cn + 2) / sqrt(((x.deg + 1) * (y.deg + 1))::DOUBLE) AS sim FROM n JOIN d x ON x.id = n.src JOIN d y ON y.id = n.dst)"


def _scan_parts(eps: float, mu: int) -> list[str]:
    return [
        _BASE, _SIM,
        f"p AS (SELECT src, dst FROM m WHERE sim >= {eps} UNION ALL SELECT dst, src FROM m WHERE sim >= {eps})",
        "cc AS (SELECT d.id, count(p.src) AS core_count FROM d LEFT JOIN p ON p.src = d.id GROUP BY d.id)",
        f"co AS (SELECT id FROM cc WHERE core_count >= {mu})",
        "cl(id, cluster_id) USING KEY (id) AS (SELECT id, id FROM co UNION SELECT p.dst, min(w.cluster_id) FROM cl w JOIN p ON p.src = w.id JOIN recurring.cl r ON r.id = p.dst WHERE w.cluster_id < r.cluster_id GROUP BY p.dst)",
        "hu AS (SELECT s.src AS id, count(DISTINCT cluster_id) AS k FROM s JOIN cl ON cl.id = s.dst WHERE s.src NOT IN (SELECT id FROM co) GROUP BY s.src)",
        "ro AS (SELECT cc.id, core_count, CASE WHEN cc.id IN (SELECT id FROM co) THEN 'CORE' WHEN k > 1 THEN 'HUB' ELSE 'UNCLASSIFIED' END AS role FROM cc LEFT JOIN hu ON hu.id = cc.id)",
        "me AS (SELECT DISTINCT cluster_id, p.src AS id FROM p JOIN cl ON cl.id = p.dst WHERE p.src NOT IN (SELECT id FROM co))",
    ]


@_query("edge_similarity", _sql("SELECT src, dst, cn, round(sim, 6) AS sim, sim >= 0.18 AS similar FROM m", _BASE, _SIM))
def edge_similarity(spark, sf_dir):
    rows = scan.edge_similarity(_orders(spark, sf_dir), 0.18)
    return rows.select("src", "dst", "cn", F.round("sim", 6).alias("sim"), "similar")


@_query("core_counts", _sql("SELECT id, core_count FROM cc", *_scan_parts(0.18, 2)[:4]))
def core_counts(spark, sf_dir):
    graph = _orders(spark, sf_dir)
    return scan.core_counts(graph, scan.edge_similarity(graph, 0.18))


@_query("scan_roles", _sql("SELECT id, core_count, role FROM ro", *_scan_parts(0.18, 2)))
def scan_roles(spark, sf_dir):
    return scan.cluster(_orders(spark, sf_dir), 0.18, 2).roles


@_query("scan_clusters", _sql("SELECT id, cluster_id FROM cl", *_scan_parts(0.18, 2)))
def scan_clusters(spark, sf_dir):
    return scan.cluster(_orders(spark, sf_dir), 0.18, 2).clusters


@_query("scan_members", _sql("SELECT cluster_id, id FROM me", *(part.replace(">= 0.18", ">= (SELECT 0.85::DOUBLE * max(sim) FROM m)") for part in _scan_parts(0.18, 2))))
def scan_members(spark, sf_dir):
    """The threshold is a share of the graph's largest similarity, so that there are cores with members at every size."""
    graph = _orders(spark, sf_dir)
    most = scan.edge_similarity(graph, 0.0).agg(F.max("sim")).first()[0]
    return scan.cluster(graph, 0.85 * (most or 0.0), 2).members


_RESULT = "SELECT 'c' AS kind, id AS vertex_id, cluster_id FROM cl UNION ALL SELECT 'n', id, cluster_id FROM me"
_SUMMARY = """SELECT (SELECT count(*) FROM ro WHERE role = 'CORE') AS cores, (SELECT count(*) FROM ro WHERE role = 'HUB') AS hubs, (SELECT count(*) FROM ro WHERE role = 'UNCLASSIFIED') AS outliers,
  (SELECT count(DISTINCT cluster_id) FROM cl) AS clusters, (SELECT count(*) FROM me) AS member_rows"""


@_query("scan_result", _sql(_RESULT, *_scan_parts(0.18, 2)))
def scan_result(spark, sf_dir):
    return scan.cluster(_orders(spark, sf_dir), 0.18, 2).result_rows()


@_query("scan_summary", _sql(_SUMMARY, *_scan_parts(0.18, 2)))
def scan_summary(spark, sf_dir):
    return scan.cluster(_orders(spark, sf_dir), 0.18, 2).summary()


@_query("scan_summary_docs", _sql(_SUMMARY, *_scan_parts(0.6, 2), edges=_DOC_EDGES))
def scan_summary_docs(spark, sf_dir):
    return scan.cluster(_docs(spark, sf_dir), 0.6, 2).summary()


@_query("scan_summary_docs_all", _sql(_SUMMARY, *_scan_parts(0.6, 2), edges=_ALL_DOC_EDGES))
def scan_summary_docs_all(spark, sf_dir):
    return scan.cluster(_all_docs(spark, sf_dir), 0.6, 2).summary()


_COMPONENTS = "cc(id, component) USING KEY (id) AS (SELECT id, id FROM d UNION SELECT s.dst, min(w.component) FROM cc w JOIN s ON s.src = w.id JOIN recurring.cc r ON r.id = s.dst WHERE w.component < r.component GROUP BY s.dst)"


def _walk(name: str, sources: str) -> str:
    """Levels from ``sources``, a query of ids."""
    return f"{name}(id, level) USING KEY (id) AS (SELECT id, 0::BIGINT FROM ({sources}) UNION SELECT s.dst, min(w.level) + 1 FROM {name} w JOIN s ON s.src = w.id WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.id = s.dst) GROUP BY s.dst)"


@_query("components", _sql("SELECT id, component FROM cc", _BASE, _COMPONENTS))
def components(spark, sf_dir):
    return connected_components(order_graph(spark, sf_dir).edges)


@_query("bfs_levels", _sql("SELECT id, level FROM walk", _BASE, _walk("walk", "SELECT min(id) AS id FROM d")))
def bfs_levels(spark, sf_dir):
    """From the smallest id, to the fixed point."""
    graph = _orders(spark, sf_dir)
    return relational.bfs_levels(graph.edges, graph.vertices.agg(F.min("id").alias("id")))


@_query("bfs_levels_docs", _sql("SELECT id, level FROM walk WHERE level <= 6", _BASE, _walk("walk", "SELECT min(id) AS id FROM d"), edges=_DOC_EDGES))
def bfs_levels_docs(spark, sf_dir):
    """What is within six steps: the limit is the operator's."""
    graph = _docs(spark, sf_dir)
    return relational.bfs_levels(graph.edges, graph.vertices.agg(F.min("id").alias("id")), max_level=6)


# --- cores and orders ------------------------------------------------------------------------------


def _peeled(k: int) -> str:
    """Vertices of the k-core: those with fewer than k neighbours left go, round by round, until none does."""
    return f"""h(round, id, k, before) AS (SELECT 0, id, (SELECT count(*) FROM d), (SELECT count(*) + 1 FROM d) FROM d UNION ALL
  (SELECT round + 1, id, count(*) OVER (), k FROM (SELECT h.round, h.k, s.src AS id FROM h JOIN s ON s.src = h.id SEMI JOIN h o ON o.id = s.dst WHERE h.k < h.before GROUP BY ALL HAVING count(*) >= {k}))),
core AS (SELECT id FROM h WHERE round = (SELECT max(round) FROM h))"""


@_query("two_core", _sql("SELECT src, dst FROM e WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)", _BASE.split(",\nn AS")[0], _peeled(2)))
def two_core(spark, sf_dir):
    return k_core(_orders(spark, sf_dir), 2)


#: So many rounds of h-indices; more than any graph of the test tables takes.
_CORES = """h(round, id, core) AS (SELECT 0, id, deg FROM d UNION ALL
  SELECT round + 1, id, max(least(core, k)) FROM (SELECT round, s.src AS id, h.core, row_number() OVER (PARTITION BY s.src ORDER BY h.core DESC) AS k FROM h JOIN s ON s.dst = h.id WHERE round < 40) GROUP BY round, id),
c AS (SELECT id, core FROM h WHERE round = 40)"""


@_query("coreness", _sql("SELECT id, core FROM c", _BASE, _CORES))
def core_numbers(spark, sf_dir):
    return coreness(_orders(spark, sf_dir))


#: Rounds of h-indices over triangles, until no value falls (or 60, more than the test tables take).
_TRUSS = """ts AS MATERIALIZED (SELECT unnest([{'x': a, 'y': b, 'p': a, 'q': c, 'r': b, 's': c}, {'x': a, 'y': c, 'p': a, 'q': b, 'r': b, 's': c}, {'x': b, 'y': c, 'p': a, 'q': b, 'r': a, 's': c}], recursive := true) FROM t),
tr(round, x, y, v, falls) AS (SELECT 0, x, y, count(*), 1::BIGINT FROM ts GROUP BY x, y UNION ALL
  (WITH low AS (SELECT ts.x, ts.y, least(m.v, n.v) AS low FROM ts JOIN tr m ON m.x = p AND m.y = q JOIN tr n ON n.x = r AND n.y = s),
   h AS (SELECT x, y, max(least(low, k)) AS h FROM (SELECT x, y, low, row_number() OVER (PARTITION BY x, y ORDER BY low DESC) AS k FROM low) GROUP BY x, y)
   SELECT tr.round + 1, tr.x, tr.y, least(v, h), sum((h < v)::BIGINT) OVER () FROM tr JOIN h USING (x, y) WHERE falls > 0 AND tr.round < 60)),
tn AS (SELECT src, dst, coalesce(v, 0) + 2 AS truss FROM e LEFT JOIN (SELECT * FROM tr WHERE round = (SELECT max(round) FROM tr)) ON x = src AND y = dst)"""


@_query("truss_numbers", _sql("SELECT src, dst, truss FROM tn", _TRIANGLES, _TRUSS, edges=_ALL_DOC_EDGES))
def truss_numbers(spark, sf_dir):
    return truss.truss_numbers(_all_docs(spark, sf_dir))


@_query("largest_truss", _sql("SELECT max(truss) AS max_truss, count(*) AS n_edges, (SELECT count(DISTINCT id) FROM (SELECT unnest([src, dst]) AS id FROM tn WHERE truss = (SELECT max(truss) FROM tn))) AS n_vertices FROM tn WHERE truss = (SELECT max(truss) FROM tn)", _TRIANGLES, _TRUSS, edges=_ALL_DOC_EDGES))
def largest_truss(spark, sf_dir):
    return truss.largest_truss(_all_docs(spark, sf_dir))


_BY = "SELECT id AS old_id, row_number() OVER (ORDER BY {}) - 1 AS new_id FROM d"


@_query("order_degree", _sql(_BY.format("deg DESC, id")))
def order_degree(spark, sf_dir):
    return ordering.degree_order(_orders(spark, sf_dir))


@_query("order_degree_ascending", _sql(_BY.format("deg, id")))
def order_degree_ascending(spark, sf_dir):
    return ordering.degree_order(_orders(spark, sf_dir), descending=False)


@_query("order_original", _sql(_BY.format("id")))
def order_original(spark, sf_dir):
    return ordering.original_order(_orders(spark, sf_dir))


@_query("order_core", _sql("SELECT id AS old_id, row_number() OVER (ORDER BY core DESC, id) - 1 AS new_id FROM c", _BASE, _CORES))
def order_core(spark, sf_dir):
    return ordering.core_order(_orders(spark, sf_dir))


@_query("order_core_degree", _sql("SELECT c.id AS old_id, row_number() OVER (ORDER BY core * (deg + 1) DESC, c.id) - 1 AS new_id FROM c JOIN d ON d.id = c.id", _BASE, _CORES))
def order_core_degree(spark, sf_dir):
    return ordering.core_order(_orders(spark, sf_dir), by_degree_product=True)


@_query("order_random", _sql(_BY.format("md5('7:' || id), id")))
def order_random(spark, sf_dir):
    return ordering.random_order(_orders(spark, sf_dir), seed=7)


_ROOTS = "SELECT DISTINCT component AS id FROM cc"
_PLACES = "bp AS (SELECT d.id, deg, row_number() OVER (ORDER BY component, level, deg, d.id) - 1 AS place FROM d JOIN cc ON cc.id = d.id JOIN walk ON walk.id = d.id)"


@_query("order_bfs", _sql("SELECT id AS old_id, place AS new_id FROM bp", _BASE, _COMPONENTS, _walk("walk", _ROOTS), _PLACES, edges=_DOC_EDGES))
def order_bfs(spark, sf_dir):
    return ordering.bfs_order(_docs(spark, sf_dir))


@_query("order_bfs_reverse", _sql("SELECT id AS old_id, (SELECT max(place) FROM bp) - place AS new_id FROM bp", _BASE, _COMPONENTS, _walk("walk", _ROOTS), _PLACES))
def order_bfs_reverse(spark, sf_dir):
    return ordering.bfs_order(_orders(spark, sf_dir), reverse=True)


def _sweep(n: int) -> list[str]:
    """One move of the sources ``b{n}(component, id, depth, tail)`` to their far ends, where that goes deeper."""
    old = f"b{n - 1}"
    deeper = f"x.depth > {old}.depth"
    return [
        _walk(f"w{n}", f"SELECT tail AS id FROM {old}"), _ends(f"x{n}", f"w{n}"),
        f"b{n} AS (SELECT {old}.component, CASE WHEN {deeper} THEN {old}.tail ELSE {old}.id END AS id, CASE WHEN {deeper} THEN x.depth ELSE {old}.depth END AS depth, CASE WHEN {deeper} THEN x.tail ELSE {old}.tail END AS tail FROM {old} JOIN x{n} x ON x.component = {old}.component)",
    ]


def _ends(name: str, walk: str) -> str:
    return f"{name} AS (SELECT component, max(level) AS depth, arg_min(w.id, (-level, deg, w.id)) AS tail FROM {walk} w JOIN cc ON cc.id = w.id JOIN d ON d.id = w.id GROUP BY component)"


_FAR = [_BASE, _COMPONENTS, _walk("w0", _ROOTS), _ends("x0", "w0"), "b0 AS (SELECT component, component AS id, depth, tail FROM x0)", *_sweep(1), *_sweep(2)]


@_query("peripheral_sources", _sql("SELECT component, id, depth FROM b2", *_FAR, edges=_DOC_EDGES))
def peripheral_sources(spark, sf_dir):
    graph = _docs(spark, sf_dir)
    return ordering.peripheral_sources(graph, connected_components(graph.edges))


@_query("order_bfs_peripheral", _sql("SELECT id AS old_id, place AS new_id FROM bp", *_FAR, _walk("walk", "SELECT id FROM b2"), _PLACES, edges=_DOC_EDGES))
def order_bfs_peripheral(spark, sf_dir):
    return ordering.bfs_order(_docs(spark, sf_dir), peripheral=True)


def _labels(rounds: int) -> str:
    """Label propagation, written out round by round."""
    steps = ["g0 AS (SELECT id, id AS community FROM d)"]
    for i in range(rounds):
        votes = f"SELECT id, community FROM (SELECT s.src AS id, community, row_number() OVER (PARTITION BY s.src ORDER BY count(*) DESC, community) AS n FROM s JOIN g{i} ON g{i}.id = s.dst GROUP BY s.src, community) WHERE n = 1"
        steps.append(f"g{i + 1} AS MATERIALIZED (SELECT o.id, CASE WHEN md5('{i}:' || o.id) < '8' AND v.id IS NOT NULL THEN v.community ELSE o.community END AS community FROM g{i} o LEFT JOIN ({votes}) v ON v.id = o.id)")
    return ", ".join(steps)


def _mckee(sources: str) -> str:
    return f"""mk(id, level, rank) USING KEY (id) AS (SELECT id, 0::BIGINT, row_number() OVER (ORDER BY component) FROM ({sources}) UNION
  SELECT id, level, row_number() OVER (ORDER BY p, deg, id) FROM (SELECT s.dst AS id, min(w.level) + 1 AS level, min(w.rank) AS p, any_value(d.deg) AS deg FROM mk w JOIN s ON s.src = w.id JOIN d ON d.id = s.dst
    WHERE NOT EXISTS (SELECT 1 FROM recurring.mk r WHERE r.id = s.dst) GROUP BY s.dst)),
mp AS (SELECT mk.id, row_number() OVER (ORDER BY component, level, rank) - 1 AS place, count(*) OVER () AS n FROM mk JOIN cc ON cc.id = mk.id)"""


@_query("order_cuthill_mckee", _sql("SELECT id AS old_id, place AS new_id FROM mp", _BASE, _COMPONENTS, _mckee("SELECT DISTINCT component AS id, component FROM cc")))
def order_cuthill_mckee(spark, sf_dir):
    """From the smallest id, numbered from the front."""
    return ordering.cuthill_mckee_order(_orders(spark, sf_dir), reverse=False, peripheral=False)


@_query("order_reverse_cuthill_mckee", _sql("SELECT id AS old_id, n - 1 - place AS new_id FROM mp", *_FAR, _mckee("SELECT id, component FROM b2"), edges=_ALL_DOC_EDGES))
def order_reverse_cuthill_mckee(spark, sf_dir):
    return ordering.cuthill_mckee_order(_all_docs(spark, sf_dir))


_WIDTHS = "SELECT '{}' AS ids, max(b) AS bandwidth, round(avg(w), 6) AS avg_width, max(k) AS max_degree FROM (SELECT max(abs(src - dst)) AS b, max(dst) - min(dst) AS w, count(*) AS k FROM {} GROUP BY src)"


@_query("bandwidth_reduced", _sql(f"{_WIDTHS.format('given', 's')} UNION ALL {_WIDTHS.format('reverse Cuthill-McKee', 'ms')}", *_FAR, _mckee("SELECT id, component FROM b2"),
    "ms AS (SELECT x.n - 1 - x.place AS src, y.n - 1 - y.place AS dst FROM s JOIN mp x ON x.id = s.src JOIN mp y ON y.id = s.dst)", edges=_ALL_DOC_EDGES))
def bandwidth_reduced(spark, sf_dir):
    graph = _all_docs(spark, sf_dir)
    moved = graph.relabelled(written(ordering.cuthill_mckee_order(graph), "perm"))
    widths = lambda g, name: stats.bandwidth(g).select(F.lit(name).alias("ids"), "*")
    return widths(graph, "given").unionByName(widths(moved, "reverse Cuthill-McKee"))


def _merges(rounds: int) -> str:
    """Rounds of merging by modularity gain, written out; ``y{i}(id, community)`` after round i."""
    m2 = "(2 * (SELECT count(*) FROM e))::HUGEINT"
    steps = ["y0 AS (SELECT id, id AS community FROM d)"]
    for i in range(rounds):
        suits = f"md5('{i}:' || u) >= '8' AND md5('{i}:' || v) < '8'"
        steps += [
            f"st{i} AS MATERIALIZED (SELECT community AS id, sum(deg)::HUGEINT AS s FROM y{i} JOIN d USING (id) GROUP BY community)",
            f"ww{i} AS MATERIALIZED (SELECT x.community AS u, y.community AS v, count(*)::HUGEINT AS w FROM s JOIN y{i} x ON x.id = s.src JOIN y{i} y ON y.id = s.dst WHERE x.community <> y.community GROUP BY ALL)",
            f"bb{i} AS MATERIALIZED (SELECT u, v, w, a.s AS su, b.s AS sv, {m2} * w - a.s * b.s AS gain FROM ww{i} JOIN st{i} a ON a.id = u JOIN st{i} b ON b.id = v WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY u ORDER BY gain DESC, v) = 1)",
            f"su{i} AS MATERIALIZED (SELECT *, sum(su) OVER (PARTITION BY v) AS alls, row_number() OVER (PARTITION BY v ORDER BY gain DESC, u) AS n FROM bb{i} WHERE {suits})",
            f"y{i + 1} AS MATERIALIZED (SELECT id, coalesce(v, community) AS community FROM y{i} LEFT JOIN (SELECT u, v FROM su{i} WHERE n = 1 OR {m2} * w - su * (sv + alls - su) > 0) ON u = community)",
        ]
    return ", ".join(steps)


def _merge_order(rounds: int) -> str:
    keys = [f"y{rounds}.community"]
    for i in range(rounds, 0, -1):
        keys += [f"y{i - 1}.community <> y{i}.community", f"y{i - 1}.community"]
    return f"SELECT y0.id AS old_id, row_number() OVER (ORDER BY {', '.join(keys)}) - 1 AS new_id FROM y0 " + " ".join(f"JOIN y{i} ON y{i}.id = y0.id" for i in range(1, rounds + 1))


@_query("order_merging", _sql(_merge_order(8), _BASE.split(",\nn AS")[0], _merges(8)))
def order_merging(spark, sf_dir):
    return merging.merge_by_modularity(_orders(spark, sf_dir), rounds=8).order()


_Q_OF = "SELECT '{}' AS method, round(sum(inn / m - (al / m) ** 2), 9) AS modularity FROM (SELECT x.community, count(*) FILTER (x.community = y.community) AS inn, count(*) AS al, sum(count(*)) OVER () AS m FROM s JOIN {} x ON x.id = s.src JOIN {} y ON y.id = s.dst GROUP BY x.community)"


@_query("merging_modularity", _sql(f"{_Q_OF.format('merging', 'y24', 'y24')} UNION ALL {_Q_OF.format('labels', 'g5', 'g5')}", _BASE.split(",\nn AS")[0], _merges(24), _labels(5), edges=_ALL_DOC_EDGES))
def merging_modularity(spark, sf_dir):
    """On all links between documents: merging, and label propagation beside it."""
    graph = _all_docs(spark, sf_dir)
    of = lambda found, name: stats.modularity(graph, written(found, "communities")).select(F.lit(name).alias("method"), "modularity")
    return of(merging.merge_by_modularity(graph, rounds=24).communities(), "merging").unionByName(of(ordering.communities(graph), "labels"))


def _split(old: str, sides: str, new: str) -> str:
    """The intervals ``new(id, low, n)`` of the halves ``sides(id, low, n, side)``, and those of ``old`` that are leaves."""
    return f"""{new} AS MATERIALIZED (SELECT id, low, n FROM {old} WHERE n < 32 UNION ALL
  SELECT id, CASE WHEN side = 0 THEN low ELSE low + n // 2 END, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END FROM {sides})"""


_WHOLE = "iv0 AS (SELECT id, 0::BIGINT AS low, count(*) OVER () AS n FROM d)"
_LOG_COST = "(({l}) * log2((n // 2) / (({l}) + 1.0::DOUBLE)) + ({r}) * log2((n - n // 2) / (({r}) + 1.0::DOUBLE)))"


def _gap_halves(levels: int, rounds: int) -> str:
    """Bisection by log gaps, level by level and round by round; ``iv{levels}`` has the last intervals."""
    unit = lambda a, b: f"round(({_LOG_COST.format(l='l', r='r')} - {_LOG_COST.format(l=a, r=b)}) * 1048576)::BIGINT"
    steps = [_WHOLE]
    for x in range(levels):
        steps.append(f"h{x}_0 AS MATERIALIZED (SELECT id, low, n, (row_number() OVER (PARTITION BY low ORDER BY id) > n // 2)::INTEGER AS side FROM iv{x} WHERE n >= 32)")
        for y in range(rounds):
            now = f"h{x}_{y}"
            steps += [
                f"q{now} AS (SELECT src, low, CASE WHEN l > 0 THEN {unit('l - 1', 'r + 1')} END AS away, CASE WHEN r > 0 THEN {unit('l + 1', 'r - 1')} END AS back"
                f" FROM (SELECT s.src, low, n, count(*) FILTER (side = 0) AS l, count(*) FILTER (side = 1) AS r FROM s JOIN {now} ON id = s.dst GROUP BY s.src, low, n))",
                f"g{now} AS MATERIALIZED (SELECT id, low, n, side, gain, row_number() OVER (PARTITION BY low, side ORDER BY gain DESC, id) AS place FROM (SELECT h.id, h.low, h.n, h.side,"
                f" coalesce(sum(CASE WHEN side = 0 THEN away ELSE back END), 0)::BIGINT AS gain FROM {now} h LEFT JOIN s ON s.dst = h.id LEFT JOIN q{now} q ON q.src = s.src AND q.low = h.low GROUP BY ALL))",
                f"h{x}_{y + 1} AS MATERIALIZED (SELECT a.id, a.low, a.n, CASE WHEN a.gain + b.gain > 0 THEN 1 - a.side ELSE a.side END AS side FROM g{now} a LEFT JOIN g{now} b ON b.low = a.low AND b.side = 1 - a.side AND b.place = a.place)",
            ]
        steps.append(_split(f"iv{x}", f"h{x}_{rounds}", f"iv{x + 1}"))
    return ",\n".join(steps)


def _walk_halves(levels: int) -> str:
    """Bisection along breadth-first walks; ``jv{levels}`` has the last intervals."""
    steps = [_WHOLE.replace("iv0", "jv0")]
    for x in range(levels):
        walk = lambda name, sources: _walk(name, sources).replace(" s ON s.src", f" s{x} s ON s.src")  # noqa: B023, E731
        steps += [
            f"s{x} AS MATERIALIZED (SELECT src, dst FROM s JOIN jv{x} a ON a.id = src JOIN jv{x} b ON b.id = dst WHERE a.low = b.low AND a.n >= 32)",
            f"d{x} AS (SELECT src AS id, count(*) AS deg FROM s{x} GROUP BY src)",
            f"c{x}(id, component) USING KEY (id) AS (SELECT id, id FROM d{x} UNION SELECT s.dst, min(w.component) FROM c{x} w JOIN s{x} s ON s.src = w.id JOIN recurring.c{x} r ON r.id = s.dst WHERE w.component < r.component GROUP BY s.dst)",
            walk(f"wa{x}", f"SELECT DISTINCT component AS id FROM c{x}"),
            f"tail{x} AS (SELECT arg_min(w.id, (-level, deg, w.id)) AS id FROM wa{x} w JOIN c{x} c ON c.id = w.id JOIN d{x} d ON d.id = w.id GROUP BY component)",
            walk(f"wb{x}", f"SELECT id FROM tail{x}"),
            f"k{x} AS MATERIALIZED (SELECT j.id, low, n, (row_number() OVER (PARTITION BY low ORDER BY coalesce(component, j.id), coalesce(level, 0), j.id) > n // 2)::INTEGER AS side FROM jv{x} j LEFT JOIN c{x} c ON c.id = j.id LEFT JOIN wb{x} w ON w.id = j.id WHERE n >= 32)",
            _split(f"jv{x}", f"k{x}", f"jv{x + 1}"),
        ]
    return ",\n".join(steps)


_FLAT = _BASE.split(",\nn AS")[0]
_PLACED = "SELECT id AS old_id, row_number() OVER (ORDER BY low, id) - 1 AS new_id FROM {}"


@_query("order_gap_bisection", _sql(_PLACED.format("iv3"), _FLAT, _gap_halves(3, 3)))
def order_gap_bisection(spark, sf_dir):
    """Three levels of three rounds."""
    return bisection.gap_bisection_order(_orders(spark, sf_dir), levels=3, rounds=3)


@_query("order_walk_bisection", _sql(_PLACED.format("jv2"), _FLAT, _walk_halves(2), edges=_ALL_DOC_EDGES))
def order_walk_bisection(spark, sf_dir):
    """Two levels, on all links between documents."""
    return bisection.walk_bisection_order(_all_docs(spark, sf_dir), levels=2)


_LOG_GAP = """SELECT '{0}' AS ids, round(sum(log2(gap)) / count(*), 6) AS avg_log_gap FROM (SELECT b.new_id - lag(b.new_id) OVER (PARTITION BY s.src ORDER BY b.new_id) AS gap FROM s JOIN ({1}) b ON b.old_id = s.dst) WHERE gap IS NOT NULL"""


@_query("bisection_gaps", _sql(" UNION ALL ".join([_LOG_GAP.format("given", _PLACED.format("(SELECT id, 0 AS low FROM d)")), _LOG_GAP.format("gaps", _PLACED.format("iv4")), _LOG_GAP.format("walks", _PLACED.format("jv2"))]), _FLAT, _gap_halves(4, 3), _walk_halves(2), edges=_ALL_DOC_EDGES))
def bisection_gaps(spark, sf_dir):
    """The mean logarithm of gaps between neighbours, of the given order of ids and of both bisections."""
    graph = _all_docs(spark, sf_dir)
    orders = {"given": ordering.original_order(graph), "gaps": bisection.gap_bisection_order(graph, levels=4, rounds=3), "walks": bisection.walk_bisection_order(graph, levels=2)}
    rows = [stats.gap_entropy(graph.relabelled(written(perm, "perm"))).select(F.lit(name).alias("ids"), "avg_log_gap") for name, perm in orders.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@_query("order_hybrid", _sql("SELECT id AS old_id, row_number() OVER (ORDER BY deg DESC, place) - 1 AS new_id FROM bp", _BASE, _COMPONENTS, _walk("walk", _ROOTS), _PLACES))
def order_hybrid(spark, sf_dir):
    return ordering.hybrid_order(_orders(spark, sf_dir))


@_query("order_community", _sql("SELECT id AS old_id, row_number() OVER (ORDER BY community, id) - 1 AS new_id FROM g5", _BASE, _labels(5)))
def order_community(spark, sf_dir):
    return ordering.community_order(_orders(spark, sf_dir))


@_query("community_modularity", _sql("""SELECT round(sum(inn / m - (al / m) ** 2), 9) AS modularity FROM (SELECT x.community, count(*) FILTER (x.community = y.community) AS inn, count(*) AS al, sum(count(*)) OVER () AS m
  FROM s JOIN g5 x ON x.id = s.src JOIN g5 y ON y.id = s.dst GROUP BY x.community)""", _BASE, _labels(5), edges=_DOC_EDGES))
def community_modularity(spark, sf_dir):
    graph = _docs(spark, sf_dir)
    return stats.modularity(graph, ordering.communities(graph))


def _burned(k: int, rounds: int) -> str:
    """Rounds of taking the ``k`` vertices of largest degree and all but the largest component of the rest, written out."""
    steps = ["v0 AS (SELECT id FROM d)"]
    for i in range(rounds):
        steps += [
            f"e{i} AS MATERIALIZED (SELECT src, dst FROM s WHERE src IN (SELECT id FROM v{i}) AND dst IN (SELECT id FROM v{i}))",
            f"u{i} AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY coalesce(n, 0) DESC, id) AS rank FROM v{i} LEFT JOIN (SELECT src, count(*) AS n FROM e{i} GROUP BY src) ON src = id QUALIFY rank <= {k})",
            f"t{i} AS MATERIALIZED (SELECT id FROM v{i} WHERE id NOT IN (SELECT id FROM u{i}))",
            f"c{i}(id, part) USING KEY (id) AS (SELECT id, id FROM t{i} UNION SELECT x.dst, min(w.part) FROM c{i} w JOIN e{i} x ON x.src = w.id JOIN recurring.c{i} r ON r.id = x.dst WHERE w.part < r.part GROUP BY x.dst)",
            f"z{i} AS MATERIALIZED (SELECT part, count(*) AS size FROM c{i} GROUP BY part)",
            f"v{i + 1} AS MATERIALIZED (SELECT id FROM c{i} WHERE part = (SELECT part FROM z{i} WHERE size > {k} ORDER BY size DESC, part LIMIT 1))",
        ]
    hubs = " UNION ALL ".join(f"SELECT id, 0 AS side, {i} AS round, rank AS size, 0::BIGINT AS part FROM u{i}" for i in range(rounds))
    spokes = " UNION ALL ".join(f"SELECT c{i}.id, 1, -{i}, -z{i}.size, c{i}.part FROM c{i} JOIN z{i} ON z{i}.part = c{i}.part WHERE c{i}.id NOT IN (SELECT id FROM v{i + 1})" for i in range(rounds))
    return ", ".join([*steps, f"placed AS ({hubs} UNION ALL {spokes})"])


@_query("order_slashburn", _sql("SELECT id AS old_id, row_number() OVER (ORDER BY side, round, size, part, id) - 1 AS new_id FROM placed", _BASE, _burned(40, 12), edges=_DOC_EDGES))
def order_slashburn(spark, sf_dir):
    return ordering.slashburn_order(_docs(spark, sf_dir), hubs_per_round=40)


_PERM = "pm AS (SELECT id, row_number() OVER (ORDER BY deg DESC, id) - 1 AS q FROM d)"


@_query("relabelled_edges", _sql("SELECT least(x.q, y.q) AS src, greatest(x.q, y.q) AS dst FROM e JOIN pm x ON x.id = e.src JOIN pm y ON y.id = e.dst", _BASE, _PERM))
def relabelled_edges(spark, sf_dir):
    graph = _orders(spark, sf_dir)
    return graph.relabelled(ordering.degree_order(graph)).edges


@_query("common_neighbors_reordered", _CN)
def common_neighbors_reordered(spark, sf_dir):
    """Counts on the relabelled graph, mapped back: independent of the order."""
    graph = _orders(spark, sf_dir)
    perm = written(ordering.degree_order(graph), "perm")
    cn = counting.common_neighbors(graph.relabelled(perm))
    back = lambda c: perm.select(F.col("new_id").alias(c), F.col("old_id").alias(f"old_{c}"))
    rows = cn.join(back("src"), "src").join(back("dst"), "dst")
    return rows.select(F.least("old_src", "old_dst").alias("src"), F.greatest("old_src", "old_dst").alias("dst"), "cn")


# --- statistics ------------------------------------------------------------------------------------


@_query("graph_summary", _sql("SELECT (SELECT count(*) FROM d) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, (SELECT avg(deg) FROM d) AS avg_degree, (SELECT max(deg) FROM d) AS max_degree, (SELECT max(k) FROM (SELECT count(*) AS k FROM f GROUP BY src)) AS max_out_degree", _BASE, _ORIENTED))
def graph_summary(spark, sf_dir):
    return stats.graph_summary(_orders(spark, sf_dir))


@_query("support_summary", _sql("SELECT max(cn) AS max_cn, sum(cn)::BIGINT AS sum_cn, count(*) FILTER (cn = 0) AS empty_edges, count(*) FILTER (cn = 0) / count(*) AS empty_share FROM n"))
def support_summary(spark, sf_dir):
    return stats.support_summary(counting.common_neighbors(_orders(spark, sf_dir)))


@_query("cn_histogram", _sql("SELECT cn AS value, count(*) AS rows FROM n GROUP BY cn"))
def cn_histogram(spark, sf_dir):
    return stats.histogram(counting.common_neighbors(_orders(spark, sf_dir)), "cn")


_BINS = """hi AS (SELECT deg AS value, count(*) AS k, row_number() OVER (ORDER BY deg) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY deg),
gb(n, bin, low, held, closed) AS (SELECT n, 0::BIGINT, value, k::BIGINT, k > 0.1 * total FROM hi WHERE n = 1
  UNION ALL SELECT hi.n, bin + closed::BIGINT, CASE WHEN closed THEN value ELSE low END, CASE WHEN closed THEN k ELSE held + k END, CASE WHEN closed THEN k ELSE held + k END > 0.1 * total FROM gb JOIN hi ON hi.n = gb.n + 1)"""


@_query("degree_bins", _sql("SELECT bin, min(low) AS low, max(value) AS high, max(held) AS rows FROM gb JOIN hi USING (n) GROUP BY bin", _BASE, _BINS))
def degree_bins(spark, sf_dir):
    return stats.greedy_bins(stats.histogram(_orders(spark, sf_dir).degrees(), "deg"))


@_query("edge_skew", _sql("SELECT count(*) AS n_edges, count(*) FILTER ((x.deg + 1) // 3 > y.deg + 1 OR (y.deg + 1) // 3 > x.deg + 1) AS skewed_edges FROM e JOIN d x ON x.id = src JOIN d y ON y.id = dst"))
def edge_skew(spark, sf_dir):
    return stats.edge_skew(_orders(spark, sf_dir), ratio=3)


@_query("oriented_skew", _sql("SELECT count(*) AS n_edges, count(*) FILTER (a // 2 > b OR b // 2 > a) AS skewed_edges FROM (SELECT o.k + 1 AS a, coalesce(q.k, 0) + 1 AS b FROM f JOIN o ON o.src = f.src LEFT JOIN o q ON q.src = f.dst)", _BASE, _ORIENTED, "o AS (SELECT src, count(*) AS k FROM f GROUP BY src)"))
def oriented_skew(spark, sf_dir):
    return stats.oriented_skew(_orders(spark, sf_dir), ratio=2)


@_query("intersection_stats", _sql("""SELECT floor(log10(x.deg + y.deg))::BIGINT AS bin, count(*) AS edges, min(cn / least(x.deg, y.deg)) AS min_sel, max(cn / least(x.deg, y.deg)) AS max_sel, round(avg(cn / least(x.deg, y.deg)), 9) AS avg_sel,
  min(greatest(x.deg, y.deg) // least(x.deg, y.deg)) AS min_skew, max(greatest(x.deg, y.deg) // least(x.deg, y.deg)) AS max_skew, round(avg(greatest(x.deg, y.deg) // least(x.deg, y.deg)), 9) AS avg_skew
  FROM n JOIN d x ON x.id = src JOIN d y ON y.id = dst GROUP BY 1"""))
def intersection_stats(spark, sf_dir):
    graph = _orders(spark, sf_dir)
    return stats.intersection_stats(graph, counting.common_neighbors(graph))


_DENSE = "SELECT src AS id, count(*) AS deg, count(DISTINCT dst // 64) AS blocks FROM s GROUP BY src HAVING count(*) >= 16 AND count(*) > 2 * count(DISTINCT dst // 64)"


@_query("dense_vertices", _sql(_DENSE, _BASE))
def dense_vertices(spark, sf_dir):
    return stats.dense_vertices(_orders(spark, sf_dir))


@_query("dense_vertices_all", _sql(_DENSE, _BASE, edges=_ALL_DOC_EDGES))
def dense_vertices_all(spark, sf_dir):
    return stats.dense_vertices(_all_docs(spark, sf_dir))


@_query("intersection_waste", _sql("""SELECT hits AS triangles, k - closing AS empty_edges, probed - hits AS mismatch, (probed - hits) / (3 * hits + probed - hits) AS ratio FROM (SELECT (SELECT count(*) FROM f) AS k, (SELECT coalesce(sum(n), 0)::BIGINT FROM w) AS hits,
  (SELECT count(*) FROM w) AS closing, (SELECT coalesce(sum(n), 0)::BIGINT FROM f JOIN o ON o.src = f.dst) AS probed)""", _BASE, _ORIENTED, "o AS (SELECT src, count(*) AS n FROM f GROUP BY src), w AS (SELECT a.src, a.dst, count(*) AS n FROM f a JOIN f b ON b.src = a.dst JOIN f c ON c.src = a.src AND c.dst = b.dst GROUP BY a.src, a.dst)"))
def intersection_waste(spark, sf_dir):
    return stats.intersection_waste(_orders(spark, sf_dir))


_RANGES = "SELECT part, min(id) AS first_id, max(id) AS last_id, sum(w)::BIGINT AS weight FROM (SELECT id, w, least((sum(w) OVER (ORDER BY id) - w) * 8 // sum(w) OVER (), 7)::BIGINT AS part FROM {}) GROUP BY part"


@_query("balanced_ranges", _sql(_RANGES.format("(SELECT id, deg + 2 AS w FROM d)")))
def balanced_ranges(spark, sf_dir):
    return stats.balanced_ranges(_orders(spark, sf_dir), 8)


@_query("filtered_ranges", _sql(_RANGES.format("(SELECT d.id, coalesce(sum(y.deg + 2), 0)::BIGINT AS w FROM d LEFT JOIN e ON e.src = d.id LEFT JOIN d y ON y.id = e.dst GROUP BY d.id)")))
def filtered_ranges(spark, sf_dir):
    return stats.balanced_ranges(_orders(spark, sf_dir), 8, filtered=True)


@_query("order_compression", _sql("SELECT k AS n_edges, o AS out_blocks, i AS in_blocks, (o + i) / k AS ratio FROM (SELECT (SELECT count(*) FROM e) AS k, (SELECT count(*) FROM (SELECT DISTINCT src, dst // 32 FROM e)) AS o, (SELECT count(*) FROM (SELECT DISTINCT dst, src // 32 FROM e)) AS i)"))
def order_compression(spark, sf_dir):
    return stats.order_compression(_orders(spark, sf_dir))


@_query("big_nodes", _sql("SELECT count(*) AS n_vertices, round(avg(deg), 9) AS avg_degree, round(avg(deg * deg) - avg(deg) * avg(deg), 6) AS var_degree FROM (SELECT deg, sum(deg) OVER (ORDER BY deg DESC, id ROWS UNBOUNDED PRECEDING) - deg AS before, sum(deg) OVER () AS total FROM d) WHERE before < 0.3 * total"))
def big_nodes(spark, sf_dir):
    return stats.big_nodes(_orders(spark, sf_dir), 0.3)


@_query("sqrt_degree_weights", _sql("SELECT id, round(sqrt(deg) / sum(sqrt(deg)) OVER (), 9) AS weight FROM d"))
def sqrt_degree_weights(spark, sf_dir):
    return stats.sqrt_degree_weights(_orders(spark, sf_dir)).select("id", F.round("weight", 9).alias("weight"))


@_query("degree_decades", _sql("SELECT CASE WHEN deg <= 1 THEN 0 ELSE length((deg - 1)::VARCHAR) END::BIGINT AS decade, count(*) AS vertices FROM d GROUP BY 1", _BASE, edges=_DOC_EDGES))
def degree_decades(spark, sf_dir):
    return stats.degree_decades(_docs(spark, sf_dir))


@_query("degree_decades_all", _sql("SELECT CASE WHEN deg <= 1 THEN 0 ELSE length((deg - 1)::VARCHAR) END::BIGINT AS decade, count(*) AS vertices FROM d GROUP BY 1", _BASE, edges=_ALL_DOC_EDGES))
def degree_decades_all(spark, sf_dir):
    return stats.degree_decades(_all_docs(spark, sf_dir))


@_query("gap_entropy", _sql("SELECT round(-sum(k / n * log2(k / n)), 6) AS entropy, round(sum(k * log2(gap)) / max(n), 6) AS avg_log_gap FROM (SELECT gap, count(*) AS k, sum(count(*)) OVER () AS n FROM (SELECT dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM s) WHERE gap IS NOT NULL GROUP BY gap)"))
def gap_entropy(spark, sf_dir):
    return stats.gap_entropy(_orders(spark, sf_dir))


@_query("locality", _sql("SELECT (SELECT count(*) FROM s a JOIN s b ON a.dst = b.dst AND b.src - a.src BETWEEN 1 AND 5) + (SELECT count(*) FROM e WHERE dst - src <= 5) AS score"))
def locality(spark, sf_dir):
    return stats.locality(_orders(spark, sf_dir))


@_query("modularity", _sql("""SELECT round(sum(inn / m - (al / m) ** 2), 9) AS modularity FROM (SELECT x.c, count(*) FILTER (x.c = y.c) AS inn, count(*) AS al, sum(count(*)) OVER () AS m
  FROM s JOIN g x ON x.id = s.src JOIN g y ON y.id = s.dst GROUP BY x.c)""", _BASE, "g AS (SELECT id, id % 10 AS c FROM d)"))
def modularity(spark, sf_dir):
    graph = _orders(spark, sf_dir)
    return stats.modularity(graph, graph.vertices.select("id", (F.col("id") % 10).alias("community")))


@_query("bandwidth", _sql("SELECT max(b) AS bandwidth, round(avg(w), 6) AS avg_width, max(k) AS max_degree FROM (SELECT max(abs(src - dst)) AS b, max(dst) - min(dst) AS w, count(*) AS k FROM s GROUP BY src)"))
def bandwidth(spark, sf_dir):
    return stats.bandwidth(_orders(spark, sf_dir))


@_query("leaf_count", _sql("SELECT count(*) AS leaves FROM (SELECT src FROM e GROUP BY src HAVING count(*) = 1 UNION SELECT dst FROM e GROUP BY dst HAVING count(*) = 1)"))
def leaf_count(spark, sf_dir):
    return stats.leaf_count(_orders(spark, sf_dir))


# --- relational and bitmap operators ---------------------------------------------------------------


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query("dictionary_by_value", "SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def dictionary_by_value(spark, sf_dir):
    return relational.dictionary(_read(spark, sf_dir, "part"), "p_brand")


@_query("dictionary_by_frequency", "SELECT p_brand AS value, row_number() OVER (ORDER BY k, p_brand) - 1 AS code FROM (SELECT p_brand, count(*) AS k FROM part GROUP BY p_brand)")
def dictionary_by_frequency(spark, sf_dir):
    return relational.dictionary(_read(spark, sf_dir, "part"), "p_brand", by="frequency")


@_query("encoded_parts", "SELECT p_partkey, code AS p_brand FROM part JOIN (SELECT p_brand AS v, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) ON v = p_brand")
def encoded_parts(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return relational.encode(parts, "p_brand", relational.dictionary(parts, "p_brand"))


@_query("decoded_parts", "SELECT p_partkey, p_brand FROM part")
def decoded_parts(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    codes = relational.dictionary(parts, "p_brand", by="frequency")
    return relational.decode(relational.encode(parts, "p_brand", codes), "p_brand", codes)


@_query("multiway_join", _sql("SELECT a, b, c FROM t", _TRIANGLES))
def multiway_join(spark, sf_dir):
    """Triangles as the natural join of three renamings of the edges."""
    e = written(order_graph(spark, sf_dir).edges, "edges")
    ends = e.groupBy(F.col("dst").alias("b")).agg(F.count("*").alias("i")).join(e.groupBy(F.col("src").alias("b")).agg(F.count("*").alias("o")), "b")
    edges, paths = e.count(), ends.agg(F.sum(F.col("i") * F.col("o"))).first()[0]
    turns = turns_for(paths, max(counting.LEAST_TRAVEL, 2 * counting.TRAVEL * edges))
    return relational.multiway_join([e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("a", "c")], turns=turns).select("a", "b", "c")


@_query("hypercube_triangles", _sql("SELECT a, b, c FROM t", _TRIANGLES))
def hypercube_triangles(spark, sf_dir):
    e = written(order_graph(spark, sf_dir).edges, "edges")
    return multiway.hypercube_join([e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("a", "c")]).select("a", "b", "c")


@_query("hypercube_cycles", """WITH b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
w AS (SELECT x.c AS c1, y.c AS c2, x.p FROM b x JOIN b y ON x.p = y.p AND x.c < y.c)
SELECT v.c1, v.c2, v.p AS p1, w.p AS p2 FROM w v JOIN w ON v.c1 = w.c1 AND v.c2 = w.c2 AND v.p < w.p""")
def hypercube_cycles(spark, sf_dir):
    """Two customers and two parts that both have ordered: the cycles of four of customers and parts."""
    bought = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    bought = written(bought, "bought")
    sides = [bought.toDF(c, p) for c, p in (("c1", "p1"), ("c1", "p2"), ("c2", "p1"), ("c2", "p2"))]
    return multiway.hypercube_join(sides, less=[("c1", "c2"), ("p1", "p2")]).select("c1", "c2", "p1", "p2")


@_query("hypercube_local_lines", """SELECT DISTINCT o_orderkey AS o, o_custkey AS c, l_partkey AS p, s_suppkey AS s, c_nationkey AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""")
def hypercube_local_lines(spark, sf_dir):
    """Lines whose customer and supplier are of one nation: four tables in a circle, five attributes."""
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))
    suppliers = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    return multiway.hypercube_join([lines, orders, customers, suppliers]).select("o", "c", "p", "s", "n")


def _sales(spark, sf_dir):
    """Lines by order (value: quantity), orders (cents), customers, nations and regions (1)."""
    one = F.lit(1).cast("long").alias("value")
    return [
        _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("long").alias("value")),
        _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value")),
        _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), one),
        _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"), one),
        _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("region"), one),
    ]


_SALES = "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


@_query("eliminated_sales", f"SELECT r_name AS region, sum(round(o_totalprice * 100)::BIGINT * l_quantity::BIGINT)::BIGINT AS value {_SALES} GROUP BY r_name")
def eliminated_sales(spark, sf_dir):
    """Of each region the orders' cents times the pieces of their lines, over five tables."""
    return semiring.aggregate_join(_sales(spark, sf_dir), ["region"])


@_query("eliminated_dearest", f"SELECT r_name AS region, l_suppkey AS s, max(round(o_totalprice * 100)::BIGINT + l_quantity::BIGINT + 3)::BIGINT AS value {_SALES} GROUP BY r_name, l_suppkey")
def eliminated_dearest(spark, sf_dir):
    """The largest sum of annotations by region and supplier: the same query in another semiring, with two columns that are far apart."""
    return semiring.aggregate_join(_sales(spark, sf_dir), ["region", "s"], plus="max", times="sum")


@_query("eliminated_local_sales", f"SELECT r_name AS region, sum(round(o_totalprice * 100)::BIGINT * l_quantity::BIGINT)::BIGINT AS value {_SALES} JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey GROUP BY r_name")
def eliminated_local_sales(spark, sf_dir):
    """Where customer and supplier are of one nation: six tables with a cycle."""
    suppliers = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"), F.lit(1).cast("long").alias("value"))
    return semiring.aggregate_join([*_sales(spark, sf_dir), suppliers], ["region"])


@_query("eliminated_triangles", _sql("SELECT id, count(*) AS value FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id", _TRIANGLES))
def eliminated_triangles(spark, sf_dir):
    """Triangles at each part: every one has six walks around it, two from each of its corners."""
    edges = _orders(spark, sf_dir)
    both = written(edges.symmetric().withColumn("value", F.lit(1).cast("long")), "both")
    walks = semiring.aggregate_join([both.toDF("id", "y", "value"), both.toDF("y", "z", "value"), both.toDF("z", "id", "value")], ["id"])
    return walks.select("id", (F.col("value") / 2).cast("long").alias("value"))


@_query("annotated_join", "SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT * l_quantity::BIGINT)::BIGINT AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def annotated_join(spark, sf_dir):
    """Of each customer the orders' prices in cents times the pieces of their lines, added up."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("value"))
    return relational.annotated_join(orders, lines, ["o_orderkey"], ["o_custkey"])


@_query("annotated_join_cheapest", "SELECT o_custkey, min(o_totalprice + l_tax) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def annotated_join_cheapest(spark, sf_dir):
    """The same join in another semiring: sums, and their minimum."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_tax").alias("value"))
    return relational.annotated_join(orders, lines, ["o_orderkey"], ["o_custkey"], plus="min", times="sum")


@_query("select_equal", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def select_equal(spark, sf_dir):
    return relational.select_equal(_read(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_custkey")


_FLAGGED = "SELECT l_partkey AS id, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = '{}'"


def _flag_parts(spark, sf_dir, flag):
    """Parts and the suppliers they came from, by return flag."""
    return _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("supplier"))


for _name, _op, _word in (("set_intersect", relational.set_intersect, "INTERSECT"), ("set_union", relational.set_union, "UNION"), ("set_difference", relational.set_difference, "EXCEPT")):
    _query(_name, f"{_FLAGGED.format('R')} {_word} {_FLAGGED.format('A')}")(
        lambda spark, sf_dir, op=_op: op(*(_flag_parts(spark, sf_dir, f) for f in "RA"))
    )


@_query("insert_absent", f"{_FLAGGED.format('R')} UNION {_FLAGGED.format('A')}")
def insert_absent(spark, sf_dir):
    return relational.insert_absent(_flag_parts(spark, sf_dir, "R").distinct(), _flag_parts(spark, sf_dir, "A"), ["id", "supplier"])


@_query("array_sets", _sql("""SELECT e.src, e.dst, cn::INTEGER AS common, (x.deg + y.deg - cn)::INTEGER AS either, (x.deg - cn)::INTEGER AS only_src FROM n JOIN e USING (src, dst) JOIN d x ON x.id = e.src JOIN d y ON y.id = e.dst"""))
def array_sets(spark, sf_dir):
    graph = _orders(spark, sf_dir)
    ops = relational.array_sets(F.col("a"), F.col("b"))
    sets = lambda met: met.select("src", "dst", ops["intersection_count"].alias("common"), F.size(ops["union"]).alias("either"), F.size(ops["difference"]).alias("only_src"))
    return counting.meeting_lists(graph.edges, graph.symmetric(), sets)


_BITS = "a AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS value FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS value FROM lineitem WHERE l_returnflag = 'A')"


def _bitmaps(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    return [bitmap.pack(lines.where(F.col("l_returnflag") == f), "l_suppkey", "l_partkey") for f in "RA"]


for _op, _sql_op in (("and", "SELECT * FROM a INTERSECT SELECT * FROM b"), ("or", "SELECT * FROM a UNION SELECT * FROM b"), ("andnot", "SELECT * FROM a EXCEPT SELECT * FROM b"), ("xor", "(SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)")):
    _query(f"bitmap_{_op}", f"WITH {_BITS} {_sql_op}")(lambda spark, sf_dir, op=_op: bitmap.unpack(bitmap.combine(*_bitmaps(spark, sf_dir), op)))


@_query("bitmap_cardinality", f"WITH {_BITS} SELECT key, count(*) AS count FROM a GROUP BY key")
def bitmap_cardinality(spark, sf_dir):
    return bitmap.cardinality(_bitmaps(spark, sf_dir)[0])


_SIZE = "(SELECT max(l_partkey) + 1 FROM lineitem)"


def _bits(spark, sf_dir) -> int:
    """One more than the largest part that a line holds."""
    return (_read(spark, sf_dir, "lineitem").agg(F.max("l_partkey")).first()[0] or -1) + 1


@_query("bitmap_complement", f"WITH {_BITS} SELECT k.key, v.value FROM (SELECT DISTINCT key FROM a) k CROSS JOIN (SELECT unnest(range(0, {_SIZE})) AS value) v WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.key = k.key AND a.value = v.value)")
def bitmap_complement(spark, sf_dir):
    """Within the parts up to the largest that a line holds."""
    return bitmap.unpack(bitmap.complement(_bitmaps(spark, sf_dir)[0], _bits(spark, sf_dir)))


@_query("bitmap_equal", f"WITH {_BITS} SELECT key, bool_and(n = 2) AS equal FROM (SELECT key, value, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT key, value FROM b) GROUP BY key, value) GROUP BY key")
def bitmap_equal(spark, sf_dir):
    return bitmap.equal(*_bitmaps(spark, sf_dir))


@_query("bitmap_append", f"WITH {_BITS} SELECT key, value FROM a UNION ALL SELECT key, value + {_SIZE} FROM b")
def bitmap_append(spark, sf_dir):
    return bitmap.unpack(bitmap.append(*_bitmaps(spark, sf_dir), _bits(spark, sf_dir)))


_WORDS = f"""wd AS (SELECT key, value // 64 AS block, count(*) < least(64, {_SIZE} - (value // 64) * 64) AS dirty FROM a GROUP BY key, value // 64, least(64, {_SIZE} - (value // 64) * 64)),
ru AS (SELECT *, dirty AND coalesce(lag(block) OVER (PARTITION BY key, dirty ORDER BY block) < block - 1, true) AS starts FROM wd)"""


@_query("bitmap_statistics", f"WITH {_BITS}, {_WORDS} SELECT key, count(*) FILTER (dirty) AS dirty_words, ({_SIZE} + 63) // 64 - count(*) AS empty_words, count(*) FILTER (NOT dirty) AS full_words, count(*) FILTER (starts) AS runs FROM ru GROUP BY key")
def bitmap_statistics(spark, sf_dir):
    return bitmap.statistics(_bitmaps(spark, sf_dir)[0], _bits(spark, sf_dir))


@_query("bitmap_union_all", "SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_returnflag = 'R'")
def bitmap_union_all(spark, sf_dir):
    return bitmap.unpack(bitmap.union_all(_bitmaps(spark, sf_dir)[0]).withColumn("key", F.lit(0))).select("value")


@_query("bitmap_intersects", f"WITH {_BITS} SELECT DISTINCT a.key FROM a JOIN b USING (key, value)")
def bitmap_intersects(spark, sf_dir):
    return bitmap.intersects(*_bitmaps(spark, sf_dir))


@_query("bitmap_jaccard", f"WITH {_BITS} SELECT key, round(count(*) FILTER (k = 2) / count(*), 9) AS jaccard FROM (SELECT key, value, count(*) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY key, value) GROUP BY key")
def bitmap_jaccard(spark, sf_dir):
    return bitmap.jaccard(*_bitmaps(spark, sf_dir)).select("key", F.round("jaccard", 9).alias("jaccard"))


# --- the same bitmaps in run-length form --------------------------------------------------------------


def _runs(spark, sf_dir):
    return [runs.compress(b) for b in _bitmaps(spark, sf_dir)]


for _op in ("and", "or", "andnot", "xor"):
    _query(f"run_length_{_op}", ORACLE_SQL[f"bitmap_{_op}"])(lambda spark, sf_dir, op=_op: bitmap.unpack(runs.expand(runs.combine(*_runs(spark, sf_dir), op))))


@_query("run_length_complement", ORACLE_SQL["bitmap_complement"])
def run_length_complement(spark, sf_dir):
    return bitmap.unpack(runs.expand(runs.complement(_runs(spark, sf_dir)[0], _bits(spark, sf_dir))))


@_query("run_length_equal", ORACLE_SQL["bitmap_equal"])
def run_length_equal(spark, sf_dir):
    return runs.equal(*_runs(spark, sf_dir))


@_query("run_length_union_all", ORACLE_SQL["bitmap_union_all"])
def run_length_union_all(spark, sf_dir):
    either = runs.union_all(_runs(spark, sf_dir)[0]).withColumn("key", F.lit(0).cast("long"))
    return bitmap.unpack(runs.expand(either)).select("value")


@_query("run_length_sizes", f"""WITH {_BITS}, w AS (SELECT key, value // {runs.SEGMENT} AS segment, value // 64 % {runs.SEGMENT_WORDS} AS place, count(*) = 64 AS whole FROM a GROUP BY ALL),
p AS (SELECT *, lag(place) OVER o AS before, lag(whole) OVER o AS whole_before FROM w WINDOW o AS (PARTITION BY key, segment ORDER BY place))
SELECT key, count(DISTINCT segment) AS segments, count(*) FILTER (NOT whole) + count(*) FILTER (place > coalesce(before, -1) + 1) + count(*) FILTER (whole AND NOT (coalesce(whole_before, false) AND place = before + 1))
  + count(*) FILTER (place = 0 AND NOT whole) AS words FROM p GROUP BY key""")  # fmt: skip
def run_length_sizes(spark, sf_dir):
    """Literal words, a marker for each stretch of zeros or ones, and one before literals that come first."""
    return runs.sizes(_runs(spark, sf_dir)[0])


@_query("neighbour_blocks", _sql("SELECT src AS id, dst // 64 AS block, count(*) AS bits FROM s GROUP BY ALL"))
def neighbour_blocks(spark, sf_dir):
    masks = counting.neighbour_blocks(order_graph(spark, sf_dir).symmetric())
    return masks.select("id", "block", F.bit_count("mask").cast("long").alias("bits"))


@_query("top_degrees", _sql("SELECT id, deg FROM d ORDER BY deg DESC, id LIMIT 10"))
def top_degrees(spark, sf_dir):
    return _orders(spark, sf_dir).degrees().orderBy(F.desc("deg"), "id").limit(10)


@_query("asymmetric_rows", _sql("SELECT src, dst FROM e WHERE (src + dst) % 2 = 1"))
def asymmetric_rows(spark, sf_dir):
    """All edges one way, and those between ids that are both even or both odd the other way too."""
    from knotwork.operators.graph import asymmetric_rows as rows

    e = _orders(spark, sf_dir).edges
    return rows(e.unionByName(e.where("(src + dst) % 2 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@_query("neighbour_gaps", _sql("SELECT src, dst, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM s"))
def neighbour_gaps(spark, sf_dir):
    w = Window.partitionBy("src").orderBy("dst")
    return order_graph(spark, sf_dir).symmetric().select("src", "dst", (F.col("dst") - F.lag("dst").over(w)).alias("gap"))
