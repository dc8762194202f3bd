"""Exact top-k search by inner product with a cover tree over queries and data together.

One tree holds all vectors. Its upper levels are built over the cluster: a cell of more than ``block_rows`` rows gets pivots of its own, different
vectors of a bounded sample of it (``sample_rows``; the sample decides only where a cell is cut), every row of the cell goes to the
nearest one, and so on level by level until cells are blocks. A cell of equal vectors is cut by hash instead, and so is what is left after
``most_levels``. Pivots are not the farthest rows here: those are outliers, and cells would come out uneven. Below, each block grows its
part of the tree once, and it is stored with the block's rows. A node's centre is one of its rows; its children are centred so that they cover
it within half its radius, lie farther than that from each other, and the first has the parent's centre. Where halving would take more than a quarter
of a node's rows as children, the node is a leaf. Every node knows its covering radius, and the radius of its queries: the same
tree is walked on the query side by the nodes that hold queries.

For a node of queries and a node of data the inner product is at most
``q.p + |q| r_p + |p| r_q + r_q r_p`` (centres q, p; covering radii r). Where this is below the worst k-th score
that any query of the node has so far, no member pair can matter, and the pair of nodes is pruned. The
bound is used on pairs of cells (a table bounded by ``most_cells`` squared for each number of components), on pairs of blocks when they
meet, and down both blocks' trees together. First k-th scores come from each query's own block.

Blocks are numbered in tree order, so a run of consecutive ones is a part of near cells. Query parts meet data parts in tasks of bounded
size, and only where some pair of their cells is left; a crowded cell is as many tasks as it has blocks. What a task returns is at most k rows
a query.

Components are ``floor(scale * x)`` as integers, and scores are exact: float64 products where they cannot round,
Python integers otherwise (scores beyond 64 bits are clipped to the range).

Defined results: null vectors, and vectors with a null or non-finite component, or without components, take no part; a
null id takes no part; vectors are compared only with vectors of as many components; a query gets fewer than ``k`` rows
if there are fewer candidates, and none if it is alone; rows with the query's own id are no candidates; ties go to the
smaller id; a repeated row counts as a candidate as often as it is there, but asks once; different vectors with one query id all ask,
and the id gets the best of their answers together; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans.materialize import written
from knotwork.plans.ranking import ranked

EXACT = float(1 << 53)
LEAF = 24
FEW_QUERIES = 8
_BLOCK = "cell string, dim int, n_queries int, centre array<double>, reach double, q_reach double, worst double, data binary, queries binary"


def quantized(embeddings: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v array<double>)`` of whole numbers, for the vectors that take part."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    # Adding 0.0 turns -0.0 into 0.0; the product stays a double, so that huge components do not overflow.
    return rows.select("vec_id", F.transform("v", lambda x: F.expr("0.0D") + _floor(x * F.lit(float(scale)))).alias("v"))


def _floor(x: Column) -> Column:
    """Floor as a double (Spark's own gives a long)."""
    small = F.abs(x) < float(1 << 52)
    return F.when(small, F.floor(x).cast("double")).otherwise(x)


class Tree:
    """Nodes over a reordering of rows: each a range of it, a centre (a row's place in it), a covering radius and a parent."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.order = vectors, np.arange(len(vectors))
        self.begin: list[int] = []
        self.end: list[int] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.parent: list[int] = []
        if len(vectors):
            self._grow(0, len(vectors), int(self._away(self.order, vectors.mean(axis=0)).argmin()), -1)
            place = np.argsort(self.order)
            self.centre = place[self.centre].tolist()

    def _away(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.linalg.norm(self.vectors[rows] - point, axis=1)

    def _grow(self, begin: int, end: int, centre: int, parent: int) -> None:
        rows, at = self.order[begin:end].copy(), len(self.begin)
        near = self._away(rows, self.vectors[centre])
        radius = float(near.max())
        for values, value in zip((self.begin, self.end, self.centre, self.radius, self.parent), (begin, end, centre, radius, parent), strict=True):
            values.append(value)
        if len(rows) <= LEAF or not radius:
            return
        centres, owner = [centre], np.zeros(len(rows), dtype=np.int64)
        while near.max() > radius / 2:
            if 4 * len(centres) >= len(rows):
                return
            centres.append(int(rows[near.argmax()]))
            away = self._away(rows, self.vectors[centres[-1]])
            owner[away < near] = len(centres) - 1
            near = np.minimum(near, away)
        self.order[begin:end] = rows[np.argsort(owner, kind="stable")]
        for own, size in zip(centres, np.bincount(owner, minlength=len(centres)).tolist(), strict=True):
            self._grow(begin, begin + size, own, at)
            begin += size


class Side:
    """A block's tree as one side of a search sees it: nodes (in an order that puts parents first), their centres, radii and ids."""

    def __init__(self, dim: int, nodes: np.ndarray, radius: np.ndarray, centres: np.ndarray, ids: np.ndarray, vectors: np.ndarray, kth: np.ndarray):
        self.dim, self.nodes, self.radius, self.centres, self.ids, self.vectors, self.kth = dim, nodes, radius, centres, ids, vectors, kth
        self.norm = np.linalg.norm(centres, axis=1)
        self.begin, self.end = nodes[:, 0].tolist(), nodes[:, 1].tolist()
        self.children: list[list[int]] = [[] for _ in nodes]
        for i, parent in enumerate(nodes[:, 2].tolist()):
            if parent >= 0:
                self.children[parent].append(i)

    def packed(self) -> bytes:
        """As bytes; centres of a data side are among its vectors and are not repeated."""
        parts = [np.array([self.dim, len(self.nodes), len(self.ids), len(self.kth)], dtype=np.int64).tobytes(), self.nodes.astype(np.int32).tobytes(), self.radius.tobytes(), self.ids.tobytes(), self.kth.tobytes()]
        return b"".join([*parts, _packed(np.concatenate((self.vectors, self.centres)))])

    @staticmethod
    def unpacked(raw: bytes) -> Side:
        dim, n_nodes, n, n_kth = np.frombuffer(raw, dtype=np.int64, count=4).tolist()
        at, parts = 32, []
        for kind, count in ((np.int32, 3 * n_nodes), (np.float64, n_nodes), (np.int64, n), (np.int64, 2 * n_kth)):
            parts.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
            at += parts[-1].nbytes
        both = _matrix(raw[at:], dim)
        return Side(dim, parts[0].reshape(-1, 3), parts[1], both[n:], parts[2], both[:n], parts[3].reshape(-1, 2))


def data_side(tree: Tree, ids: np.ndarray) -> Side:
    vectors = tree.vectors[tree.order]
    return Side(vectors.shape[1], np.stack((tree.begin, tree.end, tree.parent), axis=1), np.array(tree.radius), vectors[tree.centre], ids[tree.order], vectors, np.empty((0, 2), np.int64))


def query_side(tree: Tree, ids: np.ndarray, asks: np.ndarray) -> Side:
    """The nodes with queries, down to those with few, and the queries in the tree's order."""
    vectors, own = tree.vectors[tree.order], asks[tree.order]
    before = np.concatenate(([0], np.cumsum(own)))
    begin, end = before[tree.begin], before[tree.end]
    keep, number = [], {-1: -1}
    for i, parent in enumerate(tree.parent):
        if begin[i] < end[i] and parent in number and (parent < 0 or end[parent] - begin[parent] > FEW_QUERIES):
            number[i] = len(keep)
            keep.append(i)
    own_vectors, centres = vectors[own], vectors[np.array(tree.centre)[keep]]
    radius = np.array([np.linalg.norm(own_vectors[begin[i] : end[i]] - c, axis=1).max() for i, c in zip(keep, centres, strict=True)])
    nodes = np.array([(begin[i], end[i], number[tree.parent[i]]) for i in keep]).reshape(-1, 3)
    return Side(vectors.shape[1], nodes, radius, centres, ids[tree.order][own], own_vectors, np.empty((0, 2), np.int64))


def exact_scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products (int64)."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if most < EXACT:
        return (queries @ data.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(whole(queries) @ whole(data).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; ``kth`` (score, id) rows known beforehand bound what is taken, where they are given."""

    def __init__(self, ids: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.ids, self.k, self.compared = ids, k, 0
        known = kth is not None and len(kth) == len(ids)
        self.worst = kth[:, 0].astype(np.float64) if known else np.full(len(ids), -np.inf)
        self.worst[self.worst == float(-(1 << 63))] = -np.inf
        self._kept = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.compared += scores.size
        enough = (scores >= self.worst[rows][:, None]) & (ids[None, :] != self.ids[rows][:, None])
        for i in np.flatnonzero(enough.any(axis=1)):
            q, take = rows[i], enough[i]
            score = np.concatenate((self._kept[q][0], scores[i][take]))
            found = np.concatenate((self._kept[q][1], ids[take]))
            if len(score) > self.k:
                top = np.lexsort((found, ~score))[: self.k]
                score, found = score[top], found[top]
            self._kept[q] = (score, found)
            if len(score) >= self.k:
                self.worst[q] = max(self.worst[q], float(score.min()))

    def kth(self) -> np.ndarray:
        """(score, id) of each query's k-th best; the least score there is where there are fewer."""
        none = (-(1 << 63), (1 << 63) - 1)
        return np.array([(s[at], i[at]) if len(s) >= self.k and (at := np.lexsort((i, ~s))[self.k - 1]) is not None else none for s, i in self._kept], dtype=np.int64).reshape(-1, 2)

    def rows(self, kth: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """What is kept, but for what comes behind the k-th best known beforehand."""
        for q, (scores, ids), (least, last) in zip(self.ids.tolist(), self._kept, kth.tolist(), strict=True):
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if s > least or i <= last:
                    yield q, i, s


def bounds(q: Side, q_nodes: slice, centres: np.ndarray, norm: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that an inner product of members can be, by query node and data node, with room for rounding."""
    own, r = q.centres[q_nodes], q.radius[q_nodes][:, None]
    most = own @ centres.T + q.norm[q_nodes][:, None] * radius + r * norm + r * radius
    return most + 1e-9 * np.abs(most) + 1e-6


def dual_search(q: Side, best: Best, d: Side) -> None:
    """Offer to ``best`` all pairs of the two trees that the bound does not prune."""
    if not len(q.ids) or not len(d.ids):
        return
    bound = bounds(q, slice(None), d.centres, d.norm, d.radius)
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        rows = slice(q.begin[x], q.end[x])
        if bound[x, y] < best.worst[rows].min():
            continue
        size = (q.end[x] - q.begin[x]) * (d.end[y] - d.begin[y])
        if size > 1024 and d.children[y] and (not q.children[x] or d.radius[y] >= q.radius[x]):
            stack += [(x, c) for c in sorted(d.children[y], key=lambda c: bound[x, c])]
        elif size > 1024 and q.children[x]:
            stack += [(c, y) for c in q.children[x]]
        else:
            data = slice(d.begin[y], d.end[y])
            best.offer(np.arange(rows.start, rows.stop), exact_scores(q.vectors[rows], d.vectors[data]), d.ids[data])


_KINDS = {b"b": np.int8, b"h": np.int16, b"i": np.int32, b"d": np.float64}


def _packed(vectors: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, after a byte that names it; others as doubles."""
    whole = (vectors == np.rint(vectors)).all()
    most = np.abs(vectors).max(initial=0)
    kind = next((k for k, t in _KINDS.items() if t is not np.float64 and whole and most <= np.iinfo(t).max), b"d")
    return kind + np.ascontiguousarray(vectors, dtype=_KINDS[kind]).tobytes()


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=_KINDS[raw[:1]], offset=1).reshape(-1, dim).astype(np.float64)


def _rows(column: pa.Array) -> np.ndarray:
    """A matrix of vectors of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _choose(block_rows: int, fan: int):
    """A cell's pivots from its sample: about two for each block that its ``n`` rows make."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", kind="stable")
        sample = np.array(group["v"].tolist(), dtype=np.float64)
        first = np.sort(np.unique(sample, axis=0, return_index=True)[1])  # the sample is in order of a hash
        pivots = sample[first[: int(min(fan, max(2, -(-2 * int(group["n"].iloc[0]) // block_rows))))]]
        return pd.DataFrame([(group["cell"].iloc[0], int(group["n"].iloc[0]), pivots.reshape(-1).tolist(), len(pivots))], columns=["cell", "n", "pivots", "k"])

    return choose


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, part), each led by the cell's pivots: the cells below, by the nearest pivot."""
    pivots = None
    for batch in batches:
        cells, at = [], 0
        for cell, same in groupby(zip(batch.column(0).to_pylist(), batch.column(2).is_null().to_pylist(), strict=True)):
            n = sum(1 for _ in same)
            vectors = _rows(batch.column(3).slice(at, n))
            at += n
            if cell[1]:  # the pivots, as one row of all of them laid end to end, for each repeat
                pivots = vectors[0].reshape(batch.column(4)[at - 1].as_py(), -1)
                cells += [None] * n
            else:
                near = (-2 * vectors @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
                cells += [f"{cell[0]}/{i:03d}" for i in near.tolist()]
        keep = pa.array([c is not None for c in cells])
        out = pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), batch.column(2), batch.column(3)], names=["cell", "vec_id", "v"])
        yield out.filter(keep)


def tree_cells(rows: DataFrame, block_rows: int, sample_rows: int, fan: int, most_levels: int, part_rows: int = 1 << 16) -> DataFrame:
    """``(cell, vec_id, v)``: the cells of about ``block_rows`` rows at most, as paths from the root of each number of components."""
    done, left = [], written(rows.select(F.concat(F.lit("d"), F.lpad(F.size("v").cast("string"), 8, "0")).alias("cell"), "vec_id", "v"), "cells")
    for level in range(most_levels):
        big = written(left.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block_rows), "big-cells")
        done.append(left.join(big, "cell", "left_anti"))
        if big.isEmpty():
            return _union(done)
        inside = left.join(big, "cell")
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("vec_id", "v", F.lit(level)), "vec_id"))
        sample = inside.withColumn("place", place).where(F.col("place") <= sample_rows)
        pivots = written(sample.groupBy("cell").applyInPandas(_choose(block_rows, fan), "cell string, n long, pivots array<double>, k int"), "pivots")
        alike = pivots.where("k = 1").select("cell", F.ceil(F.col("n") / block_rows).alias("cuts"))
        cut = left.join(alike, "cell").select(F.concat("cell", F.lit("/="), F.lpad(F.pmod(F.xxhash64("vec_id", "v", F.lit(level)), "cuts").cast("string"), 9, "0")).alias("cell"), "vec_id", "v")
        split = pivots.where("k > 1").withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
        leads = split.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("vec_id"), F.col("pivots").alias("v"), "k")
        members = left.join(split.select("cell", "parts"), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", "v", F.lit(None).cast("int").alias("k"))
        below = leads.unionByName(members).repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("vec_id").asc_nulls_first()).mapInArrow(_assign, "cell string, vec_id long, v array<double>")
        left = written(below.unionByName(cut), "cells")
    # What is left after so many levels is cut by hash.
    sizes = left.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("cuts"))
    done.append(left.join(sizes, "cell").select(F.concat("cell", F.lit("/="), F.lpad(F.pmod(F.xxhash64("vec_id", "v"), "cuts").cast("string"), 9, "0")).alias("cell"), "vec_id", "v"))
    return _union(done)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _build_block(k: int, every: int):
    """One row a block: its tree as data and as queries, its reach, and its queries' k-th scores in it."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        ids, vectors = group["vec_id"].to_numpy(np.int64), np.array(group["v"].tolist(), dtype=np.float64)
        asks = ids % every == 0
        same = np.unique(np.concatenate((ids[:, None].astype(np.float64), vectors), axis=1), axis=0, return_index=True)[1] if asks.any() else np.arange(0)
        first = np.zeros(len(ids), dtype=bool)
        first[same] = True
        tree = Tree(vectors)
        data, queries = data_side(tree, ids), query_side(tree, ids, asks & first)
        best = Best(queries.ids, k)
        dual_search(queries, best, data)
        queries.kth = best.kth()
        reach = queries.radius[0] if len(queries.radius) else 0.0
        row = (group["cell"].iloc[0], data.dim, len(queries.ids), data.centres[0].tolist(), float(data.radius[0]), float(reach), float(best.worst.min(initial=np.inf)), data.packed(), queries.packed())
        return pd.DataFrame([row], columns=["cell", "dim", "n_queries", "centre", "reach", "q_reach", "worst", "data", "queries"])

    return build


def _search(k: int):
    def search(key, asking: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(asking) and len(data):
            by_dim: dict[int, list[tuple[str, Side]]] = {}
            for cell, raw in zip(data["cell"], data["data"], strict=True):
                side = Side.unpacked(raw)
                by_dim.setdefault(side.dim, []).append((cell, side))
            for cell, raw in zip(asking["cell"], asking["queries"], strict=True):
                q = Side.unpacked(raw)
                sides = by_dim.get(q.dim, [])
                if not sides:
                    continue
                best = Best(q.ids, k, q.kth)
                roots, radius = np.array([d.centres[0] for _, d in sides]), np.array([d.radius[0] for _, d in sides])
                most = bounds(q, slice(0, 1), roots, np.linalg.norm(roots, axis=1), radius)[0]
                near = roots @ q.centres[0]
                for i in sorted(range(len(sides)), key=lambda i: (sides[i][0] != cell, -near[i])):
                    if most[i] >= best.worst.min():
                        dual_search(q, best, sides[i][1])
                found += best.rows(q.kth)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64,
    fan: int = 64, sample_rows: int = 512, block_rows: int = 512, data_blocks: int = 64, query_blocks: int = 640, most_cells: int = 1_024, most_levels: int = 8,
) -> DataFrame:
    """Per query (ids divisible by ``every``): query_id, rank (from 1), vec_id, score.

    A task meets at most about ``data_blocks`` data blocks with the queries of ``query_blocks`` blocks; small tables are
    dealt to as many tasks as there are shuffle partitions.
    """
    spark = embeddings.sparkSession
    cells = tree_cells(quantized(embeddings, id_col, vector_col, scale), block_rows, sample_rows, fan, most_levels)
    blocks = written(cells.groupBy("cell").applyInPandas(_build_block(k, every), _BLOCK), "blocks")

    narrow = ranked(blocks.select("cell", "dim", "n_queries", "centre", "reach", "q_reach", "worst"), "cell", into="place")
    narrow = written(_with_top(narrow, most_cells, most_levels), "places")
    known = narrow.agg(F.count("*").alias("n"), F.count_if(F.col("n_queries") > 0).alias("q")).first()
    least_parts = min(known["n"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    data_run = max(1, min(data_blocks, -(-known["n"] // max(1, least_parts))))
    narrow = narrow.withColumns({"d_part": F.floor(F.col("place") / data_run), "q_part": F.floor(F.col("place") / query_blocks)})
    pairs = _cell_pairs(narrow)
    q_side = narrow.where("n_queries > 0").select("dim", F.col("top").alias("q_top"), "q_part").distinct()
    d_side = narrow.select("dim", F.col("top").alias("d_top"), "d_part").distinct()
    meet = written(q_side.join(pairs, ["dim", "q_top"]).join(d_side, ["dim", "d_top"]), "meet")
    task = ["q_part", "d_part"]
    asking = narrow.where("n_queries > 0").select("cell", "dim", F.col("top").alias("q_top"), "q_part").join(meet.select("dim", "q_top", *task).distinct(), ["dim", "q_top", "q_part"])
    data = narrow.select("cell", "dim", F.col("top").alias("d_top"), "d_part").join(meet.select("dim", "d_top", *task).distinct(), ["dim", "d_top", "d_part"])
    asking = asking.select("cell", *task).join(blocks.select("cell", "queries"), "cell")
    data = data.select("cell", *task).join(blocks.select("cell", "data"), "cell")
    meeting = asking.toDF(*asking.columns).groupBy(*task).cogroup(data.toDF(*data.columns).groupBy(*task))
    found = meeting.applyInPandas(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_top(blocks: DataFrame, most_cells: int, most_levels: int) -> DataFrame:
    """``blocks`` with ``top``, their cell at the lowest level that has at most ``most_cells`` of them for each number of components."""
    at = lambda depth: F.substring_index("cell", "/", depth)
    depth = 1
    while depth <= most_levels:
        most = blocks.groupBy("dim").agg(F.count_distinct(at(depth + 1)).alias("n"), F.count_distinct("cell").alias("every")).agg(F.max("n").alias("n"), F.max(F.col("n") >= F.col("every")).alias("last")).first()
        if not most["n"] or most["n"] > most_cells:
            break
        depth += 1
        if most["last"]:
            break
    return blocks.withColumn("top", at(depth))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _cell_pairs(blocks: DataFrame) -> DataFrame:
    """``(dim, q_top, d_top)`` that the bound does not prune. A cell is centred on its first block and covers the balls of all of them."""
    firsts = blocks.groupBy("dim", "top").agg(F.min_by("centre", "cell").alias("middle"))
    away = lambda r: F.max(F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)) + F.col(r))
    asks = F.col("n_queries") > 0
    cells = blocks.join(firsts, ["dim", "top"]).groupBy("dim", "top").agg(
        F.first("middle").alias("c"), away("reach").alias("r"), F.max(asks).alias("asks"), F.min(F.when(asks, F.col("worst"))).alias("worst"),
    )
    cells = written(cells.withColumn("norm", F.sqrt(_dot(F.col("c"), F.col("c")))), "tops")
    q = cells.where("asks").select("dim", F.col("top").alias("q_top"), F.col("c").alias("q_c"), F.col("r").alias("q_r"), F.col("norm").alias("q_norm"), "worst")
    d = cells.select("dim", F.col("top").alias("d_top"), F.col("c").alias("d_c"), F.col("r").alias("d_r"), F.col("norm").alias("d_norm"))
    most = _dot(F.col("q_c"), F.col("d_c")) + F.col("q_norm") * F.col("d_r") + F.col("q_r") * F.col("d_norm") + F.col("q_r") * F.col("d_r")
    return q.join(d, "dim").where(most + F.abs(most) * 1e-9 + 1e-6 >= F.col("worst")).select("dim", "q_top", "d_top")
