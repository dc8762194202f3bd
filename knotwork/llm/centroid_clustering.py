"""Centroid clustering (Lloyd's rounds) with partial-distance search, on whole numbers.

A round is one pass: each task assigns its vectors and sums them up by cluster, the tasks' sums meet by (cluster, component), and
``clusters`` times ``dim`` sums reach the driver, however many vectors there are. No vector is shuffled, so a cluster that holds most of them is no
hot key. Centroids travel with the tasks. The starting centroids are a top-k by hash, of which each task keeps ``clusters`` rows.

Nearest centroids by partial distance: the components are taken in order of falling variance over all vectors, a few at a time.
A vector meets the centroids in order of their distance over the first few components; squared differences add up
as integers, a centroid is abandoned as soon as they are strictly above the vector's current best, and only survivors run through all components. A
survivor at the best distance itself wins if its number is smaller, so the result is that of comparing everything.

Defined results: vectors that are null, hold null or non-finite components, or have not ``dim`` components take no part; null ids do, and are last in
the order of hashes; vectors with equal hashes (a repeated id) start in order of their components; fewer vectors than ``clusters`` make fewer
centroids; empty clusters keep their centroid; components beyond 2**62 count as that, and distances and inertias beyond 64 bits are clipped; an empty
table gives no rows; other input columns do not pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.whole_vectors import block_of, clipped, whole_vectors
from knotwork.plans.materialize import written

#: Components that are compared between two looks at the current best.
STEP = 8
#: Vectors of so small components have squared distances within 64 bits, for up to 2**9 components.
SMALL = 1 << 26
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x`` its nearest centroid (ties: smaller number), the squared distance, and how many squares were added up in all."""
    n, dim = x.shape
    x, c = x[:, order], centroids[:, order]
    first = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(axis=2)
    by_first = np.argsort(first, axis=1, kind="stable")
    rows = np.arange(n)
    cluster = by_first[:, 0].astype(np.int64)
    best = first[rows, cluster] + ((x[:, step:] - c[cluster, step:]) ** 2).sum(axis=1)
    looked = n * len(c) * min(step, dim) + n * max(dim - step, 0)
    for place in range(1, len(c)):
        # Candidates come by rising first part: a row whose next one is above its best has no further ones.
        rows = rows[first[rows, by_first[rows, place]] <= best[rows]]
        if not len(rows):
            break
        live, candidate = rows, by_first[rows, place]
        part = first[live, candidate]
        for at in range(step, dim, step):
            part = part + ((x[live, at : at + step] - c[candidate, at : at + step]) ** 2).sum(axis=1)
            looked += len(live) * min(step, dim - at)
            stay = part <= best[live]
            live, candidate, part = live[stay], candidate[stay], part[stay]
        wins = (part < best[live]) | (candidate < cluster[live])
        best[live[wins]], cluster[live[wins]] = part[wins], candidate[wins]
    return cluster, best, looked


def _spread(kept: DataFrame, dim: int) -> np.ndarray:
    """The components by falling variance (ties by number). Only the speed depends on it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = block_of(batch, dim).astype(float)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x**2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": list(range(dim)), "n": [n] * dim, "total": total, "squares": squares})

    found = kept.mapInArrow(sums, "at long, n long, total double, squares double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares"))).orderBy("at").collect()
    variance = [r["squares"] / max(r["n"], 1) - (r["total"] / max(r["n"], 1)) ** 2 for r in found]
    return np.argsort(-np.array(variance), kind="stable") if found else np.arange(dim)


def _fitting(centroids: list[list[int]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as int64 where no distance can overflow, as Python integers otherwise."""
    small = all(-SMALL < v < SMALL for c in centroids for v in c) and x.dtype == np.int64 and (not x.size or int(np.abs(x).max()) < SMALL)
    kind = np.int64 if small else object
    return x.astype(kind), np.array(centroids, dtype=kind)


def _moved(kept: DataFrame, centroids: list[list[int]], order: np.ndarray, dim: int) -> list[list[int]]:
    """One round: every non-empty centroid becomes the floor of its vectors' mean."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), dim), dtype=object), [0] * len(centroids)
        for batch in batches:
            x, c = _fitting(centroids, block_of(batch, dim, batch.num_rows))
            cluster, _, _ = nearest(x, c, order)
            for k in np.unique(cluster):
                mine = x[cluster == k]
                total[k] += mine.sum(axis=0).astype(object)
                count[k] += len(mine)
        full = [k for k in range(len(centroids)) if count[k]]
        if full:
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array([k for k in full for _ in range(dim)], pa.int32()), "at": pa.array(list(range(dim)) * len(full), pa.int32()),
                "n": pa.array([count[k] for k in full for _ in range(dim)], pa.int64()), "total": pa.array([Decimal(int(v)) for k in full for v in total[k]], pa.decimal128(38, 0)),
            })

    moved = [list(c) for c in centroids]
    for r in kept.mapInArrow(sums, "cluster int, at int, n long, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        moved[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
    return moved


def centroid_clusters(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)``, written once, and the final centroids.

    The first centroids are the vectors with the smallest SHA-256 of ``salt:vec_id``.
    """
    kept = whole_vectors(embeddings, id_col, vector_col, scale, dim)
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    centroids = [[int(x) for x in r["v"]] for r in hashed.orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    order = _spread(kept, dim)
    for _ in range(rounds):
        centroids = _moved(kept, centroids, order, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(*_fitting(centroids, block_of(batch, dim)), order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(clipped(distance))], ["vec_id", "cluster", "distance"])

    return written(kept.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned"), centroids


def cluster_report(embeddings: DataFrame, **parameters) -> DataFrame:
    """Each vector's cluster and distance, with the inertia of the cluster and of all, and a digest of the centroid."""
    assigned, centroids = centroid_clusters(embeddings, **parameters)
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    own = clipped([sums.get(k, 0) for k in range(len(centroids))]).tolist()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    whole = clipped([sum(sums.values())]).tolist()[0]
    return assigned.select("vec_id", "cluster", "distance", of_cluster(own).cast("long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of_cluster(digests).alias("centroid_sha256"))
