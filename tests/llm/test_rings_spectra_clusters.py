"""Sharding, whitening and centroid clustering against plain versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import centroid_clustering, queries, ring_shards, whitening

NAN, INF = float("nan"), float("inf")


def bag(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def vectors(spark, rows):
    """With columns named like results."""
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, component string")


# --- 11 --------------------------------------------------------------------------------------------


def plain_shards(rows, shards, virtual, arcs):
    """Rows one after another, each walking the ring's nodes clockwise from its own arc."""
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    nodes = sorted((place(f"{s}:{v}"), s) for s in range(shards) for v in range(virtual))
    keyed = []
    for i, text in rows:
        data = (text or "").encode()
        key = (i is not None, i or 0, len(data) + 16, zlib.crc32(data))
        keyed.append((place(f"{'-' if i is None else i}:{len(data) + 16}:{zlib.crc32(data)}"), key, i))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    load, out = [0] * shards, []
    for at, key, i in sorted(keyed, key=lambda k: (place(f"arc:{k[0] * arcs >> 60}"), k[0], k[1])):
        start = next((n for n, (p, _) in enumerate(nodes) if p * arcs >> 60 >= at * arcs >> 60), 0)
        walk = [s for _, s in nodes[start:] + nodes[:start]]
        shard = next(s for s in [*walk, *range(shards)] if load[s] < room[s])
        out.append((i, key[2], key[3], shard, load[shard], walk[0]))
        load[shard] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize(("shards", "virtual", "arcs"), [(40, 64, 1 << 12), (7, 3, 16), (5, 1, 1)])
def test_ring_shards(spark, small, shards, virtual, arcs):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    found = bag(ring_shards.ring_shards(docs, shards, virtual, arcs), "doc_id", "size", "text_crc32", "shard", "slot", "home")
    assert found == plain_shards([tuple(r) for r in docs.collect()], shards, virtual, arcs)


def awkward_docs(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None), (2, ""), (None, "x"), (None, None), (3, "long " * 9_000), (4, "é漢")] + [(9, "same")] * 9_000 + [(i, "copy") for i in range(10, 200)]
    return spark.createDataFrame([(*r, "s", 5, None) for r in rows], "doc_id long, text string, shard string, size int, copies string"), rows


def test_ring_shards_awkward(spark):
    docs, rows = awkward_docs(spark)
    out = ring_shards.ring_shards(docs, 7, 4, 64)
    # Repeated rows may swap their places with each other only.
    assert bag(out, "doc_id", "size", "text_crc32", "shard", "slot", "home") == plain_shards(rows, 7, 4, 64)
    for few in (docs.limit(0), docs.where("doc_id = 1")):
        slots = bag(ring_shards.ring_shards(few, 7, 4, 64), "shard", "slot")
        assert slots == [(s, 0) for s in range(few.count())]


def test_ring_shards_contract(spark, small):
    found = queries.QUERIES["op11_ring_shards"](spark, small).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({len(s) for s in slots.values()}) <= 2 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_ring_moves_little(spark):
    docs = spark.range(8_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before, after = ({r["doc_id"]: (r["shard"], r["home"]) for r in ring_shards.ring_shards(docs, n).collect()} for n in (40, 41))
    homes = [i for i in before if before[i][1] != after[i][1]]
    assert all(after[i][1] == 40 for i in homes) and len(homes) < 3 * 8_000 / 41
    moved = sum(before[i][0] != after[i][0] for i in before)
    assert moved < 0.35 * 8_000  # an order by count would move nearly all
    slack = Counter(r["shard"] for r in ring_shards.ring_shards(docs, 40, slack=0.25).collect())
    assert max(slack.values()) <= 250


# --- 12 --------------------------------------------------------------------------------------------


def plain_whitening(rows, components=16, scale=64, shift=1_000_000):
    kept = [(i, [math.floor(scale * c) + shift for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], dtype=float) / n
    cov = centred.T @ centred / n
    values, turns = np.linalg.eigh(cov)
    values, turns = values[::-1], turns[:, ::-1]
    out = {}
    for i, x in kept:
        c = [n * a - s for a, s in zip(x, sums, strict=True)]
        for k in range(min(components, len(values))):
            if values[k] > 1e-12 * values[0]:
                out[i, k + 1] = (n, sum(a * a for a in c), abs(float(np.array(c, dtype=float) / n @ turns[:, k])) / math.sqrt(values[k]), values[k] / np.trace(cov))
    return out


def check_whitening(df, rows, **parameters):
    expected = plain_whitening(rows, **parameters)
    found = df.collect()
    assert {(r["vec_id"], r["component"]) for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        n, deviation, white, share = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - white) < 1e-8 * max(1, white) and abs(r["explained"] / share - 1) < 1e-9 and r["identity_error"] < 1e-8
    return found


def test_whitening(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    found = check_whitening(queries.QUERIES["op12_whitening"](spark, small), [(r["vec_id"], r["embedding"]) for r in df.collect()])
    signs = np.array([[r["vec_id"], r["component"], r["whitened"]] for r in found])
    for k in range(1, 17):  # one sign for all rows: whitened columns have mean 0, and are not all on one side
        mine = signs[signs[:, 1] == k][:, 2]
        assert abs(mine.mean()) < 1e-8 and (mine > 0).any() and (mine < 0).any()


def test_whitening_awkward(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 0]).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(200, None), (201, []), (202, [None] * 5), (203, [NAN] * 5), (204, [INF, 0.0, 0.0, 0.0, 0.0]), (None, [0.5] * 5), (205, [-0.0, 0.0, 0.0, -0.0, 0.0])]
    check_whitening(whitening.whiten(vectors(spark, rows)), rows)
    other = [(300 + i, [float(i % 7), float(i * i)]) for i in range(20)]
    mixed = whitening.whiten(vectors(spark, rows + other))
    check_whitening(mixed.where("vec_id >= 300"), other)
    check_whitening(mixed.where("vec_id < 300 or vec_id is null"), rows)
    huge = [(i, [(-1.0) ** i * 1e10 * i, float(i % 5) * 1e10]) for i in range(20)]
    assert {r["n"] for r in whitening.whiten(vectors(spark, huge)).collect()} == {20}
    assert whitening.whiten(vectors(spark, [(1, [1e300, 2.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).count() == 3
    for none in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        assert whitening.whiten(vectors(spark, none)).count() == 0


@pytest.mark.parametrize(("dim", "block", "most_basis"), [(6, 16, 256), (90, 4, 24), (90, 16, 48), (200, 8, 64)])
def test_block_lanczos(dim, block, most_basis):
    rng = np.random.default_rng(dim)
    turn, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    values = np.sort(np.concatenate([[50.0, 50.0, 20.0], rng.uniform(0, 10, size=dim - 3)]))[::-1]  # a double one on top
    matrix = turn * values @ turn.T
    found = whitening.block_lanczos(lambda q: matrix @ q, dim, 6, block, most_basis)
    assert np.allclose(found.values, values[:6], rtol=1e-10) and found.residual <= 1e-12
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(6), atol=1e-10) and np.allclose(matrix @ found.vectors, found.vectors * found.values, atol=1e-8)


def test_block_lanczos_breakdown():
    """A matrix of rank 3: the Krylov space is exhausted at once, and fresh directions take over."""
    rng = np.random.default_rng(0)
    low = rng.normal(size=(40, 3))
    found = whitening.block_lanczos(lambda q: low @ (low.T @ q), 40, 5, block=4)
    assert np.allclose(found.values[:3], np.linalg.eigvalsh(low.T @ low)[::-1]) and np.allclose(found.values[3:], 0, atol=1e-9)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(5), atol=1e-9)


# --- 13 --------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dim, scale=64):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        for n, m in members.items():
            centroids[n] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    own = Counter()
    for _, d, n in found:
        own[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, own[n], sum(own.values()), digest[n]) for i, d, n in found), key=str)


CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize(("k", "rounds", "dim"), [(16, 3, 64), (3, 1, 64), (5, 0, 64)])
def test_clusters(spark, small, k, rounds, dim):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    found = bag(centroid_clustering.cluster_report(df, clusters=k, rounds=rounds, dim=dim), *CLUSTER_COLUMNS)
    assert found == plain_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()], k, rounds, dim)


def test_clusters_awkward(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, 0.25, 2.0]) for _ in range(3)]) for i in range(80)]  # many ties
    rows += [(7, [0.0, 0.0, 1.0]), (7, [-0.0, 0.0, 1.0]), (None, [9.0, 9.0, 9.0]), (90, None), (91, []), (92, [1.0]), (93, [None, 1.0, 1.0]), (94, [NAN] * 3), (95, [INF] * 3)] + [(200, [5.0, 5.0, 5.0])] * 60
    for k in (4, 200):
        assert bag(centroid_clustering.cluster_report(vectors(spark, rows), clusters=k, dim=3), *CLUSTER_COLUMNS) == plain_clusters(rows, k, 3, 3)
    big = rows + [(300, [1e7, -1e7, 0.0]), (301, [1e7, 1e7, 1.0])]
    assert bag(centroid_clustering.cluster_report(vectors(spark, big), clusters=9, dim=3), *CLUSTER_COLUMNS) == plain_clusters(big, 9, 3, 3)
    assert centroid_clustering.cluster_report(vectors(spark, [(1, [1e300] * 3), (2, [0.0] * 3)]), clusters=2, dim=3).count() == 2
    assert centroid_clustering.cluster_report(vectors(spark, [(90, None)]), dim=3).count() == 0


def test_partial_distances_abandon():
    """Fewer squares than comparing everything, with the same nearest centroids; ties go to the smaller number."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 64)) * np.linspace(1, 40, 64)).astype(np.int64)
    c = np.vstack([x[:15], x[3:4]])
    order = np.argsort(-x.var(axis=0), kind="stable")
    cluster, distance, looked = centroid_clustering.nearest(x, c, order)
    whole = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert looked < 0.75 * x.size * len(c) and looked < centroid_clustering.nearest(x, c, order[::-1])[2]
