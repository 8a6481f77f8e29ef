"""Clusters and near copies of embeddings against brute force."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipweave.llm import bit_clusters, vector_copies
from slipweave.llm.registry import QUERIES

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    clash = [(i, v, 1, "h", 2, 3.0) for i, v in rows]
    return spark.createDataFrame(clash, f"vec_id bigint, embedding array<{kind}>, node int, h string, cluster int, d double").repartition(3)


def odd_vectors(size):
    return [None, [], [0.0] * size, [NAN] + [1.0] * (size - 1), [INF] * size, [None] + [1.0] * (size - 1), [1.0] * (size - 1), [-0.0] * size]


def near_copies(rows, threshold):
    """(id, links, component) per row, row by row and pair by pair."""
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    use = [k for k, (_, v) in enumerate(rows) if fine(v)]
    links, root = [0] * len(rows), list(range(len(rows)))
    for n, i in enumerate(use):
        for j in use[n + 1:]:
            if len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
    known = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    least = {r: min((k for k in range(len(rows)) if root[k] == r), key=known) for r in set(root)}
    return sorted((repr(i), links[k], repr(rows[least[root[k]]][0])) for k, (i, _) in enumerate(rows))


def check_copies(spark, rows, threshold=0.9, block=vector_copies.BLOCK, kind="float"):
    if kind == "float":
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = vector_copies.near_vectors(frame(spark, rows, kind), threshold, block=block).collect()
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id)) for r in got) == near_copies(rows, threshold)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return got


def cloud(rng, n, size, spread):
    base = rng.normal(size=size)
    return [(base + spread * rng.normal(size=size)).tolist() for _ in range(n)]


@pytest.mark.parametrize("threshold, block", [(0.9, 40), (0.9, 8192), (0.97, 60)])
def test_near_vectors(spark, monkeypatch, threshold, block):
    """Chains and crowds over several tiles and blocks, among vectors at random."""
    monkeypatch.setattr(vector_copies, "TILE", 24)
    rng = np.random.default_rng(11)
    vectors = [rng.normal(size=64).tolist() for _ in range(120)] + cloud(rng, 60, 64, 0.05) + cloud(rng, 50, 64, 0.3) + cloud(rng, 20, 64, 0.34)
    vectors += [vectors[3]] * 15 + [vectors[130]] * 9
    ids = rng.permutation(len(vectors)).tolist()
    got = check_copies(spark, list(zip(ids, vectors, strict=True)), threshold, block)
    assert any(r.n_links > 50 for r in got) and any(not r.n_links for r in got)


def test_near_vectors_of_any_length_and_content(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(odd_vectors(64) + odd_vectors(3))]
    for size in (1, 2, 3, 20, 700):
        rows += [(100 * size + k, v) for k, v in enumerate(cloud(rng, 6, size, 0.2))]
    rows += [(None, rows[-1][1]), (None, None), (7000, rows[-1][1]), (rows[-1][0], rows[-2][1]), (8000, [1e-40] * 3), (8001, [1e30] * 3), (8002, [-1.0] * 3)]
    check_copies(spark, rows, kind="double")


def test_no_vectors(spark):
    assert vector_copies.near_vectors(frame(spark, [])).collect() == []
    alone = vector_copies.near_vectors(frame(spark, [(1, None), (2, [1.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in alone) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bound_is_never_below_the_cosine():
    rng = np.random.default_rng(13)
    v = np.concatenate((rng.normal(size=(60, 64)), np.array(cloud(rng, 40, 64, 0.3))))
    block = vector_copies.Block(np.arange(100), np.ones(100, np.int64), v, np.linalg.qr(rng.normal(size=(64, 64)))[0])
    cosine = block.unit @ block.unit.T
    assert (block.bound @ block.bound.T >= cosine - vector_copies.SLACK).all()
    i, j = vector_copies.linked(block, block, 0, 100, 0, 100, 0.9)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a in range(100) for b in range(a + 1, 100) if cosine[a, b] >= 0.9}


def cluster_rows(rows, k, rounds, size):
    """(id, cluster, distance, hash of the centroid) per kept row, by plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    top = math.floor(1024 * 65536) - 1
    kept = [(i, [max(-top, min(top, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    return sorted((repr(i), n, d) for i, d, n in found), centroids


@pytest.mark.parametrize("size, scale", [(64, 1.0), (70, 300.0), (5, 1e9)])
def test_clusters(spark, size, scale):
    rng = np.random.default_rng(14)
    vectors = [v for _ in range(4) for v in cloud(rng, 25, size, 0.3)]
    vectors = [[float(np.float32(scale * x)) for x in v] for v in vectors]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(900 + k, v) for k, v in enumerate(odd_vectors(size))] + [(None, vectors[0]), (3, vectors[5]), (950, vectors[5]), (951, [0.0] * (size + 1))]
    got, centroids = bit_clusters.clusters(frame(spark, rows), 6, 7, size=size)
    want, last = cluster_rows(rows, 6, 7, size)
    assert centroids.tolist() == last
    assert sorted((repr(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want


def test_fewer_vectors_than_centroids(spark):
    got, centroids = bit_clusters.clusters(frame(spark, [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.0] * 64)]))
    assert len(centroids) == 3 and sorted((r.vec_id, r.distance) for r in got.collect()) == [(1, 0), (2, 0), (3, 0)]
    got, centroids = bit_clusters.clusters(frame(spark, [(1, None)]))
    assert not len(centroids) and got.collect() == []


def test_planes_are_exact():
    rng = np.random.default_rng(15)
    a, c = (rng.integers(-(1 << 26), 1 << 26, (n, 64)) for n in (40, 5))
    p, q = (bit_clusters.pack(x, 27) for x in (a, c))
    assert (bit_clusters.products(p, q) == a @ c.T).all() and (bit_clusters.squares(p) == (a * a).sum(axis=1)).all()
    cluster = rng.integers(0, 3, 40)
    assert (bit_clusters.sums(p, cluster, 3, 64) == np.stack([a[cluster == n].sum(axis=0) for n in range(3)])).all()


def test_queries_on_empty_tables(spark, tmp_path):
    frame(spark, []).select("vec_id", "embedding", F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op11_bit_clusters"](spark, str(tmp_path)).collect() == [] and QUERIES["op12_vector_copies"](spark, str(tmp_path)).collect() == []
