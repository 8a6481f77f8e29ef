"""Centroid clustering on bit planes.

Components become integers floor(scale * x). Bit p of all components of a vector is one plane, packed 64 components to an unsigned 64-bit word; numbers are
in two's complement, so the last plane has a negative weight. The product of a vector and a centroid is the sum of 2^(p+q) popcount(plane p AND centroid
plane q), the squared distance |x|^2 - 2 x c + |c|^2 follows, and the sums of a cluster are counts of set bits per plane and component: all exact integers.

A round is one job over the stored planes: every task assigns its vectors and returns one row of sums per centroid; a grouped sum leaves k rows for the driver.
Rounds that change no centroid would change none later, so they are not run. The k centroids are the only thing sent to the tasks.

Kept are vectors with exactly ``size`` components, none null or non-finite; other rows, and those without vector, are left out. Components beyond
+-(2^26 - 1) after scaling count as that bound, so that every distance fits a long. Rows with a null id are kept; their hash is that of an empty id. Rows that
repeat an id are vectors of their own; as first centroids they follow one another in the order of their integers. With fewer than k kept vectors
there are as many centroids; without any the result is empty.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slipweave.llm.common import column, stored
from slipweave.llm.registry import query

K, ROUNDS, SCALE, SEED, SIZE = 8, 10, 1024, "3", 64
#: Largest absolute value of a scaled component.
BOUND = (1 << 26) - 1
#: Rows that a task works on at a time.
CHUNK = 2048


def integers(v: Column, scale: int) -> Column:
    """The scaled components as integers."""
    return F.transform(v, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(BOUND)), F.lit(-BOUND)))


def weights(planes: int) -> np.ndarray:
    """The weight of each plane; the last one holds the sign."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """Integers (rows, size) as words (rows, planes, words of 64 components)."""
    words = -(-x.shape[1] // 64)
    bits = np.zeros((len(x), planes, words * 64), np.uint8)
    bits[:, :, :x.shape[1]] = (x[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products (rows, centroids) of packed vectors."""
    w, out = weights(a.shape[1]), np.zeros((len(a), len(c)), np.int64)
    for p in range(a.shape[1]):
        for q in range(c.shape[1]):
            out += w[p] * w[q] * np.bitwise_count(a[:, None, p] & c[None, :, q]).sum(axis=2, dtype=np.int64)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Exact squared norms of packed vectors."""
    w, out = weights(a.shape[1]), np.zeros(len(a), np.int64)
    for p in range(a.shape[1]):
        for q in range(p, a.shape[1]):
            out += w[p] * w[q] * (1 if p == q else 2) * np.bitwise_count(a[:, p] & a[:, q]).sum(axis=1, dtype=np.int64)
    return out


def sums(a: np.ndarray, cluster: np.ndarray, k: int, size: int) -> np.ndarray:
    """Component sums (k, size) of the vectors of each cluster, from the number of set bits per plane and component."""
    bits = np.unpackbits(a.view(np.uint8).reshape(len(a), a.shape[1], -1), axis=2, bitorder="little")[:, :, :size]
    member = (np.arange(k)[:, None] == cluster[None, :]).astype(np.float32)
    counts = (member @ bits.reshape(len(a), -1).astype(np.float32)).reshape(k, a.shape[1], size)
    return np.einsum("p,kps->ks", weights(a.shape[1]), counts.astype(np.int64))


def _chunks(batches: Iterator, planes: int) -> Iterator:
    """(batch, packed vectors) of at most CHUNK rows; the planes are the column ``planes``."""
    for whole in batches:
        for lo in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(lo, CHUNK)
            words = batch.column("planes").flatten().to_numpy(zero_copy_only=False)
            yield batch, words.view(np.uint64).reshape(batch.num_rows, planes, -1)


def _assigned(a: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of the nearest centroid, the first one on ties."""
    c = pack(centroids, a.shape[1])
    far = norm[:, None] - 2 * products(a, c) + squares(c)[None, :]
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(a)), cluster]


def packed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, int]:
    """The stored table (vec_id, x, planes, norm) of the kept vectors and the number of planes."""
    import pyarrow as pa

    v = column(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.filter(F.coalesce((F.size(v) == size) & finite, F.lit(False))).select(column(vec_id).alias("vec_id"), integers(v, scale).alias("x"))
    largest = kept.agg(F.max(F.array_max(F.transform("x", lambda x: F.when(x < 0, -x - 1).otherwise(x))))).first()[0]
    planes = int(largest or 0).bit_length() + 1

    def run(batches: Iterator) -> Iterator:
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(lo, CHUNK)
                a = pack(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size), planes)
                words = pa.array(list(a.reshape(batch.num_rows, -1).view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, words, pa.array(squares(a))], names=["vec_id", "x", "planes", "norm"])
    return stored(kept.mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, x array<bigint>, planes array<bigint>, norm bigint")), planes


def first_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The vectors with the least hashes, k at most, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r.x for r in found], dtype=np.int64)


def refined(rows: DataFrame, planes: int, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds."""
    import pyarrow as pa

    for _ in range(rounds):
        k, size = centroids.shape

        def run(batches: Iterator, given=centroids, k=k, size=size) -> Iterator:
            total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
            for batch, a in _chunks(batches, planes):
                cluster, _ = _assigned(a, batch.column("norm").to_numpy(), given)
                total += sums(a, cluster, k, size)
                count += np.bincount(cluster, minlength=k)
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])
        parts = rows.select("planes", "norm").mapInArrow(run, "cluster bigint, n bigint, total array<bigint>")
        after = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total")).collect():
            after[r.cluster] = [t // r.n for t in r.total]
        if (after == centroids).all():
            break
        centroids = after
    return centroids


def clusters(df: DataFrame, k: int = K, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE,
             seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids."""
    import pyarrow as pa

    rows, planes = packed(df, vec_id, vector, size, scale)
    centroids = first_centroids(rows, k, seed).reshape(-1, size)
    if len(centroids):
        centroids = refined(rows, planes, centroids, rounds)

    def run(batches: Iterator) -> Iterator:
        for batch, a in _chunks(batches, planes):
            cluster, distance = _assigned(a, batch.column("norm").to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "planes", "norm").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), centroids


def _oracle() -> str:
    distance = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {K})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min({{'d': {distance}, 'k': k}}) AS b FROM v, c{r} GROUP BY vec_id)""")
        if r < ROUNDS:
            parts.append(f"""s{r} AS (SELECT k, i, CAST(floor(sum(y) / count(*)) AS HUGEINT) AS m, sum(y) AS t, count(*) AS n FROM
    (SELECT b.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN
    (SELECT k, list(CAST((t - ((t % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS c FROM s{r} GROUP BY k) n ON n.k = c{r}.k)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(b.k AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.k = b.k"""


@query("op11_bit_clusters", _oracle())
def op11_bit_clusters(spark, sf_dir):
    found, centroids = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = stored(found)
    # one row per centroid
    own = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(i, own.get(i, 0), sum(own.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    groups = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(groups), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
