"""Near copies among embeddings by PCA-ordered, tiled comparison.

Vectors are turned to the principal axes of their second moments (all vectors count), so the leading coordinates hold most of a vector's length. By
Cauchy and Schwarz the product of what follows coordinate k is at most the product of the two suffix norms; with the suffix norm as one more
coordinate, a single matrix product of the first LEADS[0] coordinates bounds the cosine of every pair of a tile from above. Pairs that cannot reach
the threshold stop there; the others add the next coordinates and are bounded again; what is left is decided in double precision on the given
components. Tiles in which many pairs are left take the full product at once; only pairs within DOUBT of the threshold are then computed one by one.

Two vectors within the threshold differ by at most sqrt(2 - 2 threshold) in each coordinate. The first two coordinates are cut into cells of that
width; a cell is split by hash into blocks of BLOCK rows, and only blocks of the same or neighbouring cells meet, each pair of blocks in one task with
both blocks in memory. Where vectors lie evenly in all directions no cell is far from another and every two blocks meet.

A task returns one row per vector with links: how many, and the root of its group inside the task. So a group of near copies costs rows in proportion
to its vectors. Equal vectors are one node from the start.

A vector links with nothing when it is null, empty, zero or holds null or non-finite components; vectors of different lengths don't link. Null ids are
larger than all others. Every row counts as a vector of its own, also rows that repeat an id. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slipweave.llm.common import attach, column, stored
from slipweave.llm.registry import query
from slipweave.llm.simhash import components

THRESHOLD = 0.9
#: Coordinates after which the bound is tested.
LEADS = (16, 32, 48)
#: Rows of a block and of a tile; longer vectors than WIDE components make blocks of fewer rows.
BLOCK, TILE, WIDE = 8192, 1024, 256
#: Slack of bounds in single precision, and of matrix products in double precision.
SLACK, DOUBT = 1e-5, 1e-9
#: Share of a tile's pairs from which on the full product is taken.
CROWDED = 1 / 16
#: The AXES most frequent lengths up to LONGEST have principal axes; others keep their axes, which only bounds less tightly.
AXES, LONGEST = 16, 512


def usable(v: Column) -> Column:
    """Whether a vector can link."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(vectors) -> np.ndarray:
    """Rows of equal length, scaled by a power of two so that squares neither overflow nor vanish."""
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _by_length(vectors) -> Iterator[tuple[int, np.ndarray]]:
    """(length, row numbers) of an Arrow list column."""
    lengths = np.diff(vectors.offsets.to_numpy())
    for d in np.unique(lengths).tolist():
        yield d, np.flatnonzero(lengths == d)


def _moments(nodes: DataFrame, lengths: list[int]) -> dict[int, np.ndarray]:
    """Sums of u u' over all unit vectors of each of the lengths."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column(0)
            for d, at in _by_length(v):
                m = _matrix(v.take(pa.array(at)))
                u = m / np.linalg.norm(m, axis=1, keepdims=True)
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            flat = s.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["d", "at", "s"])
    found = nodes.filter(F.size("v").isin(lengths)).select("v").mapInArrow(run, "d int, at int, s double").groupBy("d", "at").agg(F.sum("s").alias("s")).toPandas()
    return {int(d): g.sort_values("at")["s"].to_numpy().reshape(int(d), int(d)) for d, g in found.groupby("d")}


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Orthogonal axes by vector length, those with most of the vectors' length first."""
    common = nodes.select(F.size("v").alias("d")).filter(F.col("d") <= LONGEST).groupBy("d").count().orderBy(F.col("count").desc(), "d").limit(AXES)
    lengths = [r.d for r in common.collect()]
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in _moments(nodes, lengths).items()} if lengths else {}


class Block:
    """Vectors of one length with their leading coordinates, suffix norms and weights."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, v: np.ndarray, axes: np.ndarray | None):
        self.nodes, self.weights, self.v = nodes, weights, v
        self.norm = np.linalg.norm(v, axis=1)
        self.unit = v / self.norm[:, None]
        turned = self.unit if axes is None else self.unit @ axes
        self.turned = turned.astype(np.float32)
        self.leads = [k for k in LEADS if k < v.shape[1]] + [v.shape[1]]
        rest = np.concatenate((np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(v), 1))), axis=1)
        self.suffix = np.sqrt(np.maximum(rest[:, self.leads], 0)).astype(np.float32)
        self.bound = np.concatenate((self.turned[:, :self.leads[0]], self.suffix[:, :1]), axis=1)
        self.links = np.zeros(len(v), np.int64)


def linked(a: Block, b: Block, i0: int, i1: int, j0: int, j1: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs of a tile; of a tile with itself, those with i < j."""
    above = a.bound[i0:i1] @ b.bound[j0:j1].T >= threshold - SLACK
    if a is b and i0 == j0:
        above &= np.tri(i1 - i0, dtype=bool).T
        np.fill_diagonal(above, False)
    n = np.count_nonzero(above)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sure = None
    if n > CROWDED * above.size:
        cosine = a.unit[i0:i1] @ b.unit[j0:j1].T
        sure, above = np.nonzero(above & (cosine >= threshold + DOUBT)), above & (np.abs(cosine - threshold) < DOUBT)
    i, j = np.nonzero(above)
    i, j, far = i + i0, j + j0, a.leads[0]
    if sure is None and len(a.leads) > 1:
        product = np.einsum("ij,ij->i", a.turned[i, :far], b.turned[j, :far])
        for k, lead in enumerate(a.leads[1:-1], 1):
            product += np.einsum("ij,ij->i", a.turned[i, far:lead], b.turned[j, far:lead])
            left = product + a.suffix[i, k] * b.suffix[j, k] >= threshold - SLACK
            i, j, product, far = i[left], j[left], product[left], lead
    near = np.empty(len(i), bool)
    for lo in range(0, len(i), 1 << 14):
        p, q = i[lo:lo + (1 << 14)], j[lo:lo + (1 << 14)]
        near[lo:lo + (1 << 14)] = (a.v[p] * b.v[q]).sum(axis=1) / (a.norm[p] * b.norm[q]) >= threshold
    i, j = i[near], j[near]
    return (i, j) if sure is None else (np.concatenate((sure[0] + i0, i)), np.concatenate((sure[1] + j0, j)))


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j in an array of each element's least member."""
    while len(i):
        p, q = root[i], root[j]
        apart = p != q
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
        while (further := to[to]).tobytes() != to.tobytes():
            to = further
        root[:] = to[root]


def compared(a: Block, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the vectors of two blocks, or of one with itself, that have links."""
    same = a is b
    root = np.arange(len(a.nodes) + (0 if same else len(b.nodes)))
    shift = 0 if same else len(a.nodes)
    for i0 in range(0, len(a.nodes), TILE):
        for j0 in range(i0 if same else 0, len(b.nodes), TILE):
            i, j = linked(a, b, i0, min(i0 + TILE, len(a.nodes)), j0, min(j0 + TILE, len(b.nodes)), threshold)
            np.add.at(a.links, i, b.weights[j])
            np.add.at(b.links, j, a.weights[i])
            merge(root, i, j + shift)
    nodes = a.nodes if same else np.concatenate((a.nodes, b.nodes))
    links = a.links if same else np.concatenate((a.links, b.links))
    met = np.flatnonzero(links)
    return nodes[met], links[met], nodes[root[met]]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    """mapInArrow over (a, b, side, node, n, v) sorted by a, b, side: the links of each pair of blocks."""
    import pyarrow as pa

    def of(parts: list) -> Block:
        v = np.concatenate([p[2] for p in parts])
        return Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), v, axes.get(v.shape[1]))

    def result(held: dict) -> pa.RecordBatch:
        left = of(held[0])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in compared(left, of(held[1]) if 1 in held else left, threshold)], names=["node", "links", "root"])

    def run(batches: Iterator) -> Iterator:
        pair, held = None, {}
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
            if not len(keys):
                continue
            node, n, v = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = tuple(keys[lo, :2].tolist())
                if own != pair:
                    if 0 in held and (1 in held or pair[0] == pair[1]):
                        yield result(held)
                    pair, held = own, {}
                held.setdefault(int(keys[lo, 2]), []).append((node[lo:hi], n[lo:hi], _matrix(v.slice(lo, hi - lo))))
        if 0 in held and (1 in held or pair[0] == pair[1]):
            yield result(held)
    return run


def _placed(nodes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """nodes (node, n, v) with the cell (d, c1, c2) of their first two coordinates."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            v, cells = batch.column(2), np.zeros((batch.num_rows, 3), np.int32)
            for d, at in _by_length(v):
                m = _matrix(v.take(pa.array(at)))
                u, turn = m / np.linalg.norm(m, axis=1, keepdims=True), axes.get(d)
                first = u[:, :2] if turn is None else u @ turn[:, :2]
                cells[at, 0] = d
                cells[at, 1:1 + first.shape[1]] = np.floor(first / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, k]) for k in range(3))], names=["node", "n", "v", "d", "c1", "c2"])
    return nodes.select("node", "n", "v").mapInArrow(run, f"node bigint, n bigint, v {dict(nodes.dtypes)['v']}, d int, c1 int, c2 int")


def vector_links(nodes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(node, links, root) of the stored, distinct, usable vectors (node, n, v): rows whose links add up and whose edges (node, root) join all that is linked."""
    axes = principal_axes(nodes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    placed, cell = stored(_placed(nodes, axes, width)), ["d", "c1", "c2"]
    rows = F.greatest(F.lit(TILE), F.floor(F.lit(block) * WIDE / F.greatest("d", F.lit(WIDE))))
    cells = stored(placed.groupBy(*cell).agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / rows)))
    own = attach(placed, cells, cell, "m", placed.count())
    own = own.select(F.xxhash64(*cell, F.pmod(F.xxhash64("node"), "blocks")).alias("blk"), "node", "n", "v")
    blocks = stored(cells.select(*cell, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("s")).select(*cell, F.xxhash64(*cell, "s").alias("blk")))
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = blocks.select("d", F.explode(step).alias("x"), "c1", "c2", F.col("blk").alias("a")).select("d", (F.col("c1") + F.col("x")).alias("c1"), F.explode(step).alias("y"), "c2", "a")
    around = around.select("d", "c1", (F.col("c2") + F.col("y")).alias("c2"), "a")
    pairs = stored(around.join(blocks.withColumnRenamed("blk", "b"), cell).filter("a <= b").select("a", "b").distinct())
    sides = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("blk")).unionByName(
        pairs.filter("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("blk")))
    dealt = own.join(sides, "blk").select("a", "b", "side", "node", "n", "v").repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return dealt.mapInArrow(_compare(axes, threshold), "node bigint, links bigint, root bigint")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of df."""
    v = column(vector)
    rows = df.select(column(vec_id).alias("vec_id"), v.alias("v"), usable(v).alias("ok"), F.xxhash64(v).alias("h"), F.xxhash64(F.lit(1), v).alias("g"))
    keys = stored(rows.select("vec_id", "ok", "h", "g"))
    nodes = stored(rows.filter("ok").groupBy("h", "g").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
                   .withColumn("node", F.monotonically_increasing_id()))
    found = stored(vector_links(nodes, threshold, block))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = stored(components(found.select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b"))).withColumnRenamed("root", "top"))
    placed = stored(nodes.select("node", "h", "g", "n", "least").join(links, "node", "left").join(roots, "node", "left")
                    .select("h", "g", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "node").alias("top")))
    tops = stored(placed.groupBy("top").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    named = stored(attach(placed, tops, ["top"], "m", placed.count()).select("h", "g", "n", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links")))
    met = attach(keys.filter("ok"), named, ["h", "g"], "n", keys.count()).select("vec_id", "n_links", "component_id")
    alone = keys.filter("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


@query("op12_vector_copies", f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM e WHERE e.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""")
def op12_vector_copies(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
