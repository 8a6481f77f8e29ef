"""Near-duplicate groups by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint bit is set when it is set in more than half of the XXH64 hashes of the text's word shingles. Fingerprints that differ in
at most ``radius`` bits are linked; a group is a connected component of links.

Candidates come from a covering family of bit masks: bit i of a fingerprint carries a nonzero vector m(i) of radius + 1 bits, and
mask v, for every nonzero v, keeps the bits whose m(i) has odd inner product with v. The at most ``radius`` vectors of the differing bits
leave some v orthogonal to all of them, so that table sees two equal keys: no pair within the radius is missed.

Equal fingerprints are one node. Buckets of up to SMALL nodes are compared pair by pair as their sorted rows stream by; nodes of
larger buckets are compared in another exact way, through the balls around them: two fingerprints differ in at most a + b bits exactly if
one changes into a common third one by at most a bits and the other by at most b. All nodes that share such a third
fingerprint are linked to the least of them, so a group of near copies of any size costs a fixed number of rows per node and no pairs.
Components come from repeated star contraction over stored edge tables.

Texts without words have fingerprint zero and are linked like any other; null counts as empty. Rows that share a doc_id may carry
different texts: each row keeps its own fingerprint and component. A null doc_id takes part, and is the representative of no group
that has another doc_id.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, functions as F

from slipweave.llm.common import attach, column, documents, stored
from slipweave.llm.registry import query

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Nodes of a bucket that are compared pair by pair.
SMALL = 128
#: Shingle hashes counted at a time, so a very long text needs no more memory than a short one.
BLOCK = 1 << 14
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = WORDS.findall(text.translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:len(words) - k])).tolist()
    stops = (ends[k - 1:] - 1).tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(starts)
    for lo in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo:lo + BLOCK], stops[lo:lo + BLOCK], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the 64 bits as a signed number): one row per row of docs."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "h", "fp"])
    given = docs.select(column(doc_id).alias("doc_id"), F.xxhash64(column(text)).alias("h"), F.encode(column(text), "utf-8").alias("text"))
    return given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, h bigint, fp bigint")


def covering_masks(radius: int) -> list[int]:
    """The 2**(radius + 1) - 1 masks of the covering family, as signed 64-bit numbers."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(64)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)]
    return np.array(masks, dtype=np.uint64).view(np.int64).tolist()


def flips(upto: int) -> list[int]:
    """All patterns of at most ``upto`` bits."""
    patterns = [sum(1 << i for i in c) for k in range(upto + 1) for c in combinations(range(64), k)]
    return np.array(patterns, dtype=np.uint64).view(np.int64).tolist()


def _bucket_links(radius: int, small: int):
    """Streams rows (table, key, fp) sorted by table and key: pairs within the radius of small buckets, and the nodes of larger ones."""
    import pyarrow as pa

    def of_bucket(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(fps), 1)
        near = np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= radius
        return fps[i[near]], fps[j[near]]

    def run(batches: Iterator) -> Iterator:
        last, members, large = None, np.zeros(0, np.int64), False
        for batch in batches:
            table, key, fps = (batch.column(k).to_numpy() for k in range(3))
            if not len(fps):
                continue
            cut = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
            bounds = np.concatenate(([0], cut, [len(fps)]))
            sizes = np.diff(bounds)
            left, right, hot = [], [], []

            def close(members=None, large=False):
                if not large and 1 < len(members):
                    a, b = of_bucket(members)
                    left.append(a)
                    right.append(b)

            first = (table[0], key[0])
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)).tolist():
                own = fps[bounds[g]:bounds[g + 1]]
                if g == 0 and last == first:
                    if large or len(members) + len(own) > small:
                        hot += [own] if large else [members, own]
                        members, large = np.zeros(0, np.int64), True
                    else:
                        members = np.concatenate((members, own))
                else:
                    close(members, large)
                    members, large = own, len(own) > small
                    if large:
                        hot.append(own)
                        members = np.zeros(0, np.int64)
                if g < len(sizes) - 1:
                    close(members, large)
                    members, large = np.zeros(0, np.int64), False
            last = (table[-1], key[-1])
            hot = np.concatenate(hot) if hot else np.zeros(0, np.int64)
            a = np.concatenate([*left, hot]) if left or len(hot) else np.zeros(0, np.int64)
            b = np.concatenate([*right, hot]) if left or len(hot) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if not large and len(members) > 1:
            a, b = of_bucket(members)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(a, b) with a < b: links among the distinct fingerprints ``nodes.fp`` whose components are those of all links within the radius."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in covering_masks(radius)])
    keyed = nodes.select(F.posexplode(masks).alias("table", "mask"), "fp").select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    found = stored(keyed.repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(_bucket_links(radius, small), "a bigint, b bigint")
                   .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.lit(1)).select("a", "b"))
    crowded = found.filter("a = b").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return found
    far = flips(radius - radius // 2)
    inner = F.array(*[F.lit(n <= _ball(radius // 2)) for n in range(1, len(far) + 1)])
    patterns = F.arrays_zip(F.array(*[F.lit(m).cast("bigint") for m in far]).alias("f"), inner.alias("inner"))
    balls = crowded.select("fp", F.explode(patterns).alias("p")).select(F.col("fp").bitwiseXOR(F.col("p.f")).alias("z"), "fp", "p.inner")
    # members of a ball are at most as many as its patterns
    meet = balls.groupBy("z").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("c"), F.collect_set("fp").alias("fps"))
    star = meet.filter("c is not null and size(fps) > 1").select("c", F.explode("fps").alias("fp"))
    return found.filter("a < b").unionByName(star.filter("c <> fp").select(F.least("c", "fp").alias("a"), F.greatest("c", "fp").alias("b")).distinct())


def _ball(radius: int) -> int:
    return sum(comb(64, k) for k in range(radius + 1))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of the edges (a, b) but the least ones. Alternates large-star and small-star over stored tables."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, before = stored(edges.filter("a < b").select("a", "b").distinct()), None
    while True:
        sides = both(edges)
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        tops = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(tops, "b")
        small = met.select(F.col("m").alias("a"), "b").unionByName(met.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct()
        edges = stored(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
        before = state


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text",
                small: int = SMALL) -> DataFrame:
    """doc_id, h, fingerprint, component_id: one row per row of docs; component_id is the smallest doc_id reachable."""
    prints = stored(fingerprints(docs, doc_id, text, shingle))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = stored(components(fingerprint_links(nodes.select("fp"), radius, small)))
    placed = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    total = prints.count()
    tops = stored(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    named = stored(attach(placed, tops, ["root"], "m", total).select("fp", "n", "component_id"))
    out = attach(prints, named, ["fp"], "n", total)
    return out.select("doc_id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one document per group: the one with the smallest doc_id. Rows that repeat its doc_id and text stay with it."""
    drop = (near_groups(docs, radius, shingle, doc_id, text).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("id"), "h").distinct())
    rows = docs.select(F.struct("*").alias("row"), column(doc_id).alias("id"), F.xxhash64(column(text)).alias("h"))
    return rows.alias("r").join(drop.alias("d"), F.expr("r.h = d.h and r.id <=> d.id"), "left_anti").select("row.*")


@query("op5_simhash_groups")
def op5_simhash_groups(spark, sf_dir):
    return near_groups(documents(spark, sf_dir)).drop("h")
