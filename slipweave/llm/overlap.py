"""Near copies by word overlap: SimHash fingerprints and MinHash bands find candidates, the exact Jaccard similarity of their shingle sets decides.

The shingles of a text are its runs of SHINGLE lower-cased words; a text with fewer words has one shingle of all of them, a text without words
(null counts as one) a shingle that only such texts have. Two texts are near copies when their sets of shingles have a Jaccard similarity of
PERCENT or more. The first candidates are each text and the least of its group of fingerprints, which the covering tables of ``simhash`` link; they are the closest
copies, and what they leave is less for the rest. Fingerprints within four bits cover only part of the near copies, so further candidates share one of BANDS keys of ROWS minima each: of pairs with similarity s, a share of 1 - (1 - s**ROWS)**BANDS, so
more than 0.9999 at 0.8, and more above.

Buckets of up to SMALL texts are compared pair by pair. In a larger one all texts are compared with one of them, another one each round; every
component of found near copies leaves only its first text before the next round, so a group of near copies of any size costs a fixed number of rows per
text. What is still crowded after ROUNDS rounds are texts alike enough to share a key, but no near copies of each other: texts that have boilerplate in
common. They meet by their rarest shingles instead. Two sets of which either holds PERCENT of the other share one of the n - ceil(n PERCENT) + 1 shingles
of each that the fewest of these texts hold (n is the set's size), and boilerplate is not among those. The texts of such a shingle are compared in the
same rounds, and what is crowded even then pair by pair.
So no two texts stay that share a key and are near copies, and every text that goes is linked by a chain of near copies to one that stays.

The first text is that with the smallest (doc_id, hash of the text); null ids come last. Rows of one text and different ids are near copies; rows that
repeat doc_id and text stay or go together.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slipweave.llm.common import attach, column, stored
from slipweave.llm.simhash import LOWER, WORDS, fingerprint_links, fingerprints
from slipweave.operators.groups import connected

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 6
SMALL, ROUNDS = 16, 2
#: Shingles whose minima are taken at a time, and words whose hashes a task remembers.
BLOCK, HELD_WORDS = 1 << 12, 200_000
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, known: dict | None = None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different hashes of the word runs of a text; ``known`` holds hashes of words."""
    import xxhash

    known = {} if known is None else known
    if len(known) > HELD_WORDS:
        known.clear()
    codes = []
    for w in WORDS.findall(text.translate(LOWER)):
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh64_intdigest(w)
        codes.append(code)
    if not codes:
        return np.zeros(1, np.uint64)
    v, k = np.array(codes, dtype=np.uint64), min(shingle, len(codes))
    total = np.full(len(v) - k + 1, k, np.uint64)
    for j in range(k):
        total = _mixed(total + v[j:len(v) - k + 1 + j] * _PLACES[j])
    return np.unique(total)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[lo:lo + BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0))
    least, key = least.reshape(BANDS, ROWS), _BANDS.copy()
    for r in range(ROWS):
        key = _mixed(key + least[:, r])
    return key


def _per_text(rows: DataFrame, keyed: bool, shingle: int) -> DataFrame:
    """rows (.., text) with ``v`` in place of the text: its band keys, or its shingles."""
    import pyarrow as pa

    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator) -> Iterator:
        known: dict = {}
        for batch in batches:
            sets = (shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", known, shingle) for t in batch.column(len(names)))
            v = [(band_keys(s) if keyed else s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(v, pa.list_(pa.int64()))], names=[*names, "v"])
    given = rows.select(*names, F.encode("text", "utf-8").alias("text"))
    types = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names) + ", v array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets (h, v) have at least the similarity."""
    total = pairs.count()
    for side in ("a", "b"):
        n = pairs.groupBy(side).agg(F.count("*").alias("n"))
        own = stored(n.join(sets, n[side] == sets.h).select(side, "n", F.col("v").alias(f"v{side}")))
        pairs = attach(pairs, own, [side], "n", total).drop("n")
    both = F.size(F.array_intersect("va", "vb"))
    return pairs.filter(100 * both >= percent * (F.size("va") + F.size("vb") - both)).select("a", "b")


def _candidates(members: DataFrame, buckets: DataFrame, total: int, turn: int, every: bool) -> DataFrame:
    """(a, b) with a < b: pairs of the small buckets, pairs of the larger ones with the text whose turn it is."""
    placed = stored(attach(members, buckets, ["key"], "n", total).filter("n is not null"))
    small = placed.filter(F.lit(every) | (F.col("n") <= SMALL)).select("key", "h")
    inner = small.alias("x").join(small.alias("y"), F.expr("x.key = y.key and x.h < y.h")).select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))
    if every:
        return inner.distinct()
    star = placed.filter(F.col("n") > SMALL).select(F.least("h", "hub.h").alias("a"), F.greatest("h", "hub.h").alias("b")).filter("a < b")
    return inner.unionByName(star).distinct()


def _first(doc: Column, h: Column) -> Column:
    return F.struct(doc.isNull().alias("no_id"), doc.alias("doc"), h.alias("h"))


def _later(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h): the nodes of each component but its first one."""
    roots = connected(edges)
    members = roots.select(F.col("node").alias("h"), F.col("head").alias("root")).unionByName(roots.select(F.col("head").alias("h"), F.col("head").alias("root")).distinct())
    members = stored(members.join(nodes, "h").select("h", "root", "first"))
    tops = stored(members.groupBy("root").agg(F.min("first").alias("top"), F.count("*").alias("m")))
    return attach(members, tops, ["root"], "m", members.count()).filter("h <> top.h").select("h")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted, "h", "left_semi").dropDuplicates(["h"]).select("h", "text")


def _gone(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(h): the texts that go by the near copies among the stored pairs (a, b)."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    return _later(stored(similar(pairs, stored(_per_text(_texts(rows, met), False, shingle)), percent)), nodes.select("h", "first"))


def fingerprint_pairs(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b) with a < b: each text and one of its group of fingerprints, so at most one pair per text."""
    known = stored(fingerprints(docs, doc_id, text, shingle).select("h", "fp").distinct())
    heads = stored(known.groupBy("fp").agg(F.min("h").alias("head"), F.count("*").alias("n")))
    roots = connected(fingerprint_links(heads.select("fp"))).withColumnRenamed("head", "root")
    linked = roots.join(heads.select(F.col("fp").alias("node"), F.col("head").alias("x")), "node").join(heads.select(F.col("fp").alias("root"), F.col("head").alias("y")), "root")
    same = attach(known, heads, ["fp"], "n", known.count()).filter("h <> head").select(F.col("h").alias("x"), F.col("head").alias("y"))
    return linked.select("x", "y").unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def rare_members(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, h): the shingles of the stored sets (h, v) that near copies must share, the rarest of each set."""
    each = stored(sets.select("h", F.explode("v").alias("key")))
    held = stored(each.groupBy("key").agg(F.count("*").alias("m")))
    ranked = attach(each, held, ["key"], "m", each.count()).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("m", "key"))).alias("k"))
    n = F.size("k")
    first = F.slice("k", 1, n - F.ceil(n * percent / 100).cast("int") + 1)
    return ranked.select("h", F.explode(first).alias("k")).filter("k.m > 1").select("k.key", "h")


def _thinned(members: DataFrame, rows: DataFrame, nodes: DataFrame, percent: int, shingle: int, gone: list[DataFrame], whole: bool) -> DataFrame | None:
    """Compares the members (key, h) of each key and adds the texts that go (h) to ``gone``.

    Returns what is still crowded after ROUNDS rounds, if anything; with ``whole`` that is compared as well.
    """
    for turn in range(ROUNDS + whole):
        order = F.struct(F.xxhash64("h", F.lit(turn)).alias("o"), "h")
        buckets = stored(members.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("hub")).filter("n > 1"))
        total = buckets.agg(F.sum("n")).first()[0]
        if total is None:
            return None
        later = stored(_gone(stored(_candidates(members, buckets, total, turn, turn == ROUNDS)), rows, nodes, percent, shingle))
        gone.append(later)
        crowded = buckets.filter(F.col("n") > SMALL).select("key", "n")
        if turn == ROUNDS or crowded.isEmpty():
            return None
        members = stored(attach(members, stored(crowded), ["key"], "n", total).filter("n is not null").select("key", "h").join(later, "h", "left_anti"))
    return members


def near_copies(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (id, h), h a hash of the text: the rows that go."""
    rows = docs.select(column(doc_id).alias("doc"), F.xxhash64(column(text)).alias("h"), column(text).alias("text"))
    prints = stored(_per_text(rows, True, shingle))
    nodes = stored(prints.groupBy("h").agg(F.min(_first(F.col("doc"), F.col("h"))).alias("first"), F.count("*").alias("n")))
    # the keys of a text that has several rows are those of any one of them
    one = prints.groupBy("h", "v").agg(F.lit(1)) if nodes.filter("n > 1").limit(1).count() else prints
    close = stored(_gone(stored(fingerprint_pairs(docs, shingle, doc_id, text)), rows, nodes, percent, shingle))
    members, gone = one.select(F.explode("v").alias("key"), "h").join(close, "h", "left_anti"), [close]
    members = _thinned(members, rows, nodes, percent, shingle, gone, False)
    if members is not None:
        crowd = _per_text(_texts(rows, members.select("h").distinct()), False, shingle)
        _thinned(rare_members(stored(crowd), percent), rows, nodes, percent, shingle, gone, True)
    shared = nodes.filter("n > 1").select("h", "n", F.col("first.doc").alias("least"))
    out = attach(prints.select("doc", "h"), stored(shared), ["h"], "n", prints.count()).filter("n is not null and not doc <=> least").select("doc", "h")
    for later in gone:
        out = out.unionByName(prints.select("doc", "h").join(later, "h", "left_semi"))
    return out.distinct().withColumnRenamed("doc", "id")


def near_dedup(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near copies of other rows that stay."""
    drop = stored(near_copies(docs, percent, shingle, doc_id, text))
    rows = docs.select(F.struct("*").alias("row"), column(doc_id).alias("id"), F.xxhash64(column(text)).alias("h"))
    return rows.alias("r").join(drop.alias("d"), F.expr("r.h = d.h and r.id <=> d.id"), "left_anti").select("row.*")
