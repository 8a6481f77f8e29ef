"""Near copies by word overlap against brute-force Jaccard similarities."""
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from slipweave.llm import overlap
from tests.llm import brute


def _sets(rows, k=5):
    words = {d: brute.WORDS.findall((t or "").lower()) for d, t in rows}
    return {d: {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for d, w in words.items()}


def _links(sets):
    where, both = defaultdict(list), defaultdict(int)
    for d in sorted(sets):
        for x in sets[d]:
            where[x].append(d)
    for v in where.values():
        for i, a in enumerate(v):
            for b in v[i + 1:]:
                both[a, b] += 1
    return {(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}


def _check(rows, kept):
    sets = _sets(rows)
    links, root = _links(sets), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in sorted(links):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert not {(a, b) for a, b in links if a in kept and b in kept}
    assert all(find(d) in {find(k) for k in kept} for d in sets) and {d for d in sets if find(d) == d} <= kept
    return links


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_stage_finds_all_near_copies(spark, sf_dir):
    """Copies with one to eight changed words, on both sides of 0.8, among documents; most fingerprints of op5 differ in more than four bits."""
    rng = np.random.default_rng(3)
    rows = [(d, t) for d, t, _, _ in brute.documents(spark, sf_dir)]
    for i, (d, t) in enumerate(rows[:60]):
        words = t.split(" ")
        for k in rng.choice(len(words), min(len(words), 1 + i % 8), replace=False):
            words[k] = f"changed{i}x{k}"
        rows.append((10_000 + d, " ".join(words)))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, _frame(spark, rows), sf_dir).collect()}
    assert len(_check(rows, kept)) > 20


def test_crowd_of_near_copies_and_of_others(spark):
    """A group larger than a small bucket, and texts that share keys but are no near copies."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in rng.choice(200, 1 + i % 4, replace=False):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    other = [f"v{i}" for i in range(150)]
    rows += [(1000 + i, " ".join(other + [f"u{i}z{k}" for k in range(40)])) for i in range(60)]
    kept = {r.doc_id for r in overlap.near_dedup(_frame(spark, rows)).collect()}
    _check(rows, kept)
    assert {1000 + i for i in range(60)} <= kept


def test_boilerplate_does_not_pair(spark):
    """Texts that share most of their words but not four fifths of their shingles meet by rare shingles only: hardly any pairs, and the near copies among them go."""
    shared = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(shared + [f"o{i}x{k}" for k in range(70)])) for i in range(150)]
    rows += [(1000 + i, " ".join(shared + [f"o{i}x{k}" for k in range(66)])) for i in range(0, 150, 10)]
    frame = _frame(spark, rows)
    sets = overlap._per_text(frame.select(F.col("doc_id").alias("h"), "text"), False, 5).cache()
    pairs = overlap._candidates(overlap.rare_members(sets), overlap.rare_members(sets).groupBy("key").agg(F.count("*").alias("n"), F.lit(None).cast("struct<o:bigint,h:bigint>").alias("hub")).filter("n > 1"),
                                len(rows), 0, True)
    assert pairs.count() <= 2 * len(rows)
    kept = {r.doc_id for r in overlap.near_dedup(frame).collect()}
    _check(rows, kept)
    assert kept == set(range(150))


def test_ids_and_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text), (7, text), (7, text + " more"), (9, text), (None, text), (3, "A b"), (4, "a B"), (5, None), (6, " "), (None, "alone")]
    kept = overlap.near_dedup(_frame(spark, rows))
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got in ([(0, "alone"), (3, "A b"), (5, None), (7, text), (7, text)], [(0, "alone"), (3, "A b"), (5, None), (7, text + " more")])
    frame = brute.edge_frame(spark)
    assert overlap.near_dedup(frame).columns == frame.columns and overlap.near_dedup(brute.empty_frame(spark)).count() == 0
