"""Exact copies, near copies, repeated lines and repeated bytes against brute force."""
import hashlib

import numpy as np
import pytest

from slipweave.llm import bloom_dedup, line_winnowing, run_index, simhash
from tests.llm import brute


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_exact_groups(spark, sf_dir, words):
    """Also with a filter of one word, where every row counts as possibly repeated."""
    rows = pairs(brute.documents(spark, sf_dir)) + [(d and d + 10_000, t) for d, t in pairs(brute.edge_rows())]
    got = bloom_dedup.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), max_words=words).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, brute.exact_groups(rows)))


def test_unique_rows_are_not_shuffled(spark):
    keys = spark.createDataFrame([(i, f"text {i % 900}") for i in range(1000)], "doc_id bigint, text string")
    hashed = bloom_dedup.dedup_keys(keys)
    words = bloom_dedup.filter_words(1000)
    tested = bloom_dedup._tested(hashed, "text_sha256", words, bloom_dedup.repeat_filter(hashed, "text_sha256", words))
    maybe = {r.doc_id for r in tested.filter("_maybe").collect()}
    assert {i for i in range(1000) if i % 900 < 100} <= maybe and len(maybe) < 260


def test_exact_survivors(spark):
    df = brute.edge_frame(spark)
    kept = bloom_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(["3", "6", "7", "8", "None", "9", "10", "11", "11"])
    assert bloom_dedup.exact_dedup(brute.empty_frame(spark)).count() == 0
    assert bloom_dedup.exact_groups(brute.empty_frame(spark)).count() == 0


def test_survivor_among_repeated_and_text_ids(spark):
    """Of rows with one id and equal texts but for blanks the longest one stays; ids may be texts."""
    df = spark.createDataFrame([(1, "a b"), (1, "a  b   "), (2, "a b"), (3, "c")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in bloom_dedup.exact_dedup(df).collect()) == [(1, "a  b   "), (3, "c")]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in bloom_dedup.exact_groups(df).collect()) == [(1, 1, False), (1, 1, True), (2, 1, False), (3, 3, True)]
    named = spark.createDataFrame([("x", "a b"), ("b", "ab"), ("c", "a b"), (None, "a b")], "doc_id string, text string")
    assert [r.doc_id for r in bloom_dedup.exact_dedup(named).collect()] == ["c"]
    assert sorted((r.doc_id or "", r.keep_id, r.kept) for r in bloom_dedup.exact_groups(named).collect()) == [("", "c", False), ("b", "c", False), ("c", "c", True), ("x", "c", False)]


def test_covering_masks_cover():
    """Every pattern of up to four differing bits is blotted out by some mask."""
    rng = np.random.default_rng(1)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        d = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(d & (m & (1 << 64) - 1) == 0 for m in masks)


@pytest.mark.parametrize("radius", [4, 3])
@pytest.mark.parametrize("small", [2, 128])
def test_links(spark, radius, small):
    """A crowd of near fingerprints, both pair by pair and by balls."""
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 3, dtype=np.int64).tolist()
    fps = {0, -1, *centres}
    for c in centres:
        for _ in range(25):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), radius, small)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    want = brute.near_groups([f & (1 << 64) - 1 for f in fps], radius)
    assert [roots.get(f, f) for f in fps] == [fps[i] for i in want]


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, n + 1)} | {(1001, 1000)}


def test_near_groups(spark, sf_dir):
    rows = sorted(pairs(brute.documents(spark, sf_dir)))
    extra = [(5000 + i, t) for i, (_, t) in enumerate(pairs(brute.edge_rows()))]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(spark.createDataFrame(rows + extra, "doc_id bigint, text string")).collect()}
    fps = [brute.fingerprint(t) for _, t in rows + extra]
    groups = brute.near_groups(fps, 4)
    assert got == {d: (f"{f:016x}", (rows + extra)[g][0]) for (d, _), f, g in zip(rows + extra, fps, groups)}


def test_near_dedup(spark):
    df = brute.edge_frame(spark)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "7", "9", "10", "11", "11", "None"])
    assert simhash.near_dedup(brute.empty_frame(spark)).count() == 0


def test_index_marks_windows():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = [bytes(rng.choice(list(b"abc"), rng.integers(24, 46)).tolist()) for _ in range(3)]
        bodies = {*base, b"a" * 30, b"ab" * 14, b"a" * 24}
        for _ in range(12):
            x, p = base[rng.integers(3)], int(rng.integers(24))
            bodies.add(x[:p] + b"d" + x[p + 1:])
        bodies = list(bodies)
        seen = [b[i:i + 24] for b in bodies for i in range(len(b) - 23)]
        for b, flags in zip(bodies, run_index.marked(bodies, 24)):
            assert flags.tolist() == [seen.count(b[i:i + 24]) > 1 for i in range(len(b) - 23)]


@pytest.mark.parametrize("limits", [{}, {"crowd": 4, "block": 2000}])
def test_repeated_bytes(spark, sf_dir, limits):
    rows = pairs(brute.documents(spark, sf_dir))
    p = rows[3][1][:700]
    rows += [(900 + i, t) for i, t in enumerate(["", None, "a" * 3000, "ab" * 900, p + " q" * 100, rows[5][1][:len(rows[5][1]) // 2], "ü" * 500])]
    rows += [(2000 + i, f"{i} own words {i * i} " * 9 + p[:500] + f" tail {i} " * 10) for i in range(12)] + [rows[5]]
    got = run_index.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), keep_bytes=False, **limits)
    assert sorted(map(tuple, got.collect())) == sorted(brute.repeated_bytes(rows, 400))


def test_repeated_bytes_edges(spark):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in run_index.remove_repeats(brute.edge_frame(spark)).collect()}
    n = len(brute.LONG)
    assert {(4, 0, 0), (5, 0, 0), (7, n, n), (8, n + 4, n), (10, 5000, 5000)} <= got
    assert run_index.remove_repeats(brute.empty_frame(spark)).count() == 0


def test_repeated_lines(spark, sf_dir):
    rows = pairs(brute.documents(spark, sf_dir))
    rows += [(3000, "a\nb\nc"), (3001, "x\n a\n\nb \nc\ny"), (3002, "a\na\na\na\na\na\na"), (3003, None), (3004, "")] + [(4000 + i, f"top {i}\na\nb\nc\nend {i}") for i in range(30)]
    got = {r.doc_id: r.kept_text for r in line_winnowing.delete_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 3).collect()}
    assert got == brute.later_repeats(rows, 3)


def test_long_passages_on_few_lines(spark, sf_dir):
    """A run is RUN lines, or fewer with fifty words together."""
    def kept(rows):
        out = {}
        places = {d: [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for d, t in rows}
        gone = {d: set() for d, _ in rows}
        for run in (1, 2, 3):
            first = {}
            for d in sorted(places):
                for s in range(len(places[d]) - run + 1):
                    part = places[d][s:s + run]
                    key = tuple(x for _, x in part)
                    if run < 3 and sum(len(brute.WORDS.findall(x)) for x in key) < 50:
                        continue
                    a, b = first.setdefault(key, (d, s))
                    if a != d or s >= b + run:
                        gone[d].update(i for i, _ in part)
        for d, t in rows:
            out[d] = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d])
        return out
    words = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 50), ("b", 49), ("c", 30), ("d", 25))]
    rows = pairs(brute.documents(spark, sf_dir))
    rows += [(5000, words[0]), (5001, " " + words[0] + "\nown"), (5002, words[1]), (5003, words[1] + "\n"), (5004, f"{words[2]}\n\n{words[3]}"), (5005, f"x\n{words[2]}\n{words[3]}\ny"),
             (5006, f"{words[0]}\n{words[0]}\n{words[0]}"), (5007, None), (5008, "")]
    got = {r.doc_id: r.kept_text for r in line_winnowing.delete_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), long_words=50).collect()}
    assert got == kept(rows)
    assert [got[5000 + i] for i in range(6)] == [words[0], "own", words[1], words[1] + "\n", f"{words[2]}\n\n{words[3]}", "x\ny"] and got[5006] == ""


def test_repeated_lines_edges(spark):
    out = line_winnowing.delete_repeats(brute.edge_frame(spark))
    assert out.columns[-3:] == ["n_lines_", "n_removed", "kept_text_"] and out.count() == len(brute.edge_rows())
    long = {r.doc_id: r["kept_text_"] for r in out.collect() if r.doc_id in (7, 8)}
    assert long[7].count("\n") == 3 and hashlib.sha256(long[8].encode()).hexdigest() == hashlib.sha256(b"tail").hexdigest()
    assert line_winnowing.delete_repeats(brute.empty_frame(spark)).count() == 0
