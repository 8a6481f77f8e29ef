"""The trie of conversation prefixes against a plain dictionary of prefixes."""
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from slipweave.llm import prefix_trie
from slipweave.llm.registry import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, p string, q string, own int, h int, at int, path string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "q", 1, 1, 1, "x") for r in rows], SCHEMA).repartition(3)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + v[h:]
    return out


def trie(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in paths.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    return sorted([(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()], key=str)


def got(df):
    return sorted([tuple(r[n] for n in NAMES) for r in df.collect()], key=str)


def conversations(rng, n, depth):
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, depth + 1))):
            rows.append((c, 3 * t, ["user", "assistant"][t % 2], f"turn {t} of kind {rng.integers(0, 2 if t < 3 else 3)} " + "word " * int(rng.integers(0, 2))))
    return rows


@pytest.mark.parametrize("band", [2, 3, 8])
def test_trie(spark, band):
    """Bands from one to many levels give the same totals."""
    rows = conversations(np.random.default_rng(band), 90, 13)
    turns = prefix_trie.numbered_turns(frame(spark, rows))
    assert got(prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), band)) == trie(rebuilt(rows))


def test_deep_conversation_and_copies(spark, monkeypatch):
    """One conversation with most turns, a crowd of copies whose digest is streamed in pieces, and shorter copies that end inside of them."""
    monkeypatch.setattr(prefix_trie, "ENDS", 16)
    rows = [(20 * 50, t, "user", f"long {t}") for t in range(150)]
    rows += [(c, t, "user", f"same {t} text") for c in range(1, 121) for t in range(2 + (c % 3))]
    turns = prefix_trie.numbered_turns(frame(spark, rows))
    assert got(prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), 4)) == trie(rebuilt(rows))


def test_edges(spark):
    """Null ids, turns, roles and texts, repeated rows, ties, very long texts, and conversations that are left without turns."""
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "a b"), (0, 0, "user", "a b"), (0, 0, "system", "z"), (0, None, "user", ""),
            (1, 5, "user", "only"), (2, 1, None, "x " * 100_000), (2, 2, "", "x"), (40, 1, "user", " \n\t"), (41, 1, "user", "first"), (41, 2, "user", "second"),
            *((c, 1, "user", "single") for c in range(60, 80)), *((c, 1, "user", "orphan") for c in range(101, 112))]
    paths = rebuilt(rows)
    assert any(not v for v in paths.values())
    turns = prefix_trie.numbered_turns(frame(spark, rows))
    assert got(prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns))) == trie(paths)


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect() == []
