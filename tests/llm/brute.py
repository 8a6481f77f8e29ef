"""Plain versions of the operators over lists of rows, and the rows of the edge-case tests."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from slipweave.llm import language, mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, row string, h bigint, id string, copy_no int, n_lines int, "
          "kept_text string, clean_text string, shuffle_key int, text_sha256 string")
LONG = "An ordinary sentence with some words in it and a number 42 at its end.\n" * 4000


def edge_rows():
    """Null, empty, blank and very long texts, ties, repeated rows, null ids, sources and languages."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    base = " ".join(words * 6)
    rows = [(1, base, "en", "a"), (2, base + " ", "en", "a"), (3, "  " + base, "de", "b"), (3, "  " + base, "de", "b"), (4, None, "en", None), (5, "", None, "a"),
            (6, " \n\t ", "xx", "b"), (7, LONG, "en", "a"), (8, LONG + "tail", "fr", "c.example.fr"), (None, "no id at all", "en", "a"), (9, "ünïcödé 日本語 👩 " * 40, "es", None),
            (10, "x" * 5000, "", ""), (11, "<|endoftext|> special", "en", "a"), (11, "same id other text", "de", "a")]
    return [(*r, len(r[1] or ""), True, "row", 1, "id", 1, 1, "k", "c", 1, "s") for r in rows]


def edge_frame(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_groups(rows):
    """(doc_id, keep_id, size, kept, digest) of (doc_id, text)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[normalised(t)].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        g = groups[normalised(t)]
        keep = min(g, key=lambda x: x[:3])[3]
        out.append((d, keep, len(g), d == keep, hashlib.sha256(normalised(t).encode()).hexdigest()))
    return out


def fingerprint(text, k=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(t)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def near_groups(fps, radius):
    """Component number of every fingerprint: the index of its first member."""
    f, parent = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f[:a] ^ f[a]) <= radius).tolist():
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(f))]


def repeated_bytes(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept digest) of (doc_id, text)."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i:i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def base_counts(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def later_repeats(rows, run):
    """Kept text of (doc_id, text) rows of different ids, in id order."""
    first, places = {}, {}
    for d, t in rows:
        lines = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n"))]
        places[d] = [(i, x) for i, x in lines if x]
    gone = defaultdict(set)
    for d in sorted(places):
        p = places[d]
        for s in range(len(p) - run + 1):
            key = tuple(x for _, x in p[s:s + run])
            a, b = first.setdefault(key, (d, s))
            if a != d or s >= b + run:
                gone[d].update(i for i, _ in p[s:s + run])
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]) for d, t in rows}


def posterior(rows, languages):
    """Brute-force version of the fusion over (id, text, declared, host)."""
    k = len(languages)
    grams = []
    for _, t, _, _ in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        parts = [b for b, _ in language.trigrams(data, np.array([0, len(data)]))]
        grams.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    table = np.full((k, language.BUCKETS), language.ALPHA)
    for (_, _, d, _), g in zip(rows, grams):
        if d in languages:
            np.add.at(table[languages.index(d)], g, 1)
    logp = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    ll = [np.round(np.array([p[g].astype(float).sum() for p in logp]) * min(1.0, language.TEMPER / max(len(g), 1)), 6) for g in grams]
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    own = [np.round(soft(v) * language.UNIT) if len(g) else np.zeros(k) for v, g in zip(ll, grams)]
    one = [1 if len(g) else 0 for g in grams]
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1] if "." in h else ""

    def sums(key):
        n, s = Counter(), {}
        for (_, _, _, h), o, u in zip(rows, one, own):
            if h is not None:
                n[key(h)] += o
                s[key(h)] = s.get(key(h), 0) + u
        return n, s
    levels = [sums(f) for f in (lambda h: 0, suffix, domain, lambda h: h)]
    corpus = (levels[0][1].get(0, np.zeros(k)) / language.UNIT + 1) / (levels[0][0][0] + k)
    out = {}
    for (i, _, d, h), v, o, u in zip(rows, ll, one, own):
        p = corpus
        if h is not None:
            for (n, s), key, minus, mu in ((levels[1], suffix(h), 0, 0), (levels[2], domain(h), 0, 0), (levels[3], h, o, u)):
                if n[key]:
                    p = ((s[key] - mu) / language.UNIT + language.PSEUDO * p) / (n[key] - minus + language.PSEUDO)
        score = v + np.log(p)
        for sign, trust in ((d, language.DECLARED_TRUST), (language.SUFFIXES.get(suffix(h or "")), language.SUFFIX_TRUST)):
            if sign in languages:
                score = score + np.array([math.log(trust if x == sign else (1 - trust) / (k - 1)) for x in languages])
        q = soft(score)
        out[i] = (languages[int(q.argmax())] if o else "und", float(q.max()) if o else 0.0)
    return out


def poisson(rate, seed, key):
    parts, total = max(1, math.ceil(rate / mixing.PART)), 0
    for i in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}|{key}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        p = c = math.exp(-rate / parts)
        n = 0
        while c <= u and n < mixing.TERMS:
            n += 1
            p *= rate / parts / n
            c += p
        total += n
    return total


def mixing_rates(rows, weights, other, epochs=1.0):
    """Repetition rate of every source of (doc_id, text, source)."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode()) + 1
    rest = sum(n for s, n in size.items() if s not in weights)
    budget = epochs * sum(size.values()) / (sum(w for s, w in weights.items() if s in size) + (other if rest else 0))
    return {s: weights[s] * budget / n if s in weights else other * budget / rest for s, n in size.items()}
