"""Quality rules by distribution divergence.

Each text is compared with a reference of its declared language in two ways: the histogram of its character classes, and the
histogram of the language's common words with all other words as one class. Both comparisons are Jensen-Shannon distances (base
2, so between 0 and 1). The references are sums over all texts of the language; rows without a language use the reference of the whole
corpus. Common words hold at least 1/COMMON of the words of their language, so a language has at most COMMON of them. References of languages
with at least 1/MIN_SHARE of all words, fewer than MIN_SHARE at any size, go to all tasks; those of all other languages, as many as there are, are a
written table that only their rows meet.

A distance counts only above a minimum length: MIN_CHARS characters for character classes, MIN_WORDS words for common words. The
base rules judge words, symbols, repeated lines and repeated three-word windows. Null counts as empty: no words, so the base rules fail it.
Words are separated by ASCII blanks. Repeated rows are judged alike, and each counts in the references.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from slipweave.llm.common import attach, column, documents, stored
from slipweave.llm.registry import query

#: Largest distances that pass.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45
MIN_CHARS, MIN_WORDS = 300, 60
COMMON, MIN_SHARE = 256, 64
MIN_BASE_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Different words that a task counts before it hands its counts on.
HELD_WORDS = 200_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = ["lower", "upper", "digit", "blank", "stop", "symbol", "control", "other"]
SYMBOLS = "#*$%&|<>"
ALL = ""


def _class_table() -> np.ndarray:
    """Class of every byte of a UTF-8 text; bytes of characters beyond ASCII are their own class."""
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = CLASSES.index("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "blank" if c in " \t\n\r\x0b\x0c"
                                 else "control" if b < 32 or b == 127 else "symbol" if c in SYMBOLS + "^~`\\{}[]@_=+/" else "stop")
    return table


CLASS_OF = _class_table()


def char_classes(data: bytes) -> np.ndarray:
    """Counts of the classes; a character beyond ASCII counts once for each of its bytes."""
    out, view = np.zeros(len(CLASSES), np.int64), np.frombuffer(data, np.uint8)
    for lo in range(0, len(view), 1 << 20):
        out += np.bincount(CLASS_OF[view[lo:lo + (1 << 20)]], minlength=len(CLASSES))
    return out


def normal(word: str) -> str:
    """A word as the references count it: lower case without stops at its ends."""
    return word.strip(".,;:!?\"'()").lower()


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORDS.search(line):
            seen.add(line)
    repeat, n = 0, len(words)
    if n > 3:
        ids = {}
        code = [ids.setdefault(w, len(ids)) for w in words]
        a = np.array(code, dtype=np.int64)
        if len(ids) < 1 << 20:
            window = (a[:-2] << 40) | (a[1:-1] << 20) | a[2:]
        else:
            pair = np.unique(np.stack([a[:-2], a[1:-1]], axis=1), axis=0, return_inverse=True)[1].astype(np.int64)
            window = np.unique(np.stack([pair.ravel(), a[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(n, bool)
        hit = np.zeros(len(window), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        for k in range(3):
            twice[k:k + len(window)] |= hit
        repeat = int(twice.sum())
    return sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(lang, kind, item, n): sums over all texts (lang, text) per language and for the whole; kind is 'word' or 'class'."""
    import pyarrow as pa

    def told(words: dict, classes: dict) -> Iterator:
        lang, kind, item, n = [], [], [], []
        for x, counter in words.items():
            lang += [x] * len(counter)
            kind += ["word"] * len(counter)
            item += counter
            n += counter.values()
        for x, counts in classes.items():
            lang += [x] * len(CLASSES)
            kind += ["class"] * len(CLASSES)
            item += CLASSES
            n += counts.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(item, pa.string()), pa.array(n, pa.int64())], names=["lang", "kind", "item", "n"])

    def run(batches: Iterator) -> Iterator:
        words, classes = {}, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                words.setdefault(lang, Counter()).update(WORDS.findall(text))
                classes[lang] = classes.get(lang, 0) + char_classes(text.encode())
                if sum(map(len, words.values())) > HELD_WORDS:
                    yield from told(words, classes)
                    words, classes = {}, {}
        yield from told(words, classes)
    one = texts.select(F.coalesce("lang", F.lit(ALL)).alias("lang"), "text").mapInArrow(run, "lang string, kind string, item string, n bigint")
    plain = F.when(F.col("kind") == "word", F.lower(F.trim(F.col("item"), F.lit(".,;:!?\"'()")))).otherwise(F.col("item"))
    return one.groupBy("lang", "kind", plain.alias("item")).agg(F.sum("n").alias("n"))


def reference(classes: dict[str, int], own: dict[str, int], total: int) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """Class counts, places of the common words, and their counts with those of all other words at the end."""
    return np.array([classes.get(c, 0) for c in CLASSES], float), {w: i for i, w in enumerate(own)}, np.array([*own.values(), total - sum(own.values())], float)


def rare_references(counts: DataFrame, held: list[str]) -> DataFrame:
    """(lang, total, words, classes): one row per language that is not held."""
    rest = counts.filter(~F.col("lang").isin(*held, ALL))
    totals = rest.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("kind") == "word", F.col("n"))), F.lit(0)).alias("total"))
    pair = F.struct((-F.col("n")).alias("n"), "item")
    chosen = rest.join(totals, "lang").filter((F.col("kind") == "class") | ((F.col("n") * COMMON >= F.col("total")) & (F.col("item") != "")))
    return chosen.groupBy("lang", "total").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "word", pair))).alias("words"), F.collect_list(F.when(F.col("kind") == "class", pair)).alias("classes"))


def references(texts: DataFrame, counts: DataFrame | None = None) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """The references of the languages with at least 1/MIN_SHARE of all words, and of the whole; ``counts`` are the stored corpus counts."""
    counts = stored(corpus_counts(texts)) if counts is None else counts
    sums = counts.filter("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("total"))
    whole = sums.agg(F.sum("total")).first()[0] or 0
    large = sums.filter((F.col("total") >= max(1, whole // MIN_SHARE)) & (F.col("lang") != ALL))
    totals = {r["lang"]: r["total"] for r in large.collect()} | {ALL: whole}  # fewer than MIN_SHARE languages
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, n / COMMON)])
    per = counts.filter(F.col("lang").isin(*totals) & (F.col("lang") != ALL))
    pooled = counts.groupBy("kind", "item").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "kind", "item", "n")
    chosen = per.select("lang", "kind", "item", "n").unionByName(pooled).filter((F.col("kind") == "class") | ((F.col("n") >= share[F.col("lang")]) & (F.col("item") != "")))
    out = {}
    rows = sorted(chosen.collect(), key=lambda r: (r["lang"], r["kind"], -r["n"], r["item"]))  # at most COMMON words a language
    for lang, total in totals.items():
        own = {r["item"]: r["n"] for r in rows if r["lang"] == lang and r["kind"] == "word"}
        classes = {r["item"]: r["n"] for r in rows if r["lang"] == lang and r["kind"] == "class"}
        out[lang] = reference(classes, own, total)
    return out


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept: one row per row of docs.

    A distance is null below its minimum length and then judges nothing.
    """
    import pyarrow as pa

    given = docs.select(column(doc_id).alias("doc_id"), column(lang).alias("lang"), column(text).cast("string").alias("text"))
    counts = stored(corpus_counts(given.select("lang", "text")))
    refs = references(given.select("lang", "text"), counts)
    held = [x for x in refs if x != ALL]
    plain = F.col("lang").isNull() | F.col("lang").isin(*held, ALL)
    rare = given.filter(~plain)
    sizes = rare.groupBy("lang").agg(F.count("*").alias("rows"))
    table = stored(rare_references(counts, held).join(sizes, "lang").select("lang", "rows", F.struct("total", "words", "classes").alias("ref")))
    met = attach(rare, table, ["lang"], "rows", table.agg(F.sum("rows")).first()[0] or 0).select("doc_id", "lang", "text", "ref")
    given = given.filter(plain).withColumn("ref", F.lit(None).cast(dict(table.dtypes)["ref"])).unionByName(met)

    def row_of(ref: tuple, text: str) -> tuple:
        words = WORDS.findall(text)
        n = len(words)
        chars, n_symbols, dup, repeat = base_counts(text, words)
        classes, common, counted = ref
        char = word = None
        if len(text) >= MIN_CHARS:
            char = round(distance(char_classes(text.encode()).astype(float), classes), 9)
        if n >= MIN_WORDS:
            own, place = np.zeros(len(counted)), common.get
            for w, k in Counter(words).items():
                own[place(normal(w), -1)] += k
            word = round(distance(own, counted), 9)
        failed = n < MIN_BASE_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * n
        return n, chars, n_symbols, dup, repeat, char, word, failed, not failed and (char is None or char <= max_char) and (word is None or word <= max_word)

    fields = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
              ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]

    rest: dict = {}

    def ref_of(lang: str | None, own) -> tuple:
        if not own.is_valid:
            return refs.get(lang, refs[ALL])
        if lang not in rest:
            if len(rest) > MIN_SHARE:
                rest.clear()
            r = own.as_py()
            rest[lang] = reference({c["item"]: -c["n"] for c in r["classes"]}, {w["item"]: -w["n"] for w in r["words"]}, r["total"])
        return rest[lang]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            given_refs = zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)
            rows = [row_of(ref_of(x, ref), t.as_py() or "") for x, t, ref in given_refs]
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], t) for _, t in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *[f for f, _ in fields]])
    kinds = {pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}
    return given.mapInArrow(run, f"doc_id {dict(given.dtypes)['doc_id']}, " + ", ".join(f"{n} {kinds[t]}" for n, t in fields))


@query("op4_divergence_rules")
def op4_divergence_rules(spark, sf_dir):
    return judge(documents(spark, sf_dir))
