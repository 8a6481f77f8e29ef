"""Fuzzy verification of scanned bank names against the alias table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave import rules as R
from slipweave.functions.text import let

_KEEP = r"[^A-Za-z0-9_\sก-๙]"


def repaired(col: Column) -> Column:
    """Lower case, ordered scan repairs, punctuation removed, leading word for bank removed."""
    out = F.lower(F.coalesce(col, F.lit("")))
    for pattern, replacement in R.TYPO_REPAIRS:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.trim(F.regexp_replace(F.regexp_replace(out, _KEEP, ""), r"\s+", " "))
    return F.trim(F.regexp_replace(out, "^ธนาคาร", ""))


def _repair_text(text: str) -> str:
    import re
    out = text.lower()
    for pattern, replacement in R.TYPO_REPAIRS:
        out = re.sub(pattern, replacement, out)
    out = re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9_\sก-๙]", "", out)).strip()
    return out.removeprefix("ธนาคาร").strip()


def alias_rows() -> list[tuple]:
    """(ord, display, kind, text, limit): the alias table, texts repaired like the input."""
    rows = []
    for i, (abbreviations, thai, english, keywords) in enumerate(R.BANK_ALIASES):
        display = f"{abbreviations[0]} ({thai})"
        rows += [(i, display, "abbr", a.upper()) for a in abbreviations]
        rows += [(i, display, "keyword", _repair_text(k)) for k in keywords]
        rows += [(i, display, "name", _repair_text(thai)), (i, display, "name", _repair_text(english))]
    return rows


def bigrams(c: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(F.filter(pairs, lambda g: F.length(g) == 2))


def similarity(a: Column, b: Column) -> Column:
    """The better of edit similarity and bigram overlap."""
    edit = F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    grams = let(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")), lambda g: F.size(F.array_intersect(g["a"], g["b"]))
                / F.nullif(F.size(F.array_union(g["a"], g["b"])), F.lit(0)))
    return F.greatest(edit, F.coalesce(grams, F.lit(0.0)))


def verify_banks(df: DataFrame, text: str) -> DataFrame:
    """Adds ``bank_display`` and ``bank_confidence``.

    The distinct bank texts are scored once and joined back. The alias table is a constant array inside the
    row; the costly fuzzy step runs only for texts no keyword settles.
    """
    distinct = df.select(F.coalesce(text, F.lit("")).alias("_text")).distinct().withColumn("_in", repaired(F.col("_text")))
    table = F.expr("array(" + ", ".join(
        f"named_struct('neg', {-i}, 'display', '{d}', 'kind', '{k}', 'text', '{t}')" for i, d, k, t in alias_rows()) + ")")

    def best(rows, score):
        return F.array_max(F.transform(rows, lambda r: F.struct(score(r).alias("score"), r["neg"].alias("neg"), r["display"].alias("display"))))

    def listed(r):
        hit = F.contains(F.col("_in"), r["text"])
        return (F.when(r["kind"] == "abbr", F.when(F.upper("_in") == r["text"], 1000).otherwise(0))
                .when(r["kind"] == "keyword", F.when(hit, 60 + 2 * F.length(r["text"])).otherwise(0))
                .otherwise(F.when(hit | F.contains(r["text"], F.col("_in")), 100).otherwise(0)))

    def fuzzy(r):
        near = let(similarity(F.col("_in"), r["text"]), lambda v: F.when(v >= 0.65, F.floor(v * 100)).otherwise(0).cast("int"))
        return F.when((r["kind"] == "abbr") | (F.length(r["text"]) < 3), 0).otherwise(near)
    keyed = distinct.withColumn("_aliases", table).withColumn("_key", best(F.col("_aliases"), listed))
    full = keyed.withColumn("_fuzzy", F.when(F.col("_key.score") < 60, best(F.col("_aliases"), fuzzy)))
    chosen = full.withColumn("_best", F.when(F.col("_fuzzy.score") > F.col("_key.score"), F.col("_fuzzy")).otherwise(F.col("_key")))
    accepted = (F.col("_in") != "") & (F.col("_best.score") > 40)
    confidence = F.when(~accepted, 0).when(F.col("_best.score") == 1000, 100).otherwise(F.least(F.col("_best.score"), F.lit(99)))
    scored = chosen.select("_text", confidence.alias("bank_confidence"), F.when(accepted, F.col("_best.display")).when(
        F.col("_text") == "", "Unknown Bank").otherwise(F.col("_text")).alias("bank_display"))
    return df.join(scored, F.coalesce(df[text], F.lit("")) == scored["_text"], "left").drop("_text")
