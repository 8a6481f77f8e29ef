"""Exact dedup by two passes over a Bloom filter.

Pass 1 hashes every text and counts, per bit of a blocked Bloom filter (64-bit words, three bits of one word per hash), how
many rows set it; bits set by two rows or more form the filter. Pass 2 tests every row: a row with one of its bits set only
once is surely unique and passes straight through; only the rest is shuffled and compared by its SHA-256 digest, so false
positives cost a little shuffle and never a wrong result. The filter is broadcast; MAX_WORDS bounds it at any input size. When a
corpus outgrows it, more rows count as possibly repeated and the result stays the same.

Texts are equal when identical without ASCII blanks; null counts as empty, so null, empty and blank texts are one group.
Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id; a null
doc_id sorts last. Ids may be of any type that can be ordered. Of rows that share a doc_id and differ in blanks only the one that stays is kept. Rows that share
doc_id and text count in group_size; the survivors hold such a row once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave.llm.common import attach, blank_free, column, documents, stored
from slipweave.llm.registry import query

#: 64-bit words of the broadcast filter at most (8 MB of bits).
MAX_WORDS = 1 << 20
#: Bits per row while the filter is below its bound.
BITS_PER_ROW = 16


def _hashed(df: DataFrame, digest: str, words: int) -> DataFrame:
    """Adds _word, the word of the filter, and _mask, the bits within it."""
    h = F.xxhash64(digest)
    bits = F.xxhash64(F.col(digest), F.lit(7))
    mask = F.lit(0).cast("bigint")
    for k in range(3):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_bits, {k * 6}) & 63 as int))"))
    return df.withColumn("_bits", bits).withColumn("_word", F.pmod(h, F.lit(words))).withColumn("_mask", mask).drop("_bits")


def repeat_filter(keys: DataFrame, digest: str, words: int) -> DataFrame:
    """Pass 1: (_word, _twice), the bits that two rows or more set; at most ``words`` rows."""
    set_bits = F.expr("filter(sequence(0, 63), b -> (shiftright(_mask, b) & 1L) = 1L)")
    counted = _hashed(keys.select(digest), digest, words).select("_word", F.explode(set_bits).alias("_b")).groupBy("_word", "_b").count()
    return (counted.filter("count > 1").groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("_twice")))


def _tested(df: DataFrame, digest: str, words: int, twice: DataFrame) -> DataFrame:
    """Pass 2: adds _maybe, false only for rows whose digest occurs once."""
    met = _hashed(df, digest, words).join(F.broadcast(twice), "_word", "left")
    maybe = F.coalesce(F.col("_twice").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return met.withColumn("_maybe", maybe).drop("_word", "_mask", "_twice")


def dedup_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_code_points, h (a hash of the original text), text_sha256 of every row: all that the comparison needs."""
    return docs.select(column(doc_id).alias("doc_id"), _code_points(column(text)).alias("n_code_points"), F.xxhash64(column(text)).alias("h"),
                       F.sha2(blank_free(column(text)), 256).alias("text_sha256"))


def _code_points(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")


def filter_words(n_rows: int, max_words: int = MAX_WORDS) -> int:
    words = 1
    while words < max_words and words * 64 < n_rows * BITS_PER_ROW:
        words *= 2
    return words


def _first() -> Column:
    """Order of the row that stays: most code points, then smallest doc_id, then the hash of the original text."""
    return F.struct((-F.col("n_code_points")).alias("less"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    keys = stored(dedup_keys(docs, doc_id, text))
    total = keys.count()
    words = filter_words(total, max_words)
    tested = _tested(keys, "text_sha256", words, stored(repeat_filter(keys, "text_sha256", words)))
    straight = tested.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = tested.filter("_maybe").drop("_maybe")
    groups = stored(maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(_first()).alias("_top"))
                    .select("text_sha256", "group_size", F.col("_top.doc_id").alias("keep_id"), F.col("_top.h").alias("keep_h")))
    met = attach(maybe, groups, ["text_sha256"], "group_size", total)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))
    return straight.unionByName(met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of docs that stay, with their columns. Rows that are surely unique are not shuffled."""
    keys = stored(dedup_keys(docs, doc_id, text))
    words = filter_words(keys.count(), max_words)
    twice = stored(repeat_filter(keys, "text_sha256", words))
    wide = docs.select(F.struct("*").alias("row"), column(doc_id).alias("id"), F.xxhash64(column(text)).alias("h"), F.sha2(blank_free(column(text)), 256).alias("sha"))
    tested = _tested(wide, "sha", words, twice)
    winners = (_tested(keys, "text_sha256", words, twice).filter("_maybe").groupBy("text_sha256").agg(F.min(_first()).alias("_top"))
               .select(F.col("text_sha256").alias("sha"), F.col("_top.doc_id").alias("keep"), F.col("_top.h").alias("keep_h")))
    straight = tested.filter(~F.col("_maybe")).select("row.*")
    # rows are shuffled by digest and id, so the copies of one text do not meet in one task
    candidates = tested.filter("_maybe").select("row", "id", "h", "sha").alias("c")
    chosen = candidates.join(winners.alias("w"), F.expr("c.sha = w.sha and c.id <=> w.keep and c.h = w.keep_h"), "left_semi")
    return straight.unionByName(chosen.dropDuplicates(["sha", "id"]).select("row.*"))


@query("op7_exact_dedup", """
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""")
def op7_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir))
