"""Helpers shared by the operators: stored intermediate tables, hot-key-safe lookups, byte-bounded Arrow batches."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot keys at any size.
HOT_SHARE = 512
#: Bytes of text that one Arrow function works on at a time.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage is cut and lost executors cost nothing."""
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of df has the same one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of one-row-per-key ``groups`` to ``rows``; keys are never null.

    Keys with more than 1/HOT_SHARE of all rows are fewer than HOT_SHARE, whatever the size of the data: they are
    broadcast and their rows stay where they are. The rows of all other keys meet in a shuffle, where no key is large.
    ``groups`` is read twice and should be a stored table.
    """
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(count) > limit))
    cold = groups.filter(F.col(count) <= limit)
    near = rows.join(hot, keys, "inner")
    far = rows.join(F.broadcast(groups.filter(F.col(count) > limit).select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return near.unionByName(far)


def sieve(rows: DataFrame, keys: DataFrame, by: list[str], n_keys: int, max_words: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(may, rest): the rows whose columns ``by`` may be among those of the stored ``keys``, and those that surely are not.

    The keys set three bits each in a blocked Bloom filter of at most ``max_words`` 64-bit words, which is broadcast; so wide rows without a key need not be
    shuffled to learn it. Where the keys outgrow the filter, more rows count as possible ones.
    """
    words = 1
    while words < max_words and words * 64 < n_keys * 16:
        words *= 2

    def bits(df: DataFrame) -> DataFrame:
        at, mask = F.xxhash64(F.lit(11), *by), F.xxhash64(F.lit(13), *by)
        three = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {k * 6}) & 63 as int))") for k in range(3)]
        out = df.withColumn("_h", mask).withColumn("_word", F.pmod(at, F.lit(words)))
        return out.withColumn("_mask", three[0].bitwiseOR(three[1]).bitwiseOR(three[2])).drop("_h")
    held = stored(bits(keys.select(*by)).groupBy("_word").agg(F.bit_or("_mask").alias("_set")))
    met = bits(rows).join(F.broadcast(held), "_word", "left")
    there = F.coalesce(F.col("_set").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return met.filter(there).select(*rows.columns), met.filter(~there).select(*rows.columns)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def buffer_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset:]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blank_free(text: Column) -> Column:
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    out = F.coalesce(text, F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c), F.lit(""))
    return out
