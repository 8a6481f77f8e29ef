"""Ordered work that never needs a whole group in one task.

A position column (an integer) is cut into blocks of fixed width. Work that looks a few rows around runs per
block with the bordering rows copied in; running totals and ordinals add the totals of the earlier blocks, which
are one row per block.

No row is lost: NULL keys form a group of their own, and NULL positions come before all others. Rows with equal
positions follow in the order of a hash of their columns, the same in every helper that gets the same columns.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 1 << 16
#: Largest groups whose values are broadcast: a fixed number of rows.
HOT_GROUPS = 512


def block_of(pos: str, block: int) -> Column:
    return F.floor(F.col(pos) / F.lit(block)).cast("bigint")


def _order(df: DataFrame, pos: str, then: list[str] | None = None) -> list[Column]:
    return [F.col(pos).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in then or []], F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])]


def _meet(rows: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe inner join of rows and their blocks' offsets on keys and block; the offsets' keys are dropped."""
    renamed = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_blk"]], *[c for c in offsets.columns if c not in [*keys, "_blk"]])
    same = F.lit(True)
    for k in [*keys, "_blk"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(renamed, same).drop(*[f"_k_{k}" for k in [*keys, "_blk"]])


def with_neighbours(df: DataFrame, keys: list[str], pos: str, before: int, after: int, exprs: dict,
                    block: int = BLOCK) -> DataFrame:
    """Adds ``exprs`` (name -> function of an ordered window) computed from at most ``before`` rows above
    and ``after`` rows below. Positions must be consecutive within the keys."""
    lo, hi = F.floor((F.col(pos) - after) / block), F.floor((F.col(pos) + before) / block)
    copies = df.withColumn("_blk", F.explode_outer(F.sequence(lo, hi)))
    w = W.partitionBy(*keys, "_blk").orderBy(*_order(df, pos))
    out = copies.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
    return out.filter(F.col("_blk").eqNullSafe(block_of(pos, block))).drop("_blk")


def running_total(df: DataFrame, keys: list[str], pos: str, totals: dict, block: int = BLOCK,
                  exclusive: bool = False) -> DataFrame:
    """Adds running sums (name -> Column) in ``pos`` order; ``exclusive`` leaves the row itself out."""
    b = df.withColumn("_blk", block_of(pos, block)).select("*", *[c.alias(f"_v_{n}") for n, c in totals.items()])
    per_block = b.groupBy(*keys, "_blk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    earlier = W.partitionBy(*keys).orderBy(F.col("_blk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "_blk", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}")
                                                for n in totals])
    frame = W.partitionBy(*keys, "_blk").orderBy(*_order(df, pos)).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    joined = _meet(b, offsets, keys)
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0))).alias(n)
                                        for n in totals])


def running_max_before(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """Adds the maximum of ``value`` over all earlier positions (NULL for the first)."""
    b = df.withColumn("_blk", block_of(pos, block)).withColumn("_v", value)
    per_block = b.groupBy(*keys, "_blk").agg(F.max("_v").alias("_m"))
    earlier = W.partitionBy(*keys).orderBy(F.col("_blk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "_blk", F.max("_m").over(earlier).alias("_o"))
    frame = W.partitionBy(*keys, "_blk").orderBy(*_order(df, pos)).rowsBetween(W.unboundedPreceding, -1)
    return _meet(b, offsets, keys).select(
        *df.columns, F.greatest(F.col("_o"), F.max("_v").over(frame)).alias(out))


def with_ordinal(df: DataFrame, pos: str, out: str, keys: list[str] | None = None, block: int = 1 << 20,
                 then: list[str] | None = None) -> DataFrame:
    """Adds 1..n in the order of ``pos`` and the ``then`` columns, per ``keys`` or over the whole table, without a single-task sort."""
    keys = keys or []
    b = df.withColumn("_blk", block_of(pos, block))
    counts = b.groupBy(*keys, "_blk").agg(F.count("*").alias("_c"))
    earlier = W.partitionBy(*keys).orderBy(F.col("_blk").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_blk", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    within = F.row_number().over(W.partitionBy(*keys, "_blk").orderBy(*_order(df, pos, then)))
    return _meet(b, offsets, keys).select(*df.columns, (F.col("_o") + within).cast("bigint").alias(out))


def lookup(fact: DataFrame, groups: DataFrame, keys: list[str], applies: Column, count: str, spread_by: str,
           hot: int = HOT_GROUPS) -> DataFrame:
    """Left join of per-group values back to rows.

    The ``hot`` largest groups are broadcast, so their rows stay where they are; every other group has at most 1/hot of the
    grouped rows and meets them in a shuffle. Rows the lookup does not apply to are spread by ``spread_by`` instead
    of meeting on one NULL key.
    """
    values = [c for c in groups.columns if c not in keys and c != count]
    largest = groups.orderBy(F.col(count).desc(), *keys).limit(hot)
    big = largest.select(*keys, *[F.col(v).alias(f"_big_{v}") for v in values], F.lit(True).alias("_hot"))
    small = groups.select(*keys, F.lit(-1).cast("bigint").alias("_salt"), *values)
    flagged = fact.withColumn("_applies", F.coalesce(applies, F.lit(False)))
    first = flagged.join(F.broadcast(big), keys, "left")
    direct = F.col("_applies") & F.col("_hot").isNull()
    salted = first.withColumn("_salt", F.when(direct, F.lit(-1)).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(4096))).cast("bigint"))
    joined = salted.join(small, [*keys, "_salt"], "left")
    return joined.select(*fact.columns, *[F.when(F.col("_applies"), F.coalesce(F.col(v), F.col(f"_big_{v}"))).alias(v)
                                          for v in values])


def reachable(successors: DataFrame, starts: DataFrame, keys: list[str], at: str, to: str, written: bool = False, doublings: int = 3) -> DataFrame:
    """(keys, at): the starts and all that follows them along ``successors`` (keys, at, to), which has one row per place and only leads on.

    Steps of doubled length are taken from all places found so far, so a chain of n places takes about log2(n) rounds of
    joins over narrow rows, and no chain is followed in one task. ``doublings`` rounds are one job, whose results are written. Successors that come from a
    ``written`` table are not written again.
    """
    from slipweave.sources.sinks import materialize

    jump, seen = successors.select(*keys, at, to), starts.select(*keys, at)
    if not written:
        jump, seen = materialize(jump), materialize(seen)
    while not jump.isEmpty():
        for _ in range(doublings):
            seen = seen.unionByName(seen.join(jump, [*keys, at]).select(*keys, F.col(to).alias(at)))
            further = jump.select(*keys, F.col(at).alias(to), F.col(to).alias("_further"))
            jump = jump.join(further, [*keys, to]).select(*keys, at, F.col("_further").alias(to))
        seen, jump = materialize(seen.distinct()), materialize(jump)
    return seen.distinct()
