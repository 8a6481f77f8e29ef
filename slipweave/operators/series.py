"""Row series: smoothing, runs, bands, cuts. A series is (series_id, y, activity, ...) with y = 0, 1, 2, ...

No step gathers a whole series in one task; see ``ordered`` for how positions are cut into blocks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from slipweave.operators.ordered import BLOCK, running_max_before, running_total, with_neighbours, with_ordinal
from slipweave.sources.sinks import materialize

KEY = ["series_id"]
#: Sums between positions are differences of running totals, so values are summed as whole millionths.
UNIT = 1_000_000
WEIGHTS = {-2: 1, -1: 2, 0: 3, 1: 2, 2: 1}


def _shift(column: str, offset: int, w) -> Column:
    return F.lag(column, -offset).over(w) if offset < 0 else F.lead(column, offset).over(w) if offset else F.col(column)


def smooth_weighted(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """1-2-3-2-1 moving average, weights renormalised at the ends."""
    def value(w):
        total, weight = F.lit(0.0), F.lit(0)
        for off, k in WEIGHTS.items():
            v = _shift("activity", off, w)
            total = total + F.coalesce(v * k, F.lit(0.0))
            weight = weight + F.when(v.isNotNull(), k).otherwise(0)
        return total / weight
    return with_neighbours(rows, KEY, "y", 2, 2, {"smooth": value}, block)


def smooth_box(rows: DataFrame, reach: int = 5, block: int = BLOCK) -> DataFrame:
    """Mean of the rows within ``reach``, clipped at the ends."""
    def value(w):
        near = w.rowsBetween(-reach, reach)
        return F.sum("activity").over(near) / F.count("activity").over(near)
    return with_neighbours(rows, KEY, "y", reach, reach, {"smooth": value}, block)


def edge_delta(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    return with_neighbours(rows, KEY, "y", 1, 0, {"edge": lambda w: F.coalesce(
        F.abs(F.col("activity") - F.lag("activity").over(w)), F.lit(0.0))}, block)


def matrix_row_stats(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population variance (mean of squares minus squared mean) per matrix row."""
    g = cells.groupBy(*keys).agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"), F.count(value).alias("cells"))
    mean = F.col("_s").cast("double") / F.col("cells")
    return g.select(*keys, "cells", mean.alias("avg"), (F.col("_q").cast("double") / F.col("cells") - mean * mean).alias("variance"))


def runs(rows: DataFrame, flag: Column, block: int = BLOCK, widest: str | None = None) -> DataFrame:
    """series_id, start, end (inclusive), rows of the maximal runs of flagged positions, and ``span``, the maximum of the column ``widest``."""
    more = [] if widest is None else [F.col(widest).alias("_wide")]
    hit = with_ordinal(rows.filter(flag).select(*KEY, "y", *more), "y", "_n", KEY, block)
    return (hit.groupBy(*KEY, (F.col("y") - F.col("_n")).alias("_island")).agg(
        F.min("y").alias("start"), F.max("y").alias("end"), F.count("*").alias("rows"), *[F.max("_wide").alias("span") for _ in more]).drop("_island"))


def series_length(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg((F.max("y") + 1).alias("height"))


def merge_gaps(intervals: DataFrame, gap: int, block: int = BLOCK) -> DataFrame:
    """Joins neighbouring intervals whose start is at most ``gap`` after the furthest end so far. Intervals with one start
    are one row from the beginning; ``parts`` still counts each."""
    starts = intervals.groupBy(*KEY, "start").agg(F.max("end").alias("end"), F.count("*").alias("_parts"))
    reach = running_max_before(starts, KEY, "start", F.col("end"), "_reach", block)
    fresh = F.when(F.col("_reach").isNull() | (F.col("start") - F.col("_reach") > gap), 1).otherwise(0)
    grouped = running_total(reach, KEY, "start", {"_g": fresh}, block)
    return grouped.groupBy(*KEY, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                           F.sum("_parts").alias("parts")).drop("_g")


def totals_between(rows: DataFrame, spans: DataFrame, values: dict, block: int = BLOCK) -> DataFrame:
    """Adds sums of ``values`` over the rows [start, end] of each span: two equality joins on running
    totals instead of a range join."""
    totals = running_total(rows, KEY, "y", {f"_t_{n}": F.round(c.cast("double") * UNIT).cast("bigint") for n, c in values.items()}, block)
    totals = materialize(totals.select(*KEY, "y", *[f"_t_{n}" for n in values]))
    upto = totals.select(*KEY, F.col("y").alias("end"), *[F.col(f"_t_{n}").alias(f"_b_{n}") for n in values])
    before = totals.select(*KEY, (F.col("y") + 1).alias("start"), *[F.col(f"_t_{n}").alias(f"_a_{n}") for n in values])
    j = spans.join(upto, [*KEY, "end"], "left").join(before, [*KEY, "start"], "left")
    return j.select(*spans.columns, *[((F.col(f"_b_{n}") - F.coalesce(F.col(f"_a_{n}"), F.lit(0))) / UNIT).alias(n) for n in values])


def quiet_bands(rows: DataFrame, quiet: Column, score: Column, min_rows: int = 10, margin: int = 40, gap: int = 8,
                block: int = BLOCK) -> DataFrame:
    """Merged quiet bands away from the margins, with centre and mean score."""
    found = runs(rows, quiet, block).join(series_length(rows), KEY)
    kept = materialize(found.filter((F.col("rows") >= min_rows) & (F.col("start") > margin) & (F.col("end") + 1 < F.col("height") - margin)).select(*KEY, "start", "end"))
    merged = materialize(merge_gaps(kept, gap, block))
    scored = totals_between(rows, merged, {"_score": score}, block)
    return scored.select(*KEY, "start", "end", F.floor((F.col("start") + F.col("end")) / 2 + 0.5).cast("bigint").alias("centre"),
                         (F.col("_score") / (F.col("end") - F.col("start") + 1)).alias("score"))


def content_runs(rows: DataFrame, active: Column, min_rows: int = 5, block: int = BLOCK, widest: str | None = None) -> DataFrame:
    """top, bottom (exclusive) of active runs, with ``span`` as runs have it; a run that reaches the end is kept whatever its length."""
    found = runs(rows, active, block, widest).join(series_length(rows), KEY)
    return found.filter((F.col("rows") >= min_rows) | (F.col("end") + 1 == F.col("height"))).select(
        *KEY, F.col("start").alias("top"), (F.col("end") + 1).alias("bottom"), *(["span"] if widest else []))


def protected_regions(bands: DataFrame, heights: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stretches between bands, before the first and after the last; everything when there is none."""
    numbered = with_ordinal(bands.select(*KEY, "start", "end"), "start", "_n", KEY, block)
    following = with_neighbours(numbered, KEY, "_n", 0, 1, {"_next": lambda w: F.lead("start").over(w)}, block)
    j = heights.join(following, KEY, "left")
    none, first = F.col("_n").isNull(), F.col("_n") == 1
    pieces = F.array(
        F.when(none, F.struct(F.lit(0).cast("bigint").alias("top"), F.col("height").alias("bottom"))),
        F.when(first & (F.col("start") > 0), F.struct(F.lit(0).cast("bigint").alias("top"), F.col("start").alias("bottom"))),
        F.when(~none & (F.coalesce("_next", "height") > F.col("end")),
               F.struct(F.col("end").alias("top"), F.coalesce("_next", "height").alias("bottom"))))
    return j.select(*KEY, F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p")).select(*KEY, "p.top", "p.bottom")


def safe_valleys(rows: DataFrame, gaps: DataFrame, min_gap: int, solid: Column, wide: Column, share: float = 0.85,
                 max_mean: float = 0.006, block: int = BLOCK) -> DataFrame:
    """Adds ``safe`` to gaps [start, end]: long enough, no wide edge, mostly solid, hardly active."""
    t = totals_between(rows, gaps, {"_solid": solid.cast("int"), "_wide": wide.cast("int"), "_act": F.col("activity")}, block)
    size = F.col("end") - F.col("start") + 1
    return t.select(*gaps.columns, ((size >= min_gap) & (F.col("_wide") == 0) & (F.col("_solid") >= share * size)
                                    & (F.col("_act") <= max_mean * size)).alias("safe"))


def safe_gaps(rows: DataFrame, fragments: DataFrame, min_gap: int, solid: Column, wide: Column, share: float = 0.85,
              max_mean: float = 0.006, block: int = BLOCK) -> DataFrame:
    """Fragments (series_id, top, bottom, ...) with their number, the end of the one before and ``safe``, whether the gap between is a safe valley."""
    numbered = materialize(with_ordinal(fragments, "top", "fragment_no", KEY, block))
    prev = materialize(with_neighbours(numbered, KEY, "fragment_no", 1, 0, {"above": lambda w: F.lag("bottom").over(w)}, block))
    gaps = prev.filter(F.col("above").isNotNull()).select(*KEY, "fragment_no", F.col("above").alias("start"), (F.col("top") - 1).alias("end"))
    safe = safe_valleys(rows, gaps, min_gap, solid, wide, share, max_mean, block).select(*KEY, "fragment_no", "safe")
    return materialize(prev.join(safe, [*KEY, "fragment_no"], "left").withColumn("safe", F.coalesce("safe", F.lit(False))))


def listed_fragments(rows: DataFrame, fragments: DataFrame, max_gap: int, min_gap: int, solid: Column, wide: Column,
                     max_mean: float = 0.006, block: int = BLOCK) -> DataFrame:
    """The fragments with ``object_no``, the object they are merged into: consecutive fragments (top, bottom) become one object unless the gap is large or a safe valley."""
    beside = safe_gaps(rows, fragments, min_gap, solid, wide, max_mean=max_mean, block=block)
    fresh = F.when(F.col("above").isNull() | (F.col("top") - F.col("above") > max_gap) | F.col("safe"), 1).otherwise(0)
    return running_total(beside, KEY, "fragment_no", {"object_no": fresh}, block).drop("above", "safe")


def merge_fragments(rows: DataFrame, fragments: DataFrame, max_gap: int, min_gap: int, solid: Column, wide: Column,
                    max_mean: float = 0.006, block: int = BLOCK) -> DataFrame:
    """series_id, object_no, top, bottom, fragments (how many), fragment_top, fragment_bottom: one row per fragment, under the object it belongs to."""
    listed = materialize(listed_fragments(rows, fragments, max_gap, min_gap, solid, wide, max_mean, block))
    whole = listed.groupBy(*KEY, "object_no").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count("*").alias("fragments"))
    return listed.select(*KEY, "object_no", F.col("top").alias("fragment_top"), F.col("bottom").alias("fragment_bottom")).join(whole, [*KEY, "object_no"])


def best_cuts(smooth: DataFrame, targets: DataFrame, up: int = 420, down: int = 30, weight: float = 20.0, pull: float = 0.08,
              quiet: float = 4.5) -> DataFrame:
    """Per target the quietest row near the ideal cut: lowest weighted activity plus distance, first on
    ties. The bounded search range is unfolded and joined by equality."""
    near = targets.select(*KEY, "ideal", F.explode(F.sequence(F.col("ideal") - up, F.col("ideal") + down)).alias("y"))
    score = F.col("smooth") * weight + F.abs(F.col("y") - F.col("ideal")) * pull
    best = (near.join(smooth.select(*KEY, "y", "smooth"), [*KEY, "y"]).filter(F.col("smooth") < quiet)
            .groupBy(*KEY, "ideal").agg(F.min(F.struct(score.alias("score"), F.col("y"))).alias("b")))
    return best.select(*KEY, "ideal", F.col("b.y").alias("cut"), F.greatest(F.lit(0.0), F.lit(100.0) - F.col("b.score")).alias("quality"))


def safe_cuts(bands: DataFrame, targets: DataFrame, up: int = 220, down: int = 120) -> DataFrame:
    """Nearest band centre at or above the target, else the nearest below, within the limits, else NULL."""
    width = up + down
    wanted = targets.withColumn("_b", F.explode(F.sequence(F.floor((F.col("target") - up) / width), F.floor((F.col("target") + down) / width))))
    placed = bands.select(*KEY, "centre", F.floor(F.col("centre") / width).alias("_b"))
    j = wanted.join(placed, [*KEY, "_b"], "left")
    above = F.max(F.when(F.col("centre").between(F.col("target") - up, F.col("target")), F.col("centre")))
    below = F.min(F.when((F.col("centre") > F.col("target")) & (F.col("centre") <= F.col("target") + down), F.col("centre")))
    return j.groupBy(*KEY, "target").agg(F.coalesce(above, below).alias("cut"))


def active_bounds(rows: DataFrame, windows: DataFrame, threshold: float = 4.5, padding: int = 8, width: int = 1024) -> DataFrame:
    """First and last active row of each window [start, end), padded and clamped.

    Windows and rows meet on buckets of ``width`` rows, which also splits a series that dominates.
    """
    spans = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    hit = spans.join(rows.select(*KEY, "y", "activity", F.floor(F.col("y") / width).alias("_b")), [*KEY, "_b"], "left")
    active = (F.col("y") >= F.col("start")) & (F.col("y") < F.col("end")) & (F.col("activity") >= threshold)
    g = hit.groupBy(*KEY, "start", "end").agg(F.min(F.when(active, F.col("y"))).alias("_t"), F.max(F.when(active, F.col("y"))).alias("_b"))
    has = F.coalesce(F.col("_b") > F.col("_t"), F.lit(False))
    return g.select(*KEY, "start", "end", has.alias("has_content"),
                    F.when(has, F.greatest(F.col("start"), F.col("_t") - padding)).otherwise(F.col("start")).alias("from_y"),
                    F.when(has, F.least(F.col("end"), F.col("_b") + padding + 1)).otherwise(F.col("end")).alias("to_y"))


def adjacent_overlaps(rows: DataFrame, order: DataFrame, longest: int, shortest: int, step: int, threshold: float) -> DataFrame:
    """Longest tail of a series that matches the head of the next one.

    ``order`` is (series_id, next_id, height). Every length of the fixed grid is compared at once; a pair
    contributes a bounded number of rows whatever the size of its series.
    """
    grid = F.sequence(F.lit(longest), F.lit(shortest), F.lit(-step))
    tail = rows.join(order, KEY).filter(F.col("y") >= F.col("height") - longest).select(
        *KEY, "next_id", F.col("activity").alias("a"), (F.col("height") - F.col("y")).alias("from_end"))
    tail = tail.select("*", F.explode(grid.cast("array<bigint>")).alias("k")).filter(F.col("from_end") <= F.col("k")).select(
        *KEY, "next_id", "a", "k", (F.col("k") - F.col("from_end")).alias("r"))
    head = rows.filter(F.col("y") < longest).select(F.col("series_id").alias("next_id"), F.col("y").alias("r"), F.col("activity").alias("b"))
    diff = tail.join(head, ["next_id", "r"]).groupBy(*KEY, "next_id", "k").agg(
        F.sum(F.abs(F.col("a") - F.col("b"))).alias("s"), F.count("*").alias("n"))
    mad = F.col("s") / F.col("k")
    return diff.filter((F.col("n") == F.col("k")) & (mad < threshold)).groupBy(*KEY, "next_id").agg(
        F.max(F.struct(F.col("k"), (1 - mad / threshold).alias("confidence"))).alias("m")).select(
        *KEY, "next_id", F.col("m.k").alias("overlap"), F.col("m.confidence").alias("confidence"))
