"""Window queries over document line series, turns and stage events."""
from __future__ import annotations

from pyspark.sql import functions as F

from slipweave.operators import series as S
from slipweave.operators.ordered import running_total, with_neighbours, with_ordinal
from slipweave.operators.slips import with_lines
from slipweave.functions import fields as X
from slipweave.functions.text import let
from slipweave.plans.registry import query
from slipweave.sources import feeds
from slipweave.sources.sinks import stored
from slipweave.sources.tables import documents, table

ROWS = """WITH d AS (SELECT doc_id AS series_id, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT series_id, y, CAST(length(line) AS DOUBLE) AS activity FROM (SELECT series_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS y FROM d)),
h AS (SELECT series_id, count(*) AS height FROM r GROUP BY 1)
"""
QUIET, MIN_ROWS, MARGIN, GAP = 120.0, 2, 1, 2
BANDS = ROWS + f""", q AS (SELECT *, y - row_number() OVER (PARTITION BY series_id ORDER BY y) AS g FROM r WHERE activity < {QUIET}),
b0 AS (SELECT series_id, min(y) AS s, max(y) AS e, count(*) AS n FROM q GROUP BY series_id, g),
b1 AS (SELECT b0.* FROM b0 JOIN h USING (series_id) WHERE n >= {MIN_ROWS} AND s > {MARGIN} AND e + 1 < height - {MARGIN}),
b2 AS (SELECT *, CASE WHEN s - lag(e) OVER w <= {GAP} THEN 0 ELSE 1 END AS f FROM b1 WINDOW w AS (PARTITION BY series_id ORDER BY s)),
b3 AS (SELECT *, sum(f) OVER (PARTITION BY series_id ORDER BY s) AS g FROM b2),
bands AS (SELECT series_id, min(s) AS start, max(e) AS "end", CAST(floor((min(s) + max(e)) / 2 + 0.5) AS BIGINT) AS centre FROM b3 GROUP BY series_id, g)
"""


def rows(spark, sf_dir):
    return feeds.row_activity(spark, sf_dir)


def heights(spark, sf_dir):
    return stored(spark, f"series heights:{sf_dir}", lambda: S.series_length(rows(spark, sf_dir)))


def bands(spark, sf_dir):
    return stored(spark, f"series bands:{sf_dir}", lambda: S.quiet_bands(rows(spark, sf_dir), F.col("activity") < QUIET, F.col("activity"), MIN_ROWS, MARGIN, GAP))


@query("win_smooth_weighted", ROWS + """SELECT series_id, y, (coalesce(lag(activity, 2) OVER w, 0) + 2 * coalesce(lag(activity) OVER w, 0) + 3 * activity
  + 2 * coalesce(lead(activity) OVER w, 0) + coalesce(lead(activity, 2) OVER w, 0)) / (3 + CASE WHEN y >= 2 THEN 1 ELSE 0 END + CASE WHEN y >= 1 THEN 2 ELSE 0 END
  + CASE WHEN y < height - 1 THEN 2 ELSE 0 END + CASE WHEN y < height - 2 THEN 1 ELSE 0 END) AS smooth FROM r JOIN h USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY y)""")
def win_smooth_weighted(spark, sf_dir):
    return S.smooth_weighted(rows(spark, sf_dir)).select("series_id", "y", "smooth")


@query("win_smooth_box", ROWS + """SELECT series_id, y, sum(activity) OVER w / count(*) OVER w AS smooth FROM r
  WINDOW w AS (PARTITION BY series_id ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def win_smooth_box(spark, sf_dir):
    return S.smooth_box(rows(spark, sf_dir)).select("series_id", "y", "smooth")


@query("win_edge_delta", ROWS + "SELECT series_id, y, coalesce(abs(activity - lag(activity) OVER (PARTITION BY series_id ORDER BY y)), 0) AS edge FROM r")
def win_edge_delta(spark, sf_dir):
    return S.edge_delta(rows(spark, sf_dir)).select("series_id", "y", "edge")


@query("agg_row_stats", """WITH c AS (SELECT doc_id, y, length(w) AS v FROM (SELECT doc_id, y, unnest(string_split(line, ' ')) AS w FROM
   (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents)))
SELECT doc_id, y, count(*) AS cells, CAST(sum(v) AS DOUBLE) / count(*) AS avg, CAST(sum(v * v) AS DOUBLE) / count(*) - (CAST(sum(v) AS DOUBLE) / count(*)) * (CAST(sum(v) AS DOUBLE) / count(*)) AS variance
FROM c GROUP BY doc_id, y""")
def agg_row_stats(spark, sf_dir):
    """Lines as matrix rows, word lengths as cells."""
    lines_ = documents(spark, sf_dir, "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("y", "line"))
    cells = lines_.select("doc_id", F.col("y").cast("bigint").alias("y"), F.explode(F.split("line", " ")).alias("w")).select("doc_id", "y", F.length("w").alias("v"))
    return S.matrix_row_stats(cells, ["doc_id", "y"], "v")


@query("win_quiet_bands", BANDS + """, t AS (SELECT bands.series_id, start, "end", centre, sum(r.activity) AS s FROM bands JOIN r ON r.series_id = bands.series_id
  AND r.y BETWEEN bands.start AND bands."end" GROUP BY ALL) SELECT series_id, start, "end", centre, s / ("end" - start + 1) AS score FROM t""")
def win_quiet_bands(spark, sf_dir):
    return S.quiet_bands(rows(spark, sf_dir), F.col("activity") < QUIET, F.col("activity"), MIN_ROWS, MARGIN, GAP)


RUNS = ROWS + f""", a AS (SELECT *, y - row_number() OVER (PARTITION BY series_id ORDER BY y) AS g FROM r WHERE activity >= {QUIET}),
c AS (SELECT series_id, min(y) AS top, max(y) + 1 AS bottom, max(activity) AS span FROM a JOIN h USING (series_id) GROUP BY series_id, g, height HAVING count(*) >= 2 OR max(y) + 1 = height)
"""


def content(spark, sf_dir):
    return stored(spark, f"series content:{sf_dir}", lambda: S.content_runs(rows(spark, sf_dir), F.col("activity") >= QUIET, 2, widest="span"))


@query("win_content_runs", RUNS + "SELECT series_id, top, bottom FROM c")
def win_content_runs(spark, sf_dir):
    return S.content_runs(rows(spark, sf_dir), F.col("activity") >= QUIET, 2)


@query("win_protected_regions", BANDS + """, n AS (SELECT *, row_number() OVER w AS k, lead(start) OVER w AS nx FROM bands WINDOW w AS (PARTITION BY series_id ORDER BY start))
SELECT series_id, 0 AS top, height AS bottom FROM h WHERE series_id NOT IN (SELECT series_id FROM bands)
UNION ALL SELECT series_id, 0, start FROM n WHERE k = 1 AND start > 0
UNION ALL SELECT n.series_id, n."end", coalesce(nx, height) FROM n JOIN h USING (series_id) WHERE coalesce(nx, height) > n."end" """)
def win_protected_regions(spark, sf_dir):
    return S.protected_regions(bands(spark, sf_dir), heights(spark, sf_dir))


@query("win_merge_intervals", ROWS + """, z AS (SELECT series_id, y * 10 AS s, y * 10 + CAST(activity AS BIGINT) % 30 AS e FROM r),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY series_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS f FROM z),
g AS (SELECT *, sum(f) OVER (PARTITION BY series_id ORDER BY s) AS k FROM m)
SELECT series_id, min(s) AS start, max(e) AS "end", count(*) AS parts FROM g GROUP BY series_id, k""")
def win_merge_intervals(spark, sf_dir):
    zones = rows(spark, sf_dir).select("series_id", (F.col("y") * 10).alias("start"), (F.col("y") * 10 + F.col("activity").cast("bigint") % 30).alias("end"))
    return S.merge_gaps(zones, 2)


def valley_args():
    return dict(solid=F.col("activity") < QUIET, wide=F.col("activity") > 60)


@query("lay_safe_valley", RUNS + """, x AS (SELECT series_id, lag(bottom) OVER (PARTITION BY series_id ORDER BY top) AS lo, top AS hi FROM c)
, s AS (SELECT x.series_id, lo, hi, count_if(activity > 60) AS wide, count_if(activity < 120) AS solid, sum(activity) AS act FROM x JOIN r ON r.series_id = x.series_id AND y >= lo AND y < hi
   WHERE lo IS NOT NULL GROUP BY ALL)
SELECT series_id, lo AS start, hi - 1 AS "end", hi - lo >= 2 AND wide = 0 AND solid >= 0.85 * (hi - lo) AND act <= 50.0 * (hi - lo) AS safe FROM s""")
def lay_safe_valley(spark, sf_dir):
    beside = S.safe_gaps(rows(spark, sf_dir), content(spark, sf_dir), 2, max_mean=50.0, **valley_args())
    return beside.filter("above is not null").select("series_id", F.col("above").alias("start"), (F.col("top") - 1).alias("end"), "safe")


FRAGMENTS = RUNS + """, x AS (SELECT series_id, lag(bottom) OVER (PARTITION BY series_id ORDER BY top) AS lo, top AS hi, bottom, span FROM c)
, s AS (SELECT x.series_id, lo, hi, x.bottom, x.span, count_if(activity > 60) AS wide, count_if(activity < 120) AS solid, sum(activity) AS act, count_if(activity > 100) AS wider FROM x LEFT JOIN r ON r.series_id = x.series_id AND y >= lo AND y < hi GROUP BY ALL)
, f AS (SELECT *, CASE WHEN lo IS NULL OR hi - lo > 3 OR (hi - lo >= 2 AND wide = 0 AND solid >= 0.85 * (hi - lo) AND act <= 50.0 * (hi - lo)) THEN 1 ELSE 0 END AS fresh FROM s)
, g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY series_id ORDER BY hi) AS BIGINT) AS object_no FROM f)
"""


def fragments(spark, sf_dir):
    """The fragments of the content runs' objects: series_id, fragment_no, object_no, top, bottom, span."""
    return S.listed_fragments(rows(spark, sf_dir), content(spark, sf_dir), 3, 2, max_mean=50.0, **valley_args())


@query("win_merge_fragments", FRAGMENTS + """SELECT series_id, object_no, min(hi) OVER o AS top, max(bottom) OVER o AS bottom, count(*) OVER o AS fragments, hi AS fragment_top, bottom AS fragment_bottom
FROM g WINDOW o AS (PARTITION BY series_id, object_no)""")
def win_merge_fragments(spark, sf_dir):
    return S.merge_fragments(rows(spark, sf_dir), content(spark, sf_dir), 3, 2, max_mean=50.0, **valley_args())


@query("win_stitch_offsets", """WITH t AS (SELECT conv_id, turn, CAST(floor((56 + 22 * ceil(length(text) / 48.0) - turn) * 800 / (400 + 50 * (turn % 3)) + 0.5) AS BIGINT) AS scaled FROM conversations)
SELECT conv_id, turn, scaled, coalesce(sum(scaled) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dest_y FROM t""")
def win_stitch_offsets(spark, sf_dir):
    """Destination of each piece: scaled, trimmed heights of the pieces before it."""
    t = feeds.turns(spark, sf_dir)
    scaled = F.floor((F.col("height") - F.col("turn")) * 800 / (400 + 50 * (F.col("turn") % 3)) + 0.5).cast("bigint")
    return running_total(t.select("conv_id", "turn", scaled.alias("scaled")), ["conv_id"], "turn", {"dest_y": F.col("scaled")}, exclusive=True)


@query("win_best_cut", ROWS + """, s AS (SELECT series_id, y, sum(activity) OVER w / count(*) OVER w AS smooth FROM r
  WINDOW w AS (PARTITION BY series_id ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
t AS (SELECT series_id, unnest(range(12, height, 12)) AS ideal FROM h),
c AS (SELECT t.series_id, ideal, y, smooth * 20.0 + abs(y - ideal) * 0.08 AS score FROM t JOIN s ON s.series_id = t.series_id AND y BETWEEN ideal - 8 AND ideal + 3 WHERE smooth < 150),
b AS (SELECT *, row_number() OVER (PARTITION BY series_id, ideal ORDER BY score, y) AS k FROM c)
SELECT series_id, ideal, y AS cut, greatest(0.0, 100.0 - score) AS quality FROM b WHERE k = 1""")
def win_best_cut(spark, sf_dir):
    r = rows(spark, sf_dir)
    targets = heights(spark, sf_dir).filter("height > 12").select("series_id", F.explode(F.expr("sequence(12L, height - 1, 12L)")).alias("ideal"))
    return S.best_cuts(S.smooth_box(r), targets, 8, 3, quiet=150.0)


@query("win_safe_cut", BANDS + """, t AS (SELECT series_id, unnest(range(12, height, 12)) AS target FROM h)
SELECT t.series_id, target, coalesce(max(centre) FILTER (centre BETWEEN target - 8 AND target), min(centre) FILTER (centre > target AND centre <= target + 4)) AS cut
FROM t LEFT JOIN bands USING (series_id) GROUP BY ALL""")
def win_safe_cut(spark, sf_dir):
    targets = heights(spark, sf_dir).filter("height > 12").select("series_id", F.explode(F.expr("sequence(12L, height - 1, 12L)")).alias("target"))
    return S.safe_cuts(bands(spark, sf_dir), targets, 8, 4)


@query("agg_active_bounds", ROWS + f""", w AS (SELECT series_id, y // 20 AS b, min(CASE WHEN activity >= {QUIET} THEN y END) AS t, max(CASE WHEN activity >= {QUIET} THEN y END) AS bo FROM r GROUP BY ALL)
SELECT series_id, b * 20 AS start, least(b * 20 + 20, height) AS "end", coalesce(bo > t, false) AS has_content,
 CASE WHEN bo > t THEN greatest(b * 20, t - 3) ELSE b * 20 END AS from_y, CASE WHEN bo > t THEN least(least(b * 20 + 20, height), bo + 4) ELSE least(b * 20 + 20, height) END AS to_y
FROM w JOIN h USING (series_id)""")
def agg_active_bounds(spark, sf_dir):
    r = rows(spark, sf_dir)
    windows = S.series_length(r).select("series_id", F.col("height"), F.explode(F.expr("sequence(0L, height - 1, 20L)")).alias("start")).select(
        "series_id", "start", F.least(F.col("start") + 20, F.col("height")).alias("end"))
    return S.active_bounds(r, windows, QUIET, 3, 20)


@query("join_adjacent_overlap", ROWS + """, o AS (SELECT series_id, lead(series_id) OVER (ORDER BY series_id) AS next_id, height FROM h),
k AS (SELECT unnest(range(20, 3, -4)) AS k),
p AS (SELECT o.series_id, next_id, k, sum(abs(a.activity - b.activity)) AS s, count(*) AS n FROM o, k JOIN r a ON true JOIN r b ON true
  WHERE a.series_id = o.series_id AND b.series_id = next_id AND a.y >= height - k AND b.y = a.y - (height - k) GROUP BY ALL)
SELECT series_id, next_id, max(k) AS overlap, arg_max(1 - s / k / 150.0, k) AS confidence FROM p WHERE n = k AND s / k < 150.0 GROUP BY ALL""")
def join_adjacent_overlap(spark, sf_dir):
    r = rows(spark, sf_dir)
    numbered = with_ordinal(S.series_length(r), "series_id", "n")
    order = with_neighbours(numbered, [], "n", 0, 1, {"next_id": lambda w: F.lead("series_id").over(w)}).filter("next_id IS NOT NULL")
    return S.adjacent_overlaps(r, order.select("series_id", "next_id", "height"), 20, 4, 4, 150.0)


@query("win_file_boundary", """WITH p AS (SELECT doc_id, unnest(range(1, CAST(ceil(len(string_split(text, chr(10))) / 20.0) AS BIGINT) + 1)) AS page FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, page) AS global_page FROM p)
SELECT doc_id, page, global_page, coalesce(lead(doc_id) OVER (ORDER BY global_page) <> doc_id, false) AS boundary FROM n""")
def win_file_boundary(spark, sf_dir):
    docs = documents(spark, sf_dir, "text").select("doc_id", F.ceil(F.size(F.split("text", "\n")) / 20).alias("n"))
    first = running_total(docs, [], "doc_id", {"offset": F.col("n")}, exclusive=True)
    pages = first.select("doc_id", "offset", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page")).select(
        "doc_id", "page", (F.col("offset") + F.col("page")).alias("global_page"))
    return with_neighbours(pages, [], "global_page", 0, 1, {"boundary": lambda w: F.coalesce(F.lead("doc_id").over(w) != F.col("doc_id"), F.lit(False))})


EVENTS = """WITH e AS (SELECT event_id, user_id AS stream, CASE WHEN event_type = 'signup' THEN 'INPUT' ELSE upper(event_type) END AS stage, ts,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value < 2 THEN 'SKIPPED' ELSE 'PASS' END AS status FROM events),
n AS (SELECT *, lead(ts) OVER w AS nx, sum(CASE WHEN stage = 'INPUT' THEN 1 ELSE 0 END) OVER w AS run FROM e WINDOW w AS (PARTITION BY stream ORDER BY event_id))
"""


def timed_events(spark, sf_dir):
    numbered = with_ordinal(feeds.stage_events(spark, sf_dir), "event_id", "n", ["stream"])
    return with_neighbours(numbered, ["stream"], "n", 0, 1, {"end": lambda w: F.lead("start").over(w)})


def micros(a, b):
    return F.unix_micros(F.col(b)) - F.unix_micros(F.col(a))


@query("win_stage_run_id", EVENTS + """SELECT stream, run, count(*) AS stages, arg_max(status, event_id) AS final_status,
  CAST(sum(epoch_us(nx) - epoch_us(ts)) AS BIGINT) AS micros FROM n GROUP BY stream, run""")
def win_stage_run_id(spark, sf_dir):
    """One run per INPUT event; stage count, duration and final status of each run."""
    ran = running_total(timed_events(spark, sf_dir), ["stream"], "n", {"run": F.when(F.col("stage") == "INPUT", 1).otherwise(0)})
    return ran.groupBy("stream", "run").agg(F.count("*").alias("stages"), F.max_by("status", "event_id").alias("final_status"),
                                            F.sum(micros("start", "end")).alias("micros"))


@query("agg_stage_runs", EVENTS + """SELECT stage, status, count(*) AS runs, CAST(sum(epoch_us(nx) - epoch_us(ts)) AS DOUBLE) / count(nx) AS mean_micros,
  max(epoch_us(nx) - epoch_us(ts)) AS max_micros FROM n GROUP BY stage, status""")
def agg_stage_runs(spark, sf_dir):
    d = timed_events(spark, sf_dir).withColumn("d", micros("start", "end"))
    return d.groupBy("stage", "status").agg(F.count("*").alias("runs"), (F.sum("d").cast("double") / F.count("d")).alias("mean_micros"), F.max("d").alias("max_micros"))


@query("win_review_latest", """WITH e AS (SELECT user_id AS slip, event_id, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT slip, arg_max(status, event_id) AS status, arg_max(coalesce(before, ''), event_id) AS before, count(*) AS edits FROM e GROUP BY slip""")
def win_review_latest(spark, sf_dir):
    """The latest review event sets the status; before comes from the event before it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("slip"), "event_id", F.col("event_type").alias("status"))
    numbered = with_ordinal(e, "event_id", "n", ["slip"])
    changed = with_neighbours(numbered, ["slip"], "n", 1, 0, {"before": lambda w: F.lag("status").over(w)})
    return changed.groupBy("slip").agg(F.max_by("status", "n").alias("status"), F.max_by(F.coalesce("before", F.lit("")), "n").alias("before"), F.count("*").alias("edits"))


@query("win_next_line", """WITH l AS (SELECT idx, line, row_number() OVER (PARTITION BY idx ORDER BY p) - 1 AS pos FROM (SELECT idx, unnest(string_split(raw_text, chr(10))) AS line,
  generate_subscripts(string_split(raw_text, chr(10)), 1) AS p FROM @FEED) WHERE line <> '')
SELECT idx, pos, line, lead(line) OVER w AS next1, lead(line, 2) OVER w AS next2 FROM l WINDOW w AS (PARTITION BY idx ORDER BY pos)""")
def win_next_line(spark, sf_dir):
    """The lines of a text stay in its row, so the neighbours need no shuffle."""
    f = with_lines(feeds.slip_feed(spark, sf_dir))
    around = F.transform("lines", lambda l, i: F.struct(i.alias("pos"), l.alias("line"), F.get("lines", i + 1).alias("next1"), F.get("lines", i + 2).alias("next2")))
    return f.select("idx", F.inline(around))


@query("win_section_flag", """WITH l AS (SELECT idx, line, row_number() OVER (PARTITION BY idx ORDER BY p) - 1 AS pos FROM (SELECT idx, unnest(string_split(raw_text, chr(10))) AS line,
  generate_subscripts(string_split(raw_text, chr(10)), 1) AS p FROM @FEED) WHERE line <> '')
SELECT idx, pos, max(CASE WHEN line = 'ไปยัง' THEN 1 ELSE 0 END) OVER (PARTITION BY idx ORDER BY pos) = 1 AS in_receiver_section FROM l""")
def win_section_flag(spark, sf_dir):
    f = with_lines(feeds.slip_feed(spark, sf_dir))
    cue = F.array_position(F.transform("lines", lambda l: let(F.lower(l), X.receiver_label)), F.lit(True))
    return f.select("idx", cue.alias("cue"), F.posexplode("lines").alias("pos", "line")).select(
        "idx", "pos", ((F.col("cue") > 0) & (F.col("pos") + 1 >= F.col("cue"))).alias("in_receiver_section"))
