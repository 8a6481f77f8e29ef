"""Page layout queries over conversation turns and document line series."""
from __future__ import annotations

from pyspark.sql import functions as F

from slipweave.operators import layout as L
from slipweave.operators import series as S
from slipweave.operators.ordered import running_total, with_neighbours, with_ordinal
from slipweave.plans.registry import query
from slipweave.plans.series_windows import BANDS, FRAGMENTS, QUIET, ROWS, RUNS, bands, content, fragments, heights, rows
from slipweave.sources import feeds
from slipweave.sources.sinks import materialize
from slipweave.sources.tables import documents, table

SCALES = "[" + ", ".join(f"'{s!r}'::DOUBLE" for s in L.shrink_scales()) + "]"
LINEAR = "[" + ", ".join(f"'{s!r}'::DOUBLE" for s in L.linear_scales()) + "]"


def objects(spark, sf_dir):
    """conv_id, object_id, y_top, y_bottom: turns stacked with a gap of 28."""
    t = feeds.turns(spark, sf_dir).select("conv_id", "turn", "height")
    stacked = running_total(t, ["conv_id"], "turn", {"y_top": F.col("height") + 28}, exclusive=True)
    return stacked.select("conv_id", F.col("turn").cast("bigint").alias("object_id"), "y_top", (F.col("y_top") + F.col("height")).alias("y_bottom"))


OBJECTS = """t AS (SELECT conv_id, turn, CAST(56 + 22 * ceil(length(text) / 48.0) AS BIGINT) AS height FROM conversations),
o AS (SELECT conv_id, turn AS object_id, coalesce(sum(height + 28) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y_top, height FROM t),
obj AS (SELECT conv_id, object_id, CAST(y_top AS BIGINT) AS y_top, CAST(y_top + height AS BIGINT) AS y_bottom FROM o)
"""


def tight_objects(spark, sf_dir):
    """Objects with gaps of 4, 16 and 28, some lower than the padding below a page."""
    t = feeds.turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") % 5 == 3, 10).otherwise(F.col("height")).cast("bigint").alias("height"), (4 + 12 * (F.col("turn") % 3)).alias("gap"))
    stacked = running_total(t, ["conv_id"], "turn", {"y_top": F.col("height") + F.col("gap")}, exclusive=True)
    return materialize(stacked.select("conv_id", F.col("turn").cast("bigint").alias("object_id"), "y_top", (F.col("y_top") + F.col("height")).alias("y_bottom")))


def tight_pages(spark, sf_dir):
    """Pages of the objects; the content ends 9 below the last one."""
    o = tight_objects(spark, sf_dir)
    return L.pack_pages(o, heights=o.groupBy("conv_id").agg((F.max("y_bottom") + 9).alias("height")))


PAGES = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 10 ELSE CAST(56 + 22 * ceil(length(text) / 48.0) AS BIGINT) END AS height, 4 + 12 * (turn % 3) AS gap FROM conversations),
o AS (SELECT conv_id, turn AS object_id, row_number() OVER w AS n, CAST(sum(height + gap) OVER w - height - gap AS BIGINT) AS y_top, height FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
obj AS (SELECT conv_id, object_id, n, y_top, y_top + height AS y_bottom FROM o),
ht AS (SELECT conv_id, max(y_bottom) + 9 AS content, max(n) AS most FROM obj GROUP BY conv_id),
fi AS (SELECT e.conv_id, e.n AS after, least(content, e.y_bottom + 18) AS cut, min(f.n) AS first FROM obj e JOIN ht USING (conv_id) JOIN obj f ON f.conv_id = e.conv_id AND f.y_bottom > least(content, e.y_bottom + 18) GROUP BY ALL),
st AS (SELECT fi.conv_id, after, first, greatest(cut, y_top - 14) AS s FROM fi JOIN obj ON obj.conv_id = fi.conv_id AND obj.n = first UNION ALL SELECT conv_id, 0, 1, 0 FROM ht),
lk AS (SELECT st.*, f.n, f.y_bottom + 18 - s AS projected, f.y_bottom - f.y_top AS h, p.y_bottom + 18 - s AS used FROM st JOIN obj f ON f.conv_id = st.conv_id AND f.n > st.first JOIN obj p ON p.conv_id = f.conv_id AND p.n = f.n - 1),
sc AS (SELECT *, list_filter({SCALES}, lambda x: projected * x <= 1106)[1] AS s1, greatest(0, 1106 - used) / CAST(h AS DOUBLE) AS vis FROM lk),
re AS (SELECT conv_id, after, min(n) AS refused FROM sc WHERE NOT (projected <= 1131 OR (h <= 180 AND projected <= 1355) OR (s1 IS NOT NULL AND s1 >= 0.5 AND NOT ((vis < 0.25 AND s1 < 0.9) OR (vis < 0.45 AND s1 < 0.78) OR (used >= 1106 * 0.9 AND s1 < 0.72))
          AND (used <= 1106 * 0.3 OR (vis >= 0.5 AND s1 >= 0.55) OR s1 >= 0.6 OR vis >= 0.65))) GROUP BY ALL),
nx AS (SELECT st.*, coalesce(refused - 1, most) AS last FROM st JOIN ht USING (conv_id) LEFT JOIN re ON re.conv_id = st.conv_id AND re.after = st.after),
pg AS (SELECT conv_id, 1 AS page_no, s, last FROM nx WHERE after = 0 UNION ALL SELECT pg.conv_id, page_no + 1, nx.s, nx.last FROM pg JOIN nx ON nx.conv_id = pg.conv_id AND nx.after = pg.last),
pe AS (SELECT pg.conv_id, page_no, s, least(content, y_bottom + 18) AS e, coalesce(list_filter({SCALES}, lambda x: (y_bottom + 18 - s) * x <= 1106)[1], {SCALES}[-1]) AS scale
  FROM pg JOIN ht USING (conv_id) JOIN obj ON obj.conv_id = pg.conv_id AND obj.n = pg.last),
pages AS (SELECT pe.conv_id, page_no, s AS y_start, e AS y_end, scale, count(n) AS objects, coalesce(string_agg(object_id, '|' ORDER BY n), '') AS object_ids
  FROM pe LEFT JOIN obj ON obj.conv_id = pe.conv_id AND y_top >= s AND y_bottom <= e GROUP BY ALL)
"""


@query("lay_page_pack", PAGES + "SELECT * FROM pages")
def lay_page_pack(spark, sf_dir):
    return tight_pages(spark, sf_dir)


@query("lay_tail_merge", PAGES + """,
mg AS (SELECT conv_id, page_no AS i, 1 AS no, y_start, y_end, scale, object_ids, objects, y_end - y_start AS height, 0 AS merged FROM pages WHERE page_no = 1
  UNION ALL SELECT conv_id, i, CASE WHEN ok THEN no ELSE no + 1 END, CASE WHEN ok THEN ps ELSE s END, CASE WHEN ok THEN greatest(pe, e) ELSE e END,
    CASE WHEN ok THEN least(psc, sc) ELSE sc END, CASE WHEN ok THEN concat_ws('|', nullif(pids, ''), nullif(ids, '')) ELSE ids END, CASE WHEN ok THEN po + ob ELSE ob END, CASE WHEN ok THEN ph + h ELSE h END, CASE WHEN ok THEN pm + 1 ELSE 0 END
  FROM (SELECT mg.conv_id, p.page_no AS i, no, mg.y_start AS ps, mg.y_end AS pe, mg.scale AS psc, mg.object_ids AS pids, mg.objects AS po, mg.height AS ph, mg.merged AS pm, p.y_start AS s, p.y_end AS e, p.scale AS sc,
      p.object_ids AS ids, p.objects AS ob, p.y_end - p.y_start AS h, (p.y_end - p.y_start) <= 180 OR ((p.y_end - p.y_start) <= 464 AND mg.height + p.y_end - p.y_start <= 1719) AS ok
    FROM mg JOIN pages p ON p.conv_id = mg.conv_id AND p.page_no = mg.i + 1))
SELECT conv_id, no AS page_no, arg_max(y_start, i) AS y_start, arg_max(y_end, i) AS y_end, arg_max(scale, i) AS scale, arg_max(objects, i) AS objects, arg_max(object_ids, i) AS object_ids,
  arg_max(height, i) AS height, arg_max(merged, i) AS merged FROM mg GROUP BY conv_id, no""")
def lay_tail_merge(spark, sf_dir):
    return L.merge_tails(tight_pages(spark, sf_dir))


def object_rows(spark, sf_dir):
    """Per turn: lines as rows (span = characters, active = words), aggregated to one object."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    cells = t.select("conv_id", "turn", F.length("line").alias("span"), F.size(F.split("line", " ")).alias("active"))
    return cells.groupBy("conv_id", "turn").agg(F.max("span").alias("max_span"), F.sum("active").alias("total"), F.count("*").alias("n"),
                                                F.count_if(F.col("active") >= 4).alias("dense"))


OBJECT_ROWS = """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations),
a AS (SELECT conv_id, turn, max(length(line)) AS max_span, sum(len(string_split(line, ' '))) AS total, count(*) AS n, count_if(len(string_split(line, ' ')) >= 4) AS dense FROM l GROUP BY 1, 2)
"""


@query("lay_classify", OBJECT_ROWS + """, v AS (SELECT *, n * 40 AS h, max_span / 800.0::DOUBLE AS ratio, total / CAST(n AS DOUBLE) AS d, n * 40 / CAST(max_span AS DOUBLE) AS asp FROM a),
c AS (SELECT *, CASE WHEN h < 55 AND (ratio < 0.28 OR (ratio > 0.72 AND d < 2.5)) THEN 'system' WHEN ratio > 0.48 AND h > 130 AND d > 4.5 THEN 'media'
  WHEN ratio > 0.22 AND ratio < 0.62 AND h > 70 AND h < 420 AND asp > 0.45 AND asp < 2.8 THEN 'sticker' WHEN ratio < 0.78 AND h < 600 THEN 'bubble' ELSE 'unknown' END AS kind FROM v)
SELECT conv_id, turn, kind, CAST(CASE kind WHEN 'system' THEN 0.7 WHEN 'media' THEN 0.78 WHEN 'sticker' THEN 0.6 WHEN 'bubble' THEN 0.72 ELSE 0.35 END AS DOUBLE) AS confidence, kind = 'media' AND h > 800 AS oversized FROM c""")
def lay_classify(spark, sf_dir):
    a = object_rows(spark, sf_dir)
    c = L.classify(F.col("n") * 40, F.col("max_span"), F.col("total") / F.col("n"), 800)
    return a.select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", "c.kind", "c.confidence", "c.oversized")


@query("lay_noise_filter", OBJECT_ROWS + """SELECT conv_id, turn, NOT (n * 20 <= 92 AND max_span <= 144 AND total / 10.0 <= 3.2 AND dense <= greatest(8, floor(n * 20 * 0.2 + 0.5)))
  AND NOT (n * 20 <= 74 AND max_span <= 336 AND total / 10.0 <= 5.44 AND dense <= greatest(10, floor(n * 20 * 0.22 + 0.5))) AS keep FROM a""")
def lay_noise_filter(spark, sf_dir):
    a = object_rows(spark, sf_dir)
    return a.select("conv_id", "turn", L.keeps(F.col("n") * 20, F.col("max_span"), F.col("total") / 10.0, F.col("dense"), 800).alias("keep"))


@query("lay_shrink_fit", f"""WITH b AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS h, CAST(300 + doc_id % 900 AS DOUBLE) AS w FROM documents),
s AS (SELECT *, list_filter({SCALES}, lambda s: h * s <= 1106)[1] AS shrink, list_filter({LINEAR}, lambda s: w * s <= 800.000001 AND h * s <= 895.000001)[1] AS lin, least(645.0::DOUBLE / w, 890.0::DOUBLE / h) AS asp FROM b)
SELECT doc_id, shrink IS NOT NULL AS fits, coalesce(shrink, {SCALES}[-1]) AS shrink_scale, lin AS linear_scale, (800 - w * lin) * 0.5::DOUBLE AS x, 895 - h * lin AS y,
  asp AS aspect_scale, (645.0::DOUBLE - floor(w * asp + 0.5)) / 2 AS aspect_x, (890.0::DOUBLE - floor(h * asp + 0.5)) / 2 AS aspect_y FROM s""")
def lay_shrink_fit(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("h"), (300 + F.col("doc_id") % 900).cast("double").alias("w"))
    f = b.select("doc_id", L.shrink_fit(F.col("h"), 1106).alias("s"), L.box_fit(F.col("w"), F.col("h"), 800.0, 895.0).alias("b"), L.aspect_fit(F.col("w"), F.col("h")).alias("a"))
    return f.select("doc_id", "s.fits", F.col("s.scale").alias("shrink_scale"), F.col("b.scale").alias("linear_scale"), F.col("b.x").alias("x"), F.col("b.y").alias("y"),
                    F.col("a.scale").alias("aspect_scale"), F.col("a.x").alias("aspect_x"), F.col("a.y").alias("aspect_y"))


@query("lay_split_points", RUNS.replace("WITH d AS", "WITH RECURSIVE d AS") + """, sp AS (SELECT series_id, CAST(0 AS BIGINT) AS cut, height FROM h
  UNION ALL SELECT sp.series_id, least(CASE WHEN c.top IS NOT NULL THEN c.bottom + 3 ELSE sp.cut + 15 END, height), height FROM sp
   LEFT JOIN c ON c.series_id = sp.series_id AND sp.cut + 15 BETWEEN c.top AND c.bottom WHERE sp.cut + 15 < height)
SELECT series_id, cut FROM sp UNION SELECT series_id, height FROM h""")
def lay_split_points(spark, sf_dir):
    zones = content(spark, sf_dir).select("series_id", F.col("top").alias("start"), F.col("bottom").alias("end"))
    return L.split_points(zones, heights(spark, sf_dir), 15)


#: The next cut of every ideal row, by plain joins; the chain from row 0 is recursive.
GAP_CUTS = ROWS.replace("WITH d AS", "WITH RECURSIVE d AS") + """, s AS (SELECT series_id, y, activity, height, sum(activity) OVER w / count(*) OVER w AS smooth FROM r JOIN h USING (series_id)
  WINDOW w AS (PARTITION BY series_id ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
q AS (SELECT t.series_id, t.y, min({'c': CAST(floor(s.smooth * 20000000 + 0.5) AS BIGINT) + 80000 * abs(s.y - t.y), 'y': s.y}) AS best FROM r t JOIN s ON s.series_id = t.series_id AND s.y BETWEEN t.y - 8 AND t.y + 3
  WHERE s.smooth < 150 AND s.y <= s.height - 2 GROUP BY ALL),
l AS (SELECT series_id, y, activity, max(CASE WHEN activity < 150 THEN y END) OVER w AS calm, max(CASE WHEN activity >= 150 THEN y END) OVER w AS p FROM r WINDOW w AS (PARTITION BY series_id ORDER BY y)),
a AS (SELECT l.series_id, l.y, l.p, coalesce(b.calm, -1) + 1 AS block FROM l LEFT JOIN l b ON b.series_id = l.series_id AND b.y = l.p),
n AS (SELECT a.series_id, a.y - 20 AS at, CASE WHEN best IS NOT NULL THEN best.y WHEN p > a.y - 19 THEN least(a.y, greatest(a.y - 19, greatest(a.y - 19, block - 1) + 1 - 2)) ELSE greatest(a.y - 19, a.y) END AS cut,
    CASE WHEN best IS NOT NULL THEN 'gap_valley' ELSE 'fallback_rollback' END AS method, CASE WHEN best IS NOT NULL THEN greatest(0, 100000000 - best.c) ELSE 0 END AS q
  FROM a LEFT JOIN q USING (series_id, y) WHERE a.y >= 20),
f AS (SELECT h.series_id, 1 AS cut_no, 0 AS at, coalesce(cut, height) AS y, coalesce(method, 'end_of_image') AS method, coalesce(q, 100000000) / 1000000 AS quality FROM h LEFT JOIN n ON n.series_id = h.series_id AND n.at = 0
  UNION ALL SELECT f.series_id, cut_no + 1, f.y, coalesce(n.cut, height), coalesce(n.method, 'end_of_image'), coalesce(n.q, 100000000) / 1000000 FROM f JOIN h USING (series_id) LEFT JOIN n ON n.series_id = f.series_id AND n.at = f.y
  WHERE f.method <> 'end_of_image')
"""
BEST_SCALE = f"coalesce(list_filter({LINEAR}, lambda s: (f.y - f.at) * 0.81::DOUBLE * s <= 895.000001)[1], {LINEAR}[-1])"


def gap_cuts(spark, sf_dir):
    r = rows(spark, sf_dir)
    smooth = S.smooth_box(r).select("series_id", "y", "activity", "smooth").join(heights(spark, sf_dir), "series_id")
    return L.gap_cuts(smooth, usable=20, up=8, down=3, tail=2, quiet=150.0, padding=2)


@query("lay_gap_cut", GAP_CUTS + f"SELECT series_id, cut_no, y, method, quality, {BEST_SCALE} AS scale FROM f")
def lay_gap_cut(spark, sf_dir):
    return gap_cuts(spark, sf_dir)


_STEPS = L.page_scales(0.82)
_LENGTHS = "[" + ", ".join(str(L.rounded(30 / s)) for s in _STEPS) + "]"
_STEP_SCALES = "[" + ", ".join(f"'{s!r}'::DOUBLE" for s in _STEPS) + "]"
#: The next state (row, step of the scale) of every state, by plain joins; the chain from row 0 at full scale is recursive.
SAFE_CUTS = BANDS.replace("WITH d AS", "WITH RECURSIVE d AS") + f""", tg AS (SELECT series_id, unnest(range(1, height + 1)) AS t FROM h),
nr AS (SELECT tg.series_id, t, coalesce(max(centre) FILTER (centre BETWEEN t - 8 AND t), min(centre) FILTER (centre > t AND centre <= t + 4)) AS c FROM tg JOIN bands USING (series_id) GROUP BY ALL),
sl AS (SELECT series_id, height, y, i, least({_LENGTHS}[i + 1], height - y) AS len FROM (SELECT series_id, height, y, unnest(range(0, {len(_STEPS)})) AS i FROM (SELECT series_id, height, unnest(range(0, height)) AS y FROM h))),
hi AS (SELECT sl.*, c FROM sl LEFT JOIN nr ON nr.series_id = sl.series_id AND t = y + len),
fs AS (SELECT b.series_id, b.height, b.y, b.i, b.len, min({{'i': e.i, 'c': e.c}}) FILTER (e.c IS NOT NULL) AS hit FROM hi b JOIN hi e ON e.series_id = b.series_id AND e.y = b.y AND e.i >= b.i GROUP BY ALL),
nx AS (SELECT series_id, height, y, i, len, coalesce(hit.c, y + len) AS e, coalesce(hit.i, {len(_STEPS) - 1}) AS j, CASE WHEN hit IS NULL THEN 'EMERGENCY' WHEN hit.i = i THEN 'SAFE_ZONE' ELSE 'SMART_SHRINK' END AS method FROM fs),
cl AS (SELECT *, CASE WHEN e > y + 4 THEN e WHEN y > 0 AND height - y <= 4 THEN height ELSE least(height, y + greatest(4, len)) END AS stop FROM nx),
z AS (SELECT series_id, 1 AS slice_no, y, stop, method, j, height FROM cl WHERE y = 0 AND i = 0
  UNION ALL SELECT z.series_id, slice_no + 1, cl.y, cl.stop, cl.method, cl.j, z.height FROM z JOIN cl ON cl.series_id = z.series_id AND cl.y = z.stop AND cl.i = z.j WHERE z.stop < z.height)
"""


def safe_cut_slices(spark, sf_dir):
    return L.safe_cut_slices(bands(spark, sf_dir), heights(spark, sf_dir), page=30, up=8, down=4, min_slice=4)


@query("lay_safe_cut_shrink", SAFE_CUTS + f"SELECT series_id, slice_no, y AS y_start, stop AS y_end, method, {_STEP_SCALES}[j + 1] AS scale FROM z")
def lay_safe_cut_shrink(spark, sf_dir):
    return safe_cut_slices(spark, sf_dir)


@query("agg_cut_methods", GAP_CUTS.replace("f AS (", "gc AS (", 1).replace("FROM f JOIN h", "FROM gc f JOIN h") + SAFE_CUTS[SAFE_CUTS.index(", q AS (") :].replace("q AS (", "qb AS (", 1).replace("FROM q GROUP", "FROM qb GROUP") + """
SELECT 'gap' AS loop, method, count(*) AS n, CAST(sum(CAST(round(quality * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 AS mean_quality FROM gc GROUP BY method
UNION ALL SELECT 'safe', method, count(*), NULL FROM z GROUP BY method""")
def agg_cut_methods(spark, sf_dir):
    """How often the two cut loops used each of their methods, and the mean quality of their cuts."""
    gap, safe = (L.cut_counts(cuts(spark, sf_dir)).select(F.lit(name).alias("loop"), "*") for name, cuts in (("gap", gap_cuts), ("safe", safe_cut_slices)))
    return gap.unionByName(safe)


SPLIT = dict(tallest=6, least_part=3, gap=1, wide_gap=2, wide_span=400, media_span=250, media_gap=1)


@query("lay_split_oversized", FRAGMENTS.replace("WITH d AS", "WITH RECURSIVE d AS") + """, v AS (SELECT series_id, object_no, hi AS top, bottom, span, row_number() OVER w AS n, lag(bottom) OVER w AS above, lag(span) OVER w AS sa,
    hi - lo >= 1 AND wider = 0 AND solid >= 0.85 * (hi - lo) AND act <= 90.0 * (hi - lo) AS safe FROM g WINDOW w AS (PARTITION BY series_id, object_no ORDER BY hi)),
ok AS (SELECT * FROM v WHERE above IS NOT NULL AND safe AND top - above >= CASE WHEN greatest(span, sa) >= 400 THEN 2 ELSE 1 END AND NOT (least(span, sa) >= 250 AND top - above <= 1)),
nt AS (SELECT v.series_id, v.object_no, v.n, min(ok.n) AS next FROM v JOIN ok ON ok.series_id = v.series_id AND ok.object_no = v.object_no AND ok.n > v.n AND ok.bottom - v.top > 6 AND ok.above - v.top >= 3 GROUP BY ALL),
hd AS (SELECT series_id, object_no, n, 1 AS part FROM v WHERE n = 1 UNION ALL SELECT hd.series_id, hd.object_no, next, part + 1 FROM hd JOIN nt ON nt.series_id = hd.series_id AND nt.object_no = hd.object_no AND nt.n = hd.n),
pt AS (SELECT v.series_id, v.object_no, v.n, v.top, v.bottom, max(part) AS part FROM v JOIN hd ON hd.series_id = v.series_id AND hd.object_no = v.object_no AND hd.n <= v.n GROUP BY ALL)
SELECT series_id, object_no, part, min(top) AS top, max(bottom) AS bottom, count(*) AS fragments FROM pt GROUP BY ALL""")
def lay_split_oversized(spark, sf_dir):
    """The merged objects, cut where their gaps are valleys by a wider measure than the one that kept them together."""
    listed = materialize(fragments(spark, sf_dir).select("series_id", "object_no", "top", "bottom", "span"))
    beside = S.safe_gaps(rows(spark, sf_dir), listed, 1, F.col("activity") < QUIET, F.col("activity") > 100, max_mean=90.0)
    return L.split_oversized(beside, L.SplitLimits(**SPLIT))


@query("join_object_in_page", f"""WITH {OBJECTS}, p AS (SELECT conv_id, unnest(range(0, max(y_bottom) // 500 + 1)) AS page_no FROM obj GROUP BY conv_id)
SELECT p.conv_id, page_no, object_id FROM p JOIN obj ON obj.conv_id = p.conv_id AND y_top >= page_no * 500 AND y_bottom <= page_no * 500 + 900""")
def join_object_in_page(spark, sf_dir):
    o = objects(spark, sf_dir)
    pages = o.groupBy("conv_id").agg(F.max("y_bottom").alias("h")).select("conv_id", F.explode(F.expr("sequence(0L, h div 500)")).alias("page_no")).select(
        "conv_id", "page_no", (F.col("page_no") * 500).alias("y_start"), (F.col("page_no") * 500 + 900).alias("y_end"))
    return L.objects_in_pages(o, pages).select("conv_id", "page_no", "object_id")


#: Conversations with up to two turns of the one before repeated at their head.
JOINED = """WITH n AS (SELECT conv_id, lead(conv_id) OVER (ORDER BY conv_id) AS next_id, lag(conv_id) OVER (ORDER BY conv_id) AS prev_id FROM (SELECT DISTINCT conv_id FROM conversations)),
own AS (SELECT conv_id, list(text ORDER BY turn) AS ls FROM conversations GROUP BY conv_id),
f AS (SELECT n.conv_id, n.next_id, CASE WHEN p.ls IS NULL OR n.conv_id % 3 = 0 THEN o.ls ELSE list_concat(p.ls[-(n.conv_id % 3):], o.ls) END AS ls
  FROM n JOIN own o ON o.conv_id = n.conv_id LEFT JOIN own p ON p.conv_id = n.prev_id),
k AS (SELECT a.conv_id, a.next_id, a.ls AS x, b.ls AS y, unnest(range(1, least(len(a.ls), len(b.ls)) + 1)) AS k FROM f a JOIN f b ON a.next_id = b.conv_id),
ov AS (SELECT conv_id, next_id, max(k) AS overlap FROM k WHERE x[-k:] = y[:k] GROUP BY ALL)
"""


def joined_turns(spark, sf_dir):
    """(conv_id, pos, h) and (conv_id, next_id, n) of these conversations."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.sha2("text", 256).alias("h"))
    sizes = t.groupBy("conv_id").agg(F.count("*").alias("own"))
    numbered = with_ordinal(sizes, "conv_id", "no")
    linked = with_neighbours(numbered, [], "no", 1, 1, {"prev_id": lambda w: F.lag("conv_id").over(w), "next_id": lambda w: F.lead("conv_id").over(w),
                                                        "prev_own": lambda w: F.lag("own").over(w)})
    head = materialize(linked.select("conv_id", "prev_id", "prev_own", "next_id", "own", F.when(F.col("prev_id").isNull(), 0).otherwise(F.least(F.col("conv_id") % 3, "prev_own")).alias("pre")))
    own = t.join(head.select("conv_id", "pre"), "conv_id").select("conv_id", (F.col("turn") + F.col("pre")).alias("pos"), "h")
    borrowed = t.withColumnRenamed("conv_id", "prev_id").join(head.filter("pre > 0"), "prev_id").filter(F.col("turn") >= F.col("prev_own") - F.col("pre")).select(
        "conv_id", (F.col("turn") - (F.col("prev_own") - F.col("pre"))).alias("pos"), "h")
    order = head.filter("next_id IS NOT NULL").select("conv_id", "next_id", (F.col("own") + F.col("pre")).alias("n"))
    return materialize(own.unionByName(borrowed)), order


@query("lay_overlap_trim", JOINED + "SELECT conv_id, next_id, overlap FROM ov")
def lay_overlap_trim(spark, sf_dir):
    """How many leading turns of each conversation repeat the end of the one before."""
    return L.overlap_lengths(*joined_turns(spark, sf_dir))


@query("lay_trimmed_turns", JOINED + """SELECT f.conv_id, i - 1 - cut AS pos, sha256(ls[i]) AS h FROM (SELECT f.conv_id, ls, CASE WHEN overlap < len(ls) THEN overlap ELSE 0 END AS cut, unnest(range(1, len(ls) + 1)) AS i
  FROM f LEFT JOIN ov ON ov.next_id = f.conv_id) f WHERE i > cut""".replace("THEN overlap ELSE 0", "THEN coalesce(overlap, 0) ELSE 0"))
def lay_trimmed_turns(spark, sf_dir):
    """The turns that are left when the repeated heads are cut off."""
    turns, order = joined_turns(spark, sf_dir)
    return L.trimmed_turns(turns, L.overlap_lengths(turns, order))


@query("lay_validate", PAGES + """, p AS (SELECT conv_id, page_no, y_start, CASE WHEN conv_id % 11 = 0 THEN y_start WHEN conv_id % 7 = 0 THEN y_end + 40 ELSE y_end END AS y_end,
   CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 6 = 0 THEN '0' ELSE object_ids END AS object_ids FROM pages),
x AS (SELECT *, lead(y_start) OVER (PARTITION BY conv_id ORDER BY page_no) AS nx FROM p),
i AS (SELECT conv_id, page_no, unnest(string_split(object_ids, '|')) AS id FROM x WHERE object_ids <> '')
SELECT conv_id, page_no, 'overlap' AS rule, CAST(y_end - nx AS VARCHAR) AS detail FROM x WHERE y_end > nx
UNION ALL SELECT conv_id, page_no, 'range', CAST(y_end - y_start AS VARCHAR) FROM x WHERE y_end <= y_start
UNION ALL SELECT conv_id, page_no, 'empty', CAST(y_end - y_start AS VARCHAR) FROM x WHERE object_ids = '' AND y_end - y_start > 80
UNION ALL SELECT conv_id, max(page_no), 'duplicate', id FROM i GROUP BY conv_id, id HAVING count(*) > 1""")
def lay_validate(spark, sf_dir):
    """The packer's pages, of which some are lengthened, flattened or given wrong ids."""
    conv = F.col("conv_id")
    y_end = F.when(conv % 11 == 0, F.col("y_start")).when(conv % 7 == 0, F.col("y_end") + 40).otherwise(F.col("y_end"))
    ids = F.when(conv % 5 == 0, "").when(conv % 6 == 0, "0").otherwise(F.col("object_ids"))
    pages = tight_pages(spark, sf_dir).select("conv_id", "page_no", "y_start", y_end.alias("y_end"), ids.alias("object_ids"))
    return L.validate_pages(materialize(pages))


@query("lay_global_ids", f"""WITH {OBJECTS}, i AS (SELECT 'obj-y' || y_top || '-' || y_bottom AS id, conv_id FROM obj), f AS (SELECT id, conv_id, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT id, sum(n) AS total, count_if(n > 1) AS within FROM f GROUP BY id)
SELECT count(*) AS ids, count_if(total > 1) AS repeated_ids, CAST(sum(within) AS BIGINT) AS repeated_file_ids FROM g""")
def lay_global_ids(spark, sf_dir):
    o = objects(spark, sf_dir).select("conv_id", F.concat(F.lit("obj-y"), F.col("y_top").cast("string"), F.lit("-"), F.col("y_bottom").cast("string")).alias("object_id"))
    return L.repeated_ids(o, "conv_id")
