"""Streaming queries, run to the end of the present input and read back from their sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from slipweave.functions import fields as X
from slipweave.functions.text import lines
from slipweave.plans.registry import query
from slipweave.session import shared_dir
from slipweave.sources.feeds import slip_feed
from slipweave.sources.sinks import materialize
from slipweave.sources.tables import table
from slipweave.streaming import ingest

SLIP = "idx BIGINT, file_name STRING, file_path STRING, raw_text STRING"


def inbox(spark, sf_dir) -> str:
    folder = shared_dir(spark)
    slip_feed(spark, sf_dir).write.parquet(folder)
    return folder


@query("str_watch_folder", "SELECT idx, file_name, t_amount AS amount FROM @FEED")
def str_watch_folder(spark, sf_dir):
    """Slip texts arriving as files are parsed as they come; a second run finds nothing new."""
    folder, out, mark = inbox(spark, sf_dir), shared_dir(spark), shared_dir(spark)
    for _ in range(2):
        arriving = ingest.watch_folder(spark, folder, SLIP, 3)
        parsed = arriving.select("idx", "file_name", X.amount_cascade(F.col("raw_text"), lines(F.col("raw_text"))).alias("amount"))
        ingest.run_to_end(parsed, out, mark)
    return spark.read.parquet(out)


#: Days of an arrival, arrivals, and the window of the watermark; every 17th event arrives two arrivals later than its day says.
ARRIVAL_DAYS, ARRIVALS, WINDOW_DAYS = 5, 8, 3


@query("str_temporal_dedup", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {ARRIVAL_DAYS} + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS INT) AS b FROM events),
k AS (SELECT unnest(range(0, {ARRIVALS})) AS b), m AS (SELECT k.b, max(ts) - INTERVAL {WINDOW_DAYS} DAY AS mark FROM k LEFT JOIN e ON e.b < k.b GROUP BY k.b),
o AS (SELECT e.*, coalesce(ts < mark, false) AS late FROM e JOIN m USING (b)),
f AS (SELECT user_id, b, min({{'ts': ts, 'id': event_id}}) AS first FROM o WHERE NOT late GROUP BY ALL),
s AS (SELECT user_id, -1 AS b, CAST(NULL AS TIMESTAMP) AS last, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT s.user_id, s.b + 1, CASE WHEN fresh THEN first.ts ELSE last END, CASE WHEN fresh THEN first.id END
  FROM (SELECT s.*, f.first, f.first IS NOT NULL AND coalesce(s.last + INTERVAL {WINDOW_DAYS} DAY <= m.mark, s.last IS NULL) AS fresh FROM s JOIN m ON m.b = s.b + 1 LEFT JOIN f ON f.user_id = s.user_id AND f.b = s.b + 1) s)
SELECT 'kept' AS kind, event_id, user_id FROM s WHERE event_id IS NOT NULL UNION ALL SELECT 'late', event_id, user_id FROM o WHERE late""")
def str_temporal_dedup(spark, sf_dir):
    """Events arrive in several batches, some of them late: ids are new again once the watermark has passed their last row, late rows are a table of their own."""
    folder, out, mark = (shared_dir(spark) for _ in range(3))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.floor(day / ARRIVAL_DAYS) + F.when(F.col("event_id") % 17 == 0, 2).otherwise(0)).alias("b"))
    ev = materialize(ev)
    for arrival in range(ARRIVALS):
        ev.filter(F.col("b") == arrival).drop("b").write.mode("append").parquet(folder)
        stream = ingest.watch_folder(spark, folder, "event_id BIGINT, user_id BIGINT, ts TIMESTAMP", 10_000)
        ingest.keep_late(stream, "user_id", "ts", "event_id", f"{WINDOW_DAYS} DAY", out, mark)
    kinds = [spark.read.parquet(f"{out}/{kind}").select(F.lit(kind).alias("kind"), "event_id", "user_id") for kind in ("kept", "late")]
    return kinds[0].unionByName(kinds[1])


@query("str_append_once", "SELECT idx, file_name FROM @FEED")
def str_append_once(spark, sf_dir):
    """Two runs over the same checkpoint leave every slip exactly once."""
    folder, out, mark = inbox(spark, sf_dir), shared_dir(spark), shared_dir(spark)
    for _ in range(2):
        ingest.append_once(ingest.watch_folder(spark, folder, SLIP, 3).select("idx", "file_name"), out, mark)
    return spark.read.parquet(out).select("idx", "file_name")
