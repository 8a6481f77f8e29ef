"""Target matching, fingerprint, dedup, selections, summaries and ledgers over the slip feed."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipweave import rules as R
from slipweave.functions import text as T
from slipweave.operators import match as M
from slipweave.operators.slips import parse_slips
from slipweave.plans.registry import query
from slipweave.sources.feeds import RECEIVERS, slip_feed, thai_name
from slipweave.sources.sinks import materialize, stored
from slipweave.sources.tables import table

# the single-target queries ask for the receiver number 7
TARGET_SQL = thai_name("7", "'น.ส.'")


def target_name(number: int = 7) -> str:
    spell = str.maketrans("0123456789", "กขคงจชดตนบ")
    return f"น.ส.  {str(number).zfill(6).translate(spell)} {str(number * 31 % 10000).zfill(4).translate(spell)}"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed fact table, written once, so that several passes and reports do not parse again."""
    return stored(spark, f"facts:{sf_dir}", lambda: M.fact_rows(parse_slips(slip_feed(spark, sf_dir))))


# truth of the feed: the columns the rules should arrive at
TRUTH = """
WITH f AS (SELECT *, NOT t_empty AS is_slip,
    t_time IS NOT NULL AND NOT t_empty AS complete,
    concat('{"amount": "', printf('%.2f', t_amount), '", "receiver_bank": "', coalesce(bn.n, ''), '", "receiver_name": "', t_receiver,
       '", "sender_bank": "", "sender_name": "', t_sender, '", "transaction_date": "', strftime(t_date, '%Y-%m-%d'),
       '", "transaction_id": "', t_ref, '", "transaction_time": "', t_time, '"}') AS canon
  FROM @FEED x LEFT JOIN (VALUES ('KTB','ธนาคารกรุงไทย'),('GSB','ธนาคารออมสิน'),('UOB','ธนาคารยูโอบี'),('BBL','ธนาคารกรุงเทพ'),
       ('SCB','ธนาคารไทยพาณิชย์'),('TTB','ธนาคารทหารไทยธนชาต')) bn(c, n) ON bn.c = x.t_receiver_bank)
, fp AS (SELECT *, CASE WHEN complete THEN sha256(canon) END AS fingerprint FROM f)
"""
MATCHED = TRUTH + f"""
, m AS (SELECT *, coalesce(t_receiver, '') = {TARGET_SQL.format(str='VARCHAR')} AS target_matched FROM fp)
, d AS (SELECT *, CASE WHEN is_slip AND target_matched AND fingerprint IS NOT NULL
       THEN first_value(file_name) OVER (PARTITION BY is_slip, target_matched, fingerprint ORDER BY idx) END AS orig,
       CASE WHEN is_slip AND target_matched AND fingerprint IS NULL THEN 'INCOMPLETE_DEDUP_FIELDS' END AS review_reason FROM m)
, r AS (SELECT *, coalesce(orig <> file_name, false) AS duplicate, CASE WHEN orig <> file_name THEN orig END AS duplicate_of,
       review_reason IS NOT NULL AS review_required FROM d)
"""


def matched(df: DataFrame) -> DataFrame:
    return df.withColumn("target_matched", M.target_match(target_name(), F.col("receiver_name"), F.col("raw_text")))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.flag_duplicates(matched(facts(spark, sf_dir)))


@query("flt_probable_slip", TRUTH + "SELECT idx AS index, is_slip FROM fp")
def flt_probable_slip(spark, sf_dir):
    return facts(spark, sf_dir).select("index", "is_slip")


@query("flt_target_match", MATCHED + "SELECT idx AS index, file_name FROM m WHERE target_matched")
def flt_target_match(spark, sf_dir):
    return matched(facts(spark, sf_dir)).filter("target_matched").select("index", "file_name")


@query("win_fingerprint", TRUTH + "SELECT idx AS index, fingerprint FROM fp")
def win_fingerprint(spark, sf_dir):
    return facts(spark, sf_dir).select("index", "fingerprint")


@query("flt_fingerprint_complete", TRUTH + "SELECT idx AS index, t_amount AS amount FROM fp WHERE complete")
def flt_fingerprint_complete(spark, sf_dir):
    return facts(spark, sf_dir).filter(F.col("fingerprint").isNotNull()).select("index", "amount")


@query("win_dedup_first", MATCHED + "SELECT idx AS index, duplicate, duplicate_of, review_required, review_reason FROM r")
def win_dedup_first(spark, sf_dir):
    return flagged(spark, sf_dir).select("index", "duplicate", "duplicate_of", "review_required", "review_reason")


@query("join_duplicate_link", TRUTH + """
, g AS (SELECT *, min(idx) OVER (PARTITION BY fingerprint) AS o FROM fp WHERE fingerprint IS NOT NULL)
SELECT g.file_name, p.file_name AS original FROM g JOIN g p ON g.o = p.idx WHERE g.idx <> g.o""")
def join_duplicate_link(spark, sf_dir):
    every = facts(spark, sf_dir).withColumn("target_matched", F.lit(True))
    return M.flag_duplicates(every).filter("duplicate").select("file_name", F.col("duplicate_of").alias("original"))


@query("flt_selection_sets", MATCHED + """
SELECT idx AS index, file_name, t_amount AS amount, duplicate_of, review_reason, CASE WHEN duplicate THEN 'duplicate' WHEN is_slip AND target_matched AND review_required THEN 'review'
            WHEN is_slip AND target_matched AND t_amount IS NOT NULL THEN 'unique' END AS selection FROM r WHERE duplicate OR is_slip AND target_matched AND (review_required OR t_amount IS NOT NULL)""")
def flt_selection_sets(spark, sf_dir):
    """The rows of the three subsets: slips that count, slips to review, duplicates."""
    chosen = M.selection(flagged(spark, sf_dir)).filter("selection <> 'none'")
    return chosen.select("index", "file_name", "amount", "duplicate_of", "review_reason", "selection")


SUMMARY_SQL = """count(*) AS scanned_files, count(*) AS processed_files, count_if(is_slip) AS probable_slips,
  count_if(target_matched) AS matched_raw_before_dedup, count_if(target_matched) AS target_matched,
  count_if(is_slip AND target_matched AND NOT duplicate AND NOT review_required) AS unique_matched,
  count_if(duplicate) AS duplicates_excluded, count_if(review_required) AS review_required, count_if(t_empty) AS ocr_failed,
  coalesce(sum(CASE WHEN is_slip AND target_matched AND NOT duplicate AND NOT review_required
      THEN CAST(round(t_amount * 100) AS BIGINT) END), 0) / 100.0 AS total_amount"""


@query("agg_lawyer_summary", MATCHED + f"SELECT {SUMMARY_SQL} FROM r")
def agg_lawyer_summary(spark, sf_dir):
    return M.lawyer_summary(flagged(spark, sf_dir))


@query("slip_target_report", TRUTH + f"""
, t AS (SELECT s_suppkey, {thai_name('s_suppkey', "'น.ส.'").format(str='VARCHAR')} AS target FROM supplier)
, m AS (SELECT f.*, t.s_suppkey, t.target, true AS target_matched FROM fp f JOIN t ON f.t_receiver = t.target)
, r AS (SELECT *, fingerprint IS NULL AS review_required, fingerprint IS NOT NULL AND
     row_number() OVER (PARTITION BY s_suppkey, fingerprint ORDER BY idx) > 1 AS duplicate FROM m)
SELECT s_suppkey, target, count(*) AS matched, count_if(NOT duplicate AND NOT review_required) AS unique_matched,
  count_if(duplicate) AS duplicates_excluded, count_if(review_required) AS review_required,
  coalesce(sum(CASE WHEN NOT duplicate AND NOT review_required THEN CAST(round(t_amount * 100) AS BIGINT) END), 0) / 100.0 AS total_amount
FROM r GROUP BY ALL""")
def slip_target_report(spark, sf_dir):
    """Per target: what was paid without duplicates and what needs review."""
    names = thai_name("s_suppkey", "'น.ส.'").format(str="STRING")
    targets = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(names).alias("target"))
    pairs = materialize(M.match_targets(facts(spark, sf_dir), targets).drop("raw_text").withColumn("target_matched", F.lit(True)))
    done = M.lawyer_summary(M.flag_duplicates(pairs, ["s_suppkey"]), ["s_suppkey", "target"])
    return done.select("s_suppkey", "target", F.col("target_matched").alias("matched"), "unique_matched", "duplicates_excluded",
                       "review_required", "total_amount")
