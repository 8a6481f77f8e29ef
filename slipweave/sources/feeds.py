"""Deterministic feeds: the generic test tables rendered as slips, series, files and stage events.

The slip feed is one SQL statement that both Spark and a checking engine can run; only number formatting
is dialect specific. Besides the text it carries the ``t_*`` columns with the values the text was made
from, which the checks use and the jobs never read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from slipweave import rules as R
from slipweave.session import spread
from slipweave.sources.sinks import stored
from slipweave.sources.tables import documents, table

_LETTERS = "translate({0}, '0123456789', 'กขคงจชดตนบ')"
_LATIN = "translate({0}, '0123456789', 'abcdefghik')"
RECEIVERS = 50
# June stays short: its full name contains a sender title, which the party rules take for a label
FULL_MONTHS = [short if number == 6 else full for number, (full, short) in enumerate(R.THAI_MONTHS, start=1)]
TEXT_CODES = ["KTB", "GSB", "UOB", "BBL", "SCB", "TTB"]


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def thai_name(number: str, title: str) -> str:
    """SQL text: a name spelled from the digits of a number."""
    first = _LETTERS.format(f"lpad(cast({number} AS {{str}}), 6, '0')")
    last = _LETTERS.format(f"lpad(cast(({number} * 31) % 10000 AS {{str}}), 4, '0')")
    return f"concat({title}, ' ', {first}, ' ', {last})"


def slip_feed_sql(dialect: str = "spark", source: str = "orders") -> str:
    string = "STRING" if dialect == "spark" else "VARCHAR"
    money = "format_number(amt, 2)" if dialect == "spark" else "format('{:,.2f}', amt)"
    unnest = ("LATERAL VIEW explode(sequence(0, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END)) c AS copy_no"
              if dialect == "spark" else
              ", LATERAL (SELECT unnest(range(0, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END)) AS copy_no) c")
    codes = [c for c, _ in R.BANK_NAMES]
    names = [n for _, n in R.BANK_NAMES]
    digits = lambda e, n: f"lpad(cast({e} AS {string}), {n}, '0')"
    return f"""
SELECT idx, file_name, file_path, raw_text, t_key, t_copy, t_empty, t_bank, t_bank_name, t_amount, t_date, t_time, t_ref, t_clock,
       t_sender, t_sender_acc, t_receiver, t_receiver_acc, t_receiver_bank, t_memo, t_merchant, t_labelled, t_amount_labelled,
       t_date_form, t_ref_digits, t_receiver_no
FROM (
SELECT k * 2 + copy_no AS idx,
       concat('slip_', {digits('k', 10)}, '_', cast(copy_no AS {string}), '.jpg') AS file_name,
       concat('/evidence/', {digits('k % 100', 2)}, '/slip_', {digits('k', 10)}, '_', cast(copy_no AS {string}), '.jpg') AS file_path,
       CASE WHEN k % 29 = 0 THEN '' ELSE concat_ws(chr(10),
         concat(bank_nm, ' ', bank_cd),
         CASE WHEN merchant THEN 'จ่ายบิลสำเร็จ' ELSE 'โอนเงินสำเร็จ' END,
         CASE WHEN amount_labelled THEN concat('จำนวนเงิน ', {money}, ' บาท') ELSE {money} END,
         'ค่าธรรมเนียม 0.00',
         concat_ws(' ', date_part_text, clock_text),
         CASE WHEN labelled THEN concat('จาก: ', sender) ELSE sender END,
         concat('XXX-X-XX', {digits('cust % 1000', 3)}, '-', cast(cust % 10 AS {string})),
         CASE WHEN labelled THEN 'ไปยัง' END,
         receiver,
         receiver_acc,
         CASE WHEN merchant THEN bank_cd ELSE recv_cd END,
         CASE WHEN k % 3 = 0 THEN concat('บันทึกช่วยจำ: ', memo_text) END,
         CASE WHEN k % 3 = 1 THEN 'บันทึกช่วยจํา' END,
         CASE WHEN k % 3 = 1 THEN memo_text END,
         concat(ref_label, ref_digits)) END AS raw_text,
       k AS t_key, copy_no AS t_copy, k % 29 = 0 AS t_empty,
       CASE WHEN k % 29 = 0 THEN 'UNKNOWN' ELSE bank_cd END AS t_bank,
       CASE WHEN k % 29 = 0 THEN '{R.UNKNOWN_BANK[1]}' ELSE bank_nm END AS t_bank_name,
       CASE WHEN k % 29 <> 0 THEN amt END AS t_amount,
       CASE WHEN k % 29 <> 0 THEN day END AS t_date,
       CASE WHEN k % 29 <> 0 AND k % 7 <> 0 THEN concat({digits('hh', 2)}, ':', {digits('mi', 2)}) END AS t_time,
       CASE WHEN k % 29 <> 0 THEN CASE WHEN merchant AND k % 4 <> 1 THEN merchant_acc ELSE ref_digits END END AS t_ref,
       clock_text AS t_clock,
       CASE WHEN k % 29 <> 0 THEN sender END AS t_sender,
       CASE WHEN k % 29 <> 0 THEN concat('XXX-X-XX', {digits('cust % 1000', 3)}, '-', cast(cust % 10 AS {string})) END AS t_sender_acc,
       CASE WHEN k % 29 <> 0 THEN receiver END AS t_receiver,
       CASE WHEN k % 29 <> 0 THEN receiver_acc END AS t_receiver_acc,
       CASE WHEN k % 29 <> 0 AND NOT merchant THEN recv_cd END AS t_receiver_bank,
       CASE WHEN k % 29 <> 0 AND k % 3 <> 2 THEN memo_text END AS t_memo,
       merchant AS t_merchant, labelled AS t_labelled, amount_labelled AS t_amount_labelled, k % 4 AS t_date_form,
       ref_digits AS t_ref_digits, recv_no AS t_receiver_no
FROM (
SELECT *, concat({digits('yy', 4)}, {digits('mm', 2)}, {digits('dd', 2)}, {digits('hh', 2)}, {digits('mi', 2)}, {digits('k', 8)}) AS ref_digits,
       CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 3 THEN concat({digits('hh', 2)}, '.', {digits('mi', 2)}, ' น.')
            ELSE concat({digits('hh', 2)}, ':', {digits('mi', 2)}, ' น.') END AS clock_text,
       CASE k % 4 WHEN 0 THEN concat('วันที่ ', {digits('dd', 2)}, '/', {digits('mm', 2)}, '/', cast(yy + 543 AS {string}))
                  WHEN 1 THEN concat(cast(dd AS {string}), ' ', {_case('mm - 1', [s for _, s in R.THAI_MONTHS])}, ' ', cast(yy + 543 - 2500 AS {string}), ',')
                  WHEN 3 THEN concat(cast(dd AS {string}), ' ', {_case('mm - 1', FULL_MONTHS)}, ' ', cast(yy + 543 AS {string})) END AS date_part_text,
       CASE WHEN merchant THEN merchant_acc ELSE concat('XXX-X-XX', {digits('recv_no * 7 % 1000', 3)}, '-', cast(recv_no % 10 AS {string})) END AS receiver_acc,
       {thai_name('cust', "'นาย'").format(str=string)} AS sender,
       CASE WHEN merchant THEN concat('Siri ', 'Mart ', {_LATIN.format(digits('recv_no', 4))})
            ELSE {thai_name('recv_no', "'น.ส.'").format(str=string)} END AS receiver,
       CASE WHEN k % 4 = 1 THEN 'เลขอ้างอิง ' ELSE 'รหัสอ้างอิง: ' END AS ref_label,
       concat('ค่าสินค้า ', {_LETTERS.format(digits('k % 1000', 3))}) AS memo_text
FROM (
SELECT o_orderkey AS k, o_custkey AS cust, (o_orderkey * 7 + o_custkey) % {RECEIVERS} AS recv_no, copy_no,
       o_totalprice AS amt, cast(o_orderdate + INTERVAL 28 YEAR AS DATE) AS day,
       cast(extract(year FROM o_orderdate) AS INT) + 28 AS yy, cast(extract(month FROM o_orderdate) AS INT) AS mm,
       cast(extract(day FROM o_orderdate) AS INT) AS dd, (o_orderkey % 24) AS hh, (o_orderkey * 7 % 60) AS mi,
       {_case('o_custkey % 14', codes)} AS bank_cd, {_case('o_custkey % 14', names)} AS bank_nm,
       {_case('o_orderkey % 6', TEXT_CODES)} AS recv_cd,
       o_orderkey % 13 = 5 AS merchant, o_orderkey % 2 = 0 AS labelled, o_orderkey % 3 <> 2 AS amount_labelled,
       concat('0107536', {digits('o_custkey % 100000000', 8)}) AS merchant_acc
FROM {source} {unnest}
) base ) parts ) feed"""


def slip_feed(spark: SparkSession, sf_dir: str, truth: bool = False) -> DataFrame:
    """idx, file_name, file_path, raw_text; with ``truth`` also the values behind the text."""
    def build():
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        spread(orders, "o_orderkey").createOrReplaceTempView("slipweave_orders")
        return spark.sql(slip_feed_sql("spark", "slipweave_orders"))
    df = stored(spark, f"slips:{sf_dir}", build)
    return df if truth else df.select("idx", "file_name", "file_path", "raw_text")


def row_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, y, activity, span: the lines of a document as an ordered activity series. The texts are split into lines once, all series queries read the written rows."""
    def build():
        docs = documents(spark, sf_dir, "text")
        return docs.select(F.col("doc_id").alias("series_id"), F.posexplode(F.split("text", "\n")).alias("y", "line")).select(
            "series_id", F.col("y").cast("bigint").alias("y"), F.length("line").cast("double").alias("activity"),
            F.length("line").cast("double").alias("span"))
    return stored(spark, f"series rows:{sf_dir}", build)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text, height: conversation turns with the height they take on a page."""
    return table(spark, sf_dir, "conversations").withColumn(
        "height", (F.lit(56) + F.lit(22) * F.ceil(F.length("text") / F.lit(48))).cast("bigint"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, name, path, length: a file index with repeated names and case variants."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    stem = F.concat(F.col("source"), F.lit("_"), (F.col("doc_id") % 700).cast("string"))
    name = F.when(F.col("doc_id") % 11 == 3, F.concat(F.upper(stem), F.lit(".JPG"))).otherwise(F.concat(stem, F.lit(".jpg")))
    return docs.select(F.col("doc_id").alias("pos"), name.alias("name"), F.concat(
        F.lit("/store/"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), name).alias("path"),
        F.col("n_chars").cast("bigint").alias("length"))


def name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, line: requested file names as raw text lines, with blanks, repeats and unknown names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    line = (F.when(F.col("doc_id") % 9 == 0, F.lit("   "))
            .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("lost_"), (F.col("doc_id") % 300).cast("string"), F.lit(".jpg")))
            .otherwise(F.concat(F.lit("  "), "source", F.lit("_"), (F.col("doc_id") % 350).cast("string"), F.lit(".jpg "))))
    return docs.select(F.col("doc_id").alias("pos"), line.alias("line"))


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, stream, stage, start, status, error: one log line per event of a user stream."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("user_id").alias("stream"),
                     F.when(F.col("event_type") == "signup", "INPUT").otherwise(F.upper("event_type")).alias("stage"),
                     F.col("ts").cast("timestamp").alias("start"),
                     F.when(F.col("event_type") == "error", "ERROR").when(F.col("value") < 2, "SKIPPED").otherwise("PASS")
                     .alias("status"))


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """period, rate_satang: one rate per working day (mean event value), weekends and every third week missing."""
    ev = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return (ev.groupBy(day.alias("period")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("s"), F.count("*").alias("n"))
            .filter(F.dayofweek("period").between(2, 6) & (F.day("period") % 10 < 6))
            .select("period", F.expr("s div n").alias("rate_satang")))
