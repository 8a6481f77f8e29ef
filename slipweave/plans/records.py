"""Sinks and their read-back, ledgers, stamps, duplicates, rates, redaction and near copies."""
from __future__ import annotations

from pyspark.sql import functions as F

from slipweave.operators import documents as D
from slipweave.operators import ledger as G
from slipweave.operators import match as M
from slipweave.plans.registry import query
from slipweave.plans.slip_reports import MATCHED, SUMMARY_SQL, TRUTH, facts, flagged, target_name
from slipweave.session import shared_dir
from slipweave.sources import scan, sinks
from slipweave.sources.tables import documents, table


@query("src_audit_json", MATCHED + """SELECT file_name, CASE WHEN idx % 2 = 0 THEN '/images/' || file_name ELSE file_path END AS file_path, strftime(t_date, '%Y-%m-%d') AS transaction_date, t_time AS transaction_time,
  t_amount AS amount, 'THB' AS currency, t_sender AS sender_name, duplicate, duplicate_of, review_required, review_reason FROM r WHERE target_matched""")
def src_audit_json(spark, sf_dir):
    """Audit documents of three shapes and a broken one in one folder are read back and replayed for a target; half of the images are found under a root."""
    path = shared_dir(spark)
    f = facts(spark, sf_dir).drop("fingerprint")
    for k, shape in enumerate(sinks.SHAPES):
        sinks.write_audit_documents(f.filter(F.expr(f"index div 1000 % 3 = {k}")), path, shape=shape, mode="append")
    spark.createDataFrame([("{broken",), ('{"results": "none"}',), ("7",)], "value string").write.mode("append").text(path)
    images = f.filter("index % 2 = 0").select(F.col("file_name").alias("name"), F.concat(F.lit("/images/"), "file_name").alias("path"))
    done = M.replay_audit(scan.read_audit(spark, path, multi_line=False, images=images), target_name())
    return done.select("file_name", "file_path", "transaction_date", "transaction_time", "amount", "currency", "sender_name", "duplicate", "duplicate_of", "review_required", "review_reason")


@query("src_audit_problems", """WITH d AS (SELECT idx // 1000 AS document_no, count(*) AS scanned_files FROM @FEED GROUP BY 1)
SELECT document_no, scanned_files, CAST(scanned_files AS INT) AS results, 0 AS skipped, NULL AS problem FROM d
UNION ALL SELECT NULL, NULL, 0, 0, problem FROM (VALUES ('NOT_JSON'), ('RESULTS_NOT_A_LIST'), ('NOT_AN_OBJECT')) v(problem)
UNION ALL SELECT NULL, NULL, 3, 2, NULL""")
def src_audit_problems(spark, sf_dir):
    """What each audit document says of itself; documents that can't be read are rows as well."""
    path = shared_dir(spark)
    sinks.write_audit_documents(facts(spark, sf_dir).drop("fingerprint"), path)
    broken = ["{broken", '{"results": "none"}', "7", '{"results": [null, {"amount": 1}, 5]}']
    spark.createDataFrame([(t,) for t in broken], "value string").write.mode("append").text(path)
    return scan.audit_summaries(scan.audit_documents(spark, path, multi_line=False)).select("document_no", "scanned_files", "results", "skipped", "problem")


AUDIT_COLUMNS = ("index BIGINT, file_path STRING, file_name STRING, file_hash STRING, raw_text STRING, is_slip BOOLEAN, target_matched BOOLEAN, duplicate BOOLEAN, duplicate_of STRING, "
                 "review_required BOOLEAN, review_reason STRING, transaction_date DATE, transaction_time STRING, sender_bank STRING, sender_name STRING, sender_account STRING, receiver_bank STRING, "
                 "receiver_name STRING, receiver_account STRING, amount DOUBLE, currency STRING, transaction_id STRING, memo STRING, bank_name STRING, fingerprint STRING, error STRING")


@query("sink_audit_json", MATCHED + """SELECT idx AS index, file_path, file_name, sha256(raw_text) AS file_hash, sha256(raw_text) AS raw_text_sha256, is_slip, target_matched, duplicate, duplicate_of, review_required, review_reason,
  t_date AS transaction_date, t_time AS transaction_time, CAST(NULL AS VARCHAR) AS sender_bank, t_sender AS sender_name, t_sender_acc AS sender_account, bn.n AS receiver_bank, t_receiver AS receiver_name, t_receiver_acc AS receiver_account,
  t_amount AS amount, 'THB' AS currency, t_ref AS transaction_id, t_memo AS memo, t_bank_name AS bank_name, fingerprint, CASE WHEN t_empty THEN 'EMPTY_TEXT' END AS error, 'SHA256:' || sha256(raw_text) AS integrity_hash,
  CASE WHEN t_date IS NULL THEN 'UNKNOWN' WHEN t_time IS NULL THEN strftime(t_date, '%Y-%m-%d') ELSE strftime(t_date, '%Y-%m-%d') || '  /  ' || t_time END AS transaction_date_time FROM r
  LEFT JOIN (VALUES ('KTB','ธนาคารกรุงไทย'),('GSB','ธนาคารออมสิน'),('UOB','ธนาคารยูโอบี'),('BBL','ธนาคารกรุงเทพ'),('SCB','ธนาคารไทยพาณิชย์'),('TTB','ธนาคารทหารไทยธนชาต')) bn(c, n) ON bn.c = t_receiver_bank""")
def sink_audit_json(spark, sf_dir):
    """Rows of all 26 columns, nested reports and summary are written as JSON; the rows are read back."""
    path = shared_dir(spark)
    f = flagged(spark, sf_dir)
    sinks.write_audit(G.nested_report(f, *[c for c in f.columns if c != "index"]), M.lawyer_summary(f), path)
    back = spark.read.schema(AUDIT_COLUMNS + ", report STRUCT<forensics_analysis: STRUCT<integrity_hash: STRING>, "
                             "extracted_transaction_metadata: STRUCT<transaction_date_time: STRING>>").json(f"{path}/results")
    return back.select("*", F.sha2("raw_text", 256).alias("raw_text_sha256"), "report.forensics_analysis.integrity_hash", "report.extracted_transaction_metadata.transaction_date_time").drop("raw_text", "report")


@query("sink_audit_summary", MATCHED + f"SELECT {SUMMARY_SQL} FROM r")
def sink_audit_summary(spark, sf_dir):
    """The summary file beside the audit rows, read back."""
    path = shared_dir(spark)
    f = flagged(spark, sf_dir)
    summary = M.lawyer_summary(f)
    sinks.write_audit(f.select("index", "file_name"), summary, path)
    return spark.read.schema(summary.schema).json(f"{path}/summary")


@query("sink_records_append", TRUTH + """, b AS (SELECT *, idx % 2 AS batch, (idx % 2) * 4294967296 + row_number() OVER (PARTITION BY idx % 2 ORDER BY idx) AS id FROM fp)
SELECT id, batch, 'DE-2026-0528' AS case_number, t_bank_name AS bank_name, coalesce(t_sender, 'UNKNOWN') AS sender_name, coalesce(t_ref, 'UNKNOWN') AS transaction_id, coalesce(t_amount, 0.0) AS amount,
 CASE WHEN t_date IS NULL THEN 'UNKNOWN' WHEN t_time IS NULL THEN strftime(t_date, '%Y-%m-%d') ELSE strftime(t_date, '%Y-%m-%d') || '  /  ' || t_time END AS transaction_date FROM b""")
def sink_records_append(spark, sf_dir):
    """Two batches, of which the first is written again: the table stays the same and all ids are different."""
    path = shared_dir(spark)
    f = facts(spark, sf_dir)
    for batch in (0, 1, 0):
        sinks.append_records(f.filter(F.col("index") % 2 == batch), path, batch=batch)
    return spark.read.parquet(path).select("id", F.col("batch").cast("bigint").alias("batch"), "case_number", "bank_name", "sender_name", "transaction_id", "amount", "transaction_date")


LEDGER = TRUTH + """, l AS (SELECT idx AS index, row_number() OVER (ORDER BY idx) AS no, coalesce(strftime(t_date, '%Y-%m-%d'), '-') AS date, coalesce(CASE WHEN t_date IS NOT NULL THEN t_time END, '-') AS time,
  CASE WHEN t_empty THEN '-' ELSE t_bank_name END AS bank, coalesce(t_sender, '-') AS sender, coalesce(t_receiver, '-') AS receiver,
  coalesce(format('{:,.2f}', t_amount) || ' THB', '-') AS amount, coalesce(CAST(round(t_amount * 100) AS BIGINT), 0) AS satang, coalesce(bn.n, '-') AS receiver_bank, coalesce(t_memo, '-') AS memo FROM fp
  LEFT JOIN (VALUES ('KTB','ธนาคารกรุงไทย'),('GSB','ธนาคารออมสิน'),('UOB','ธนาคารยูโอบี'),('BBL','ธนาคารกรุงเทพ'),('SCB','ธนาคารไทยพาณิชย์'),('TTB','ธนาคารทหารไทยธนชาต')) bn(c, n) ON bn.c = t_receiver_bank)
"""


@query("win_sequence", LEDGER + "SELECT no, index, date, time, bank, sender, receiver, receiver_bank, amount, memo FROM l")
def win_sequence(spark, sf_dir):
    return G.ledger_rows(facts(spark, sf_dir)).select("no", "index", "date", "time", "bank", "sender", "receiver", "receiver_bank", "amount", "memo")


@query("win_page_20", LEDGER + """, g AS (SELECT CAST(ceil(max(no) / 20.0) AS BIGINT) AS last, sum(satang) / 100.0 AS total FROM l)
SELECT no, CAST(ceil(no / 20.0) AS BIGINT) AS page_no, amount, CASE WHEN ceil(no / 20.0) = last THEN total END AS grand_total FROM l, g""")
def win_page_20(spark, sf_dir):
    return G.pages_of(G.ledger_rows(facts(spark, sf_dir))).select("no", "page_no", "amount", "grand_total")


@query("sink_ledger_pages", LEDGER + "SELECT no, CAST(ceil(no / 20.0) AS BIGINT) AS page_no, sender, amount FROM l")
def sink_ledger_pages(spark, sf_dir):
    path = shared_dir(spark)
    sinks.write_ledger_pages(G.pages_of(G.ledger_rows(facts(spark, sf_dir))), path)
    return spark.read.parquet(path).select("no", "page_no", "sender", "amount")


@query("agg_slip_total", LEDGER + "SELECT count_if(NOT (date = '-' AND time = '-' AND bank = '-' AND sender = '-' AND receiver = '-' AND receiver_bank = '-' AND amount = '-' AND memo = '-')) AS completed, sum(satang) / 100.0 AS total FROM l")
def agg_slip_total(spark, sf_dir):
    from slipweave.functions.text import first_number, satang
    rows = G.ledger_rows(facts(spark, sf_dir))
    return rows.filter(G.has_extracted(rows)).agg(F.count("*").alias("completed"), (F.sum(satang(first_number(F.col("amount")))) / F.lit(100.0)).alias("total"))


@query("flt_has_extracted", LEDGER + """, m AS (SELECT *, index % 11 < 4 AS only_memo FROM l)
SELECT index, CASE WHEN index % 11 < 2 THEN memo <> '-' WHEN only_memo THEN receiver_bank <> '-'
  ELSE NOT (date = '-' AND time = '-' AND bank = '-' AND sender = '-' AND receiver = '-' AND receiver_bank = '-' AND amount = '-' AND memo = '-') END AS extracted FROM m""")
def flt_has_extracted(spark, sf_dir):
    """Which rows hold anything, when some of them have lost all cells but the memo or the receiver's bank."""
    rows = G.ledger_rows(facts(spark, sf_dir))
    part = F.col("index") % 11
    lost = {c: F.when(part < 4, "-").otherwise(F.col(c)) for c in ("date", "time", "bank", "sender", "receiver", "amount")}
    kept = {"memo": F.when(part.between(2, 3), "-").otherwise(F.col("memo")), "receiver_bank": F.when(part < 2, "-").otherwise(F.col("receiver_bank"))}
    cut = rows.withColumns({**lost, **kept})
    return cut.select("index", G.has_extracted(cut).alias("extracted"))


@query("agg_ledger_bottom", TRUTH + """SELECT coalesce(sum(CAST(round(t_amount * 100) AS BIGINT)) FILTER (idx % 5 < 2), 0) / 100.0 AS total_sum,
 coalesce(CAST(sum(CAST(round(t_amount * 100) AS BIGINT)) FILTER (idx % 5 < 2) AS DOUBLE) / count(t_amount) FILTER (idx % 5 < 2) / 100.0::DOUBLE, 0) AS average_amount, '' AS note FROM fp""")
def agg_ledger_bottom(spark, sf_dir):
    status = F.get(F.array(*[F.lit(s) for s in ("accepted", "verified", "rejected", "manual_review", "duplicate_candidate")]), (F.col("index") % 5).cast("int"))
    return G.bottom_line(facts(spark, sf_dir).select("amount", status.alias("status")))


@query("agg_batch_summary", TRUTH + """SELECT count(*) AS total_files, count(*) AS processed_files, count_if(NOT t_empty) AS success_count, count_if(t_empty) AS failure_count,
 '[' || coalesce(string_agg('{"index":' || idx || ',"file_name":"' || file_name || '","error":"EMPTY_TEXT"}', ',' ORDER BY idx) FILTER (t_empty), '') || ']' AS failed_files,
 CAST(sum(length(raw_text)) AS DOUBLE) / count(*) / 1000 AS avg_seconds FROM fp""")
def agg_batch_summary(spark, sf_dir):
    """Counters, failed files as JSON and mean time; the time of a slip stands for the length of its text here."""
    done = G.batch_summary(facts(spark, sf_dir).select(*G.FAILED, F.length("raw_text").alias("millis")))
    return done.withColumn("failed_files", F.to_json("failed_files"))


@query("agg_batch_failures", "SELECT idx AS index, file_name, 'EMPTY_TEXT' AS error FROM @FEED WHERE t_empty")
def agg_batch_failures(spark, sf_dir):
    return G.failed_files(facts(spark, sf_dir))


@query("doc_ledger_11", MATCHED + """SELECT row_number() OVER (ORDER BY idx) AS sequence, t_date AS transaction_date, t_time AS transaction_time, t_bank_name AS bank_from, substr(t_sender, 5) AS sender_name,
  CAST(round(t_amount * 100) AS BIGINT) AS amount_satang, CASE WHEN t_merchant THEN t_receiver ELSE substr(t_receiver, 6) END AS receiver_name,
  CASE t_receiver_bank WHEN 'KTB' THEN 'ธนาคารกรุงไทย' WHEN 'GSB' THEN 'ธนาคารออมสิน' WHEN 'UOB' THEN 'ธนาคารยูโอบี' WHEN 'BBL' THEN 'ธนาคารกรุงเทพ' WHEN 'SCB' THEN 'ธนาคารไทยพาณิชย์' WHEN 'TTB' THEN 'ธนาคารทหารไทยธนชาต' END AS bank_to,
  t_ref AS transaction_id, t_memo AS memo, CASE WHEN t_empty THEN 'rejected' WHEN duplicate THEN 'duplicate_candidate' WHEN review_required THEN 'manual_review' ELSE 'verified' END AS status FROM r""")
def doc_ledger_11(spark, sf_dir):
    return G.eleven_columns(flagged(spark, sf_dir))


@query("doc_dedupe_multikey", TRUTH + """, g AS (SELECT idx, min(idx) OVER (PARTITION BY raw_text) AS h, CASE WHEN t_time IS NOT NULL AND t_date IS NOT NULL THEN
   min(idx) OVER (PARTITION BY t_bank, t_amount, t_date, t_time, right(regexp_replace(t_sender_acc, '[^0-9]', '', 'g'), 4)) END AS s FROM fp)
SELECT idx AS index, h < idx OR coalesce(s < idx, false) AS duplicate_candidate, concat_ws('|', CASE WHEN h < idx THEN 'raw_sha256' END, CASE WHEN s < idx THEN 'field_signature' END) AS rationale FROM g""")
def doc_dedupe_multikey(spark, sf_dir):
    return G.duplicate_candidates(facts(spark, sf_dir))


@query("doc_evidence_stamp", TRUTH + """, n AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS k FROM fp),
e AS (SELECT *, 'EV-' || lpad(CAST(k // 500 AS VARCHAR), 6, '0') || '-' || lpad(CAST(k % 500 + 1 AS VARCHAR), 4, '0') AS evidence_id FROM n)
SELECT idx AS index, evidence_id, sha256(concat_ws('|', sha256(raw_text), coalesce(t_ref, ''), coalesce(printf('%.2f', t_amount), ''), evidence_id)) AS digest FROM e""")
def doc_evidence_stamp(spark, sf_dir):
    return G.evidence_stamps(facts(spark, sf_dir))


@query("join_fx_asof", """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS period, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS rate_satang FROM orders
   GROUP BY 1 HAVING isodow(CAST(o_orderdate AS DATE)) <= 5 AND day(CAST(o_orderdate AS DATE)) % 10 < 6),
s AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT l_orderkey, l_linenumber, s.day, CASE WHEN s.day - r.period <= 5 THEN r.period END AS period, CASE WHEN s.day - r.period <= 5 THEN CAST(r.rate_satang AS DOUBLE) / 100.0::DOUBLE END AS rate
FROM s ASOF LEFT JOIN r ON s.day >= r.period""")
def join_fx_asof(spark, sf_dir):
    """The day an item is shipped meets the latest rate: the mean order of a working day, with days missing."""
    paid = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("period"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    rates = orders.groupBy("period").agg(F.sum("v").alias("s"), F.count("*").alias("n")).filter(F.dayofweek("period").between(2, 6) & (F.day("period") % 10 < 6))
    return G.with_rate(paid, "day", rates.select("period", F.expr("s div n").alias("rate_satang")))


@query("doc_redact", r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS a FROM documents),
b AS (SELECT *, regexp_replace(a, '(?:[A-Za-z]+\s)?[xX\d]{3}[-\s]?[xX\d]{1,7}[-\s]?[xX\d]{1,7}[-\s]?[xX\d]{0,2}', '[ACCOUNT]', 'g') AS b FROM a)
SELECT doc_id, sha256(regexp_replace(b, '\d{6,}', '[DIGITS]', 'g')) AS redacted_hash, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails,
 len(regexp_extract_all(a, '(?:[A-Za-z]+\s)?[xX\d]{3}[-\s]?[xX\d]{1,7}[-\s]?[xX\d]{1,7}[-\s]?[xX\d]{0,2}')) AS accounts, len(regexp_extract_all(b, '\d{6,}')) AS digit_runs FROM b""")
def doc_redact(spark, sf_dir):
    r = D.redact(documents(spark, sf_dir, "text"))
    return r.select("doc_id", F.sha2("redacted", 256).alias("redacted_hash"), "emails", "accounts", "digit_runs")


@query("doc_near_duplicate", r"""WITH RECURSIVE h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents), d AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM d),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS o, b.doc_id AS d, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
j AS MATERIALIZED (SELECT d, o FROM p JOIN n x ON x.doc_id = o JOIN n y ON y.doc_id = d WHERE CAST(i AS DOUBLE) / (x.n + y.n - i) >= 0.8),
e AS MATERIALIZED (SELECT d AS a, o AS b FROM j UNION ALL SELECT o, d FROM j),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a, min(b) AS group_id FROM r GROUP BY a)
SELECT doc_id, group_id, CASE WHEN doc_id <> first THEN 'exact' WHEN doc_id = group_id THEN 'first' ELSE 'near' END AS kind FROM h JOIN g ON g.a = h.first""")
def doc_near_duplicate(spark, sf_dir):
    """Every document with the group of copies and near copies it belongs to."""
    return D.near_groups(documents(spark, sf_dir, "text"))
