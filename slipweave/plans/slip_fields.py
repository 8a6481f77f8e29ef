"""Field extraction queries over the slip feed; the SQL derives the expected values from the orders."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipweave import rules as R
from slipweave.functions import fields as X
from slipweave.functions import text as T
from slipweave.operators import banks, payments, slips
from slipweave.plans.registry import query
from slipweave.sources.feeds import slip_feed, slip_feed_sql
from slipweave.sources.tables import documents, table


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slips.with_lines(slip_feed(spark, sf_dir))


LINES_SQL = """WITH l AS (SELECT idx, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 AS pos
  FROM @FEED)"""


@query("ext_lines", LINES_SQL + " SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY pos) - 1 AS pos, line FROM l WHERE line <> ''")
def ext_lines(spark, sf_dir):
    return feed(spark, sf_dir).select("idx", F.posexplode("lines").alias("pos", "line"))


def _weights_sql() -> str:
    """The score of every bank as a list of structs: hits weigh the length of their pattern, in tenths, more when there are several; an account pattern adds to it."""
    parts = []
    for place, (code, patterns, account) in enumerate(R.BANK_PATTERNS):
        hit = lambda p: f"CASE WHEN regexp_matches(low, '{p}') THEN 1 ELSE 0 END"
        weight = " + ".join(f"{max(len(p), 5)} * {hit(p)}" for p in patterns)
        bonus = f"CASE WHEN regexp_matches(raw_text, '{account}') THEN 100 ELSE 0 END" if account else "0"
        parts.append(f"{{'s': ({weight}) * CASE WHEN {' + '.join(map(hit, patterns))} >= 2 THEN 13 ELSE 10 END + {bonus}, 'p': {-place}, 'c': '{code}'}}")
    return "[" + ", ".join(parts) + "]"


@query("ext_bank_weighted", f"""WITH s AS (SELECT idx, t_bank, {_weights_sql()} AS w FROM (SELECT idx, t_bank, raw_text, lower(raw_text) AS low FROM @FEED))
SELECT idx, t_bank AS bank_code, CASE WHEN list_max(w).s = 0 THEN 0 ELSE CAST(list_max(w).s AS DOUBLE) / list_sum(list_transform(w, lambda x: x.s)) END AS confidence FROM s""")
def ext_bank_weighted(spark, sf_dir):
    return X.with_bank(slip_feed(spark, sf_dir), "raw_text", "b").select("idx", F.col("b.code").alias("bank_code"), F.col("b.confidence").alias("confidence"))


@query("prj_brand_fallback", """SELECT idx, CASE WHEN t_bank = 'UNKNOWN' AND t_key % 4 = 1 THEN 'UNKNOWN' WHEN t_bank = 'UNKNOWN' AND t_key % 2 = 0 THEN 'SCB' ELSE t_bank END AS bank_code FROM @FEED""")
def prj_brand_fallback(spark, sf_dir):
    """Texts whose bank is unknown take the brand of a second source, which knows every other slip."""
    key = F.col("t_key")
    brand = F.when(key % 2 == 0, "SCB").when(key % 4 == 1, "UNKNOWN")
    b = X.with_bank(slip_feed(spark, sf_dir, truth=True).select("idx", "raw_text", brand.alias("brand")), "raw_text", "b")
    return b.select("idx", slips.brand_fallback(F.col("b.code"), F.col("brand")).alias("bank_code"))


@query("ext_bank_longest", """SELECT idx, CASE WHEN t_empty THEN 'Unknown' WHEN t_bank = 'BAAC' THEN coalesce(t_receiver_bank, 'Unknown')
  WHEN t_bank = 'GHB' AND coalesce(t_receiver_bank, 'UOB') <> 'UOB' THEN t_receiver_bank ELSE t_bank END AS bank_code FROM @FEED""")
def ext_bank_longest(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.bank_longest_keyword(F.col("raw_text")).alias("bank_code"))


@query("ext_bank_last_group", """
WITH h AS (SELECT idx, t_bank AS b, coalesce(t_receiver_bank, t_bank) AS r FROM @FEED)
SELECT idx, CASE WHEN 'BAY' IN (b, r) THEN 'Krungsri' WHEN 'BBL' IN (b, r) THEN 'Bangkok Bank' WHEN 'KTB' IN (b, r) THEN 'Krungthai'
  WHEN 'SCB' IN (b, r) THEN 'SCB' WHEN 'KBANK' IN (b, r) THEN 'KASIKORNBANK' ELSE 'UNKNOWN' END AS brand FROM h""")
def ext_bank_last_group(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.bank_last_group(F.col("raw_text")).alias("brand"))


@query("ext_amount_cascade", "SELECT idx, t_amount AS amount FROM @FEED")
def ext_amount_cascade(spark, sf_dir):
    return feed(spark, sf_dir).select("idx", X.amount_cascade(F.col("raw_text"), F.col("lines")).alias("amount"))


@query("ext_amount_labelled_max", """SELECT idx, CASE WHEN t_empty THEN 0.0 WHEN t_amount_labelled AND t_amount NOT BETWEEN 2000 AND 2100 THEN t_amount
  ELSE CAST(t_ref_digits AS DOUBLE) END AS amount FROM @FEED""")
def ext_amount_labelled_max(spark, sf_dir):
    return feed(spark, sf_dir).select("idx", X.amount_near_label(F.col("lines")).alias("amount"))


@query("srt_top_candidate", """SELECT idx, CASE WHEN t_amount_labelled AND t_amount NOT BETWEEN 2000 AND 2100 THEN 10 ELSE 1 END AS priority,
  CASE WHEN t_amount_labelled AND t_amount NOT BETWEEN 2000 AND 2100 THEN t_amount ELSE CAST(t_ref_digits AS DOUBLE) END AS value FROM @FEED WHERE NOT t_empty""")
def srt_top_candidate(spark, sf_dir):
    """Best (priority, value) per slip, from a table of candidates."""
    from slipweave.functions.text import contains_any, rx_all
    cand = feed(spark, sf_dir).select("idx", F.explode("lines").alias("line")).select(
        "idx", F.when(contains_any(F.lower("line"), R.AMOUNT_LABELS_NEAR), 10).otherwise(1).alias("priority"),
        F.explode(rx_all(F.col("line"), r"[\d,]+\.?\d{0,2}")).alias("token"))
    valued = cand.withColumn("value", F.replace("token", F.lit(","), F.lit("")).try_cast("double"))
    best = valued.filter((F.col("value") > 0) & ~F.col("value").between(2000, 2100)).groupBy("idx").agg(
        F.max(F.struct("priority", "value")).alias("m"))
    return best.select("idx", "m.priority", "m.value")


@query("ext_amount_currency", "SELECT idx, coalesce(t_amount, 0.0) AS amount FROM @FEED")
def ext_amount_currency(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.amount_by_currency(F.col("raw_text")).alias("amount"))


@query("ext_amount_display", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN '0.00 THB'
   ELSE concat(CASE WHEN o_orderkey % 4 = 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE format('{:,.2f}', o_totalprice) END, ' THB') END AS amount,
   CASE o_orderkey % 4 WHEN 0 THEN 85 WHEN 1 THEN 99 WHEN 2 THEN 99 ELSE 0 END AS confidence FROM orders""")
def ext_amount_display(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    money = F.format_number("o_totalprice", 2)
    whole = F.floor("o_totalprice").cast("string")
    cell = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("  "), money, F.lit(" บาท ")))
            .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("฿"), money))
            .when(F.col("o_orderkey") % 4 == 2, F.concat(whole, F.lit(" THB")))
            .otherwise(F.lit("no amount")))
    return o.select(F.col("o_orderkey").alias("id"), X.amount_display(cell).alias("a")).select("id", "a.amount", "a.confidence")


@query("ext_date_cascade", "SELECT idx, t_date AS transaction_date FROM @FEED")
def ext_date_cascade(spark, sf_dir):
    return feed(spark, sf_dir).select("idx", X.date_cascade(F.col("raw_text"), F.col("lines")).alias("transaction_date"))


@query("ext_date_to_be", """
WITH o AS (SELECT o_orderkey AS id, CAST(extract(day FROM o_orderdate) AS INT) AS d, CAST(extract(month FROM o_orderdate) AS INT) AS m,
   CAST(extract(year FROM o_orderdate) AS INT) + 28 AS y, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS day FROM orders)
SELECT id, CASE id % 3 WHEN 0 THEN concat(d, ' ', ['ม.ค.','ก.พ.','มี.ค.','เม.ย.','พ.ค.','มิ.ย.','ก.ค.','ส.ค.','ก.ย.','ต.ค.','พ.ย.','ธ.ค.'][m], ' ', y + 543, ' 09:30')
   WHEN 1 THEN concat(d, ' ', ['ม.ค.','ก.พ.','มี.ค.','เม.ย.','พ.ค.','มิ.ย.','ก.ค.','ส.ค.','ก.ย.','ต.ค.','พ.ย.','ธ.ค.'][m], ' ', y + 543)
   ELSE concat(y + 543, strftime(day, '-%m-%d')) END AS normalized, CASE id % 3 WHEN 0 THEN 80 ELSE 99 END AS confidence FROM o""")
def ext_date_to_be(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("cast(o_orderdate + INTERVAL 28 YEAR AS DATE)").alias("day"))
    month = F.get(F.array(*[F.lit(m.capitalize()) for m in R.ENGLISH_MONTHS]), F.month("day") - 1)
    cell = (F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.day("day"), month, (F.year("day") + 543 - 2500), F.lit("09:30")))
            .when(F.col("id") % 3 == 1, F.concat_ws(" ", F.day("day"), month, F.year("day")))
            .otherwise(F.col("day").cast("string")))
    return o.select("id", X.date_to_buddhist(cell).alias("d")).select("id", "d.normalized", "d.confidence")


FULL_OR_SHORT = "['มกราคม','กุมภาพันธ์','มีนาคม','เมษายน','พฤษภาคม','มิ.ย.','กรกฎาคม','สิงหาคม','กันยายน','ตุลาคม','พฤศจิกายน','ธันวาคม']"
SHORT = "['ม.ค.','ก.พ.','มี.ค.','เม.ย.','พ.ค.','มิ.ย.','ก.ค.','ส.ค.','ก.ย.','ต.ค.','พ.ย.','ธ.ค.']"
DATE_TEXT_SQL = f"""CASE WHEN t_empty THEN 'Unknown' WHEN t_date_form = 0 THEN strftime(t_date, '%d/%m/%Y')
   WHEN t_date_form = 1 THEN concat(strftime(t_date, '%d'), ' ', {SHORT}[month(t_date)], ' ', year(t_date) + 543 - 2500)
   WHEN t_date_form = 3 THEN concat(strftime(t_date, '%d'), ' ', {FULL_OR_SHORT}[month(t_date)], ' ', year(t_date)) ELSE 'Unknown' END"""


@query("ext_date_string_v2", f"""SELECT idx, {DATE_TEXT_SQL} AS date_text,
  CASE WHEN NOT t_empty AND t_key % 7 <> 0 AND t_key % 5 <> 3 THEN t_time ELSE 'Unknown' END AS time_text FROM @FEED""")
def ext_date_string_v2(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.date_text(F.col("raw_text")).alias("date_text"), X.time_text(F.col("raw_text")).alias("time_text"))


@query("ext_date_day_fix", f"""SELECT idx, CASE WHEN t_empty THEN 'UNKNOWN'
   WHEN t_date_form = 0 THEN strftime(t_date, '%d/') || strftime(t_date, '%m/') || (year(t_date) + 543)
   WHEN t_date_form = 1 THEN concat(day(t_date), ' ', {SHORT}[month(t_date)], ' ', year(t_date) + 543 - 2500, hm)
   WHEN t_date_form = 3 AND month(t_date) = 6 THEN concat(day(t_date), ' มิ.ย. ', year(t_date) + 543, hm) ELSE 'UNKNOWN' END AS date_text
 FROM (SELECT *, CASE WHEN t_key % 7 <> 0 AND t_key % 5 <> 3 THEN concat(' - ', t_time) ELSE '' END AS hm FROM @FEED)""")
def ext_date_day_fix(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.date_day_repaired(F.col("raw_text")).alias("date_text"))


@query("ext_time", "SELECT idx, t_time AS transaction_time FROM @FEED")
def ext_time(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.time_cascade(F.col("raw_text")).alias("transaction_time"))


@query("ext_reference", "SELECT idx, t_ref AS transaction_id FROM @FEED")
def ext_reference(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.reference(F.col("raw_text")).alias("transaction_id"))


@query("ext_memo", "SELECT idx, t_memo AS memo FROM @FEED")
def ext_memo(spark, sf_dir):
    return slip_feed(spark, sf_dir).select("idx", X.memo(T.raw_lines(F.col("raw_text"))).alias("memo"))


@query("ext_parties", """SELECT idx, t_sender AS sender_name, t_sender_acc AS sender_account, t_receiver AS receiver_name,
  t_receiver_acc AS receiver_account FROM @FEED""")
def ext_parties(spark, sf_dir):
    return slips.with_parties(feed(spark, sf_dir)).select("idx", "sender_name", "sender_account", "receiver_name", "receiver_account")


@query("ext_parties_labelled", """SELECT idx, CASE WHEN NOT t_empty AND t_labelled THEN t_sender ELSE 'Unknown' END AS sender, CASE WHEN NOT t_empty AND t_labelled THEN t_receiver ELSE 'Unknown' END AS receiver FROM @FEED""")
def ext_parties_labelled(spark, sf_dir):
    """Texts that name the receiver by one of the labels of this variant."""
    named = slip_feed(spark, sf_dir).withColumn("raw_text", F.replace("raw_text", F.lit("ไปยัง"), F.lit("ผู้รับ:")))
    return slips.with_lines(named).select("idx", slips.labelled_parties(F.col("lines")).alias("p")).select("idx", "p.sender", "p.receiver")


@query("ext_parties_prefix", """SELECT idx, CASE WHEN t_empty THEN 'UNKNOWN' WHEN t_labelled THEN t_sender ELSE substr(t_sender, 5) END AS sender,
  CASE WHEN t_empty OR NOT t_labelled THEN 'UNKNOWN' ELSE replace(t_receiver, '.', '') END AS receiver FROM @FEED""")
def ext_parties_prefix(spark, sf_dir):
    return feed(spark, sf_dir).select("idx", slips.prefix_parties(F.col("lines")).alias("p")).select("idx", "p.sender", "p.receiver")


@query("ext_parties_pivot", """SELECT idx, CASE WHEN t_empty THEN 'Unknown' WHEN t_labelled AND t_bank = 'PROMPTPAY' THEN 'พร้อมเพย์ PROMPTPAY'
    WHEN t_merchant THEN 'จ่ายบิลสำเร็จ' WHEN t_labelled THEN t_receiver ELSE t_sender END AS sender,
  CASE WHEN t_empty THEN 'Unknown' WHEN t_labelled OR NOT t_merchant THEN t_receiver ELSE t_sender END AS receiver FROM @FEED""")
def ext_parties_pivot(spark, sf_dir):
    return feed(spark, sf_dir).select("idx", slips.pivot_parties(F.col("lines")).alias("p")).select("idx", "p.sender", "p.receiver")


@query("ext_receiver_bank", """SELECT idx, CASE WHEN t_empty THEN NULL WHEN NOT t_labelled AND t_merchant THEN t_bank
   WHEN t_merchant THEN t_bank ELSE t_receiver_bank END AS receiver_bank FROM @FEED""")
def ext_receiver_bank(spark, sf_dir):
    """Bank of the receiver section before merchant payments are suppressed."""
    return slips.with_receiver_bank(feed(spark, sf_dir)).select("idx", F.col("receiver_bank_code").alias("receiver_bank"))


@query("ext_account", """SELECT idx, t_sender_acc AS account FROM @FEED WHERE NOT t_empty UNION ALL
           SELECT idx, t_receiver_acc FROM @FEED WHERE NOT t_empty""")
def ext_account(spark, sf_dir):
    """The account token of every line that is mostly an account."""
    one = feed(spark, sf_dir).select("idx", F.explode("lines").alias("line"))
    return one.filter(X.account_like(F.col("line"))).select("idx", X.account(F.col("line")).alias("account"))


@query("ext_noise_tokens", """SELECT idx, receiver, header FROM (
  SELECT idx, t_receiver AS receiver, false AS header FROM @FEED WHERE NOT t_empty UNION ALL
  SELECT idx, t_bank_name, true FROM @FEED WHERE NOT t_empty)""")
def ext_noise_tokens(spark, sf_dir):
    """Which names consist of bank and header words only."""
    f = slips.with_parties(feed(spark, sf_dir)).filter(F.size("lines") > 0)
    first = F.regexp_extract(F.get("lines", F.lit(0)), r"^(\S+)", 1)
    both = f.select("idx", F.explode(F.array(F.col("receiver_name"), first)).alias("receiver"))
    return both.select("idx", "receiver", X.is_header_name(F.col("receiver")).alias("header"))


@query("set_token_subset", """SELECT idx, 'sender' AS part, false AS subset FROM @FEED WHERE NOT t_empty UNION ALL SELECT idx, 'bank', true FROM @FEED WHERE NOT t_empty
  UNION ALL SELECT idx, 'both', false FROM @FEED WHERE NOT t_empty""")
def set_token_subset(spark, sf_dir):
    """Whether all tokens of the sender, of the bank's line and of both together are in the vocabulary, as array differences."""
    vocab = F.array(*[F.lit(v) for v in X.noise_vocabulary()])
    f = slips.with_parties(feed(spark, sf_dir)).filter(F.size("lines") > 0).withColumn("bank", F.regexp_extract(F.get("lines", F.lit(0)), r"^(\S+)", 1))
    parts = F.array(*[F.struct(F.lit(n).alias("part"), c.alias("name")) for n, c in (("sender", F.col("sender_name")), ("bank", F.col("bank")), ("both", F.concat_ws(" ", "bank", "sender_name")))])
    each = f.select("idx", F.inline(parts))
    return each.select("idx", "part", (F.size(F.array_except(X.name_tokens(F.col("name")), vocab)) == 0).alias("subset"))


@query("ext_name_clean", """SELECT idx, CASE WHEN t_empty THEN '' WHEN t_merchant THEN t_receiver ELSE substr(t_receiver, 6) END AS name,
  CASE WHEN t_empty THEN 0 WHEN t_merchant THEN 90 ELSE 99 END AS confidence FROM @FEED""")
def ext_name_clean(spark, sf_dir):
    f = slips.with_parties(feed(spark, sf_dir))
    return f.select("idx", X.name_without_title(F.coalesce("receiver_name", F.lit(""))).alias("n")).select("idx", "n.name", "n.confidence")


#: Which of the six fields the variant's rules find in a text of the feed.
FOUND_SQL = f"""v AS (SELECT *, {DATE_TEXT_SQL} AS dt FROM @FEED),
w AS (SELECT idx, NOT t_empty AND NOT (t_bank = 'BAAC' AND t_merchant) AS bank, NOT t_empty AS amount, NOT t_empty AND t_date_form <> 2 AS date, NOT t_empty AND t_labelled AS sender, false AS receiver, NOT t_empty AS reference FROM v)
"""


def found_fields(spark, sf_dir):
    f = slips.labelled_fields(slip_feed(spark, sf_dir).select("idx", "raw_text"))
    return f.select("idx", slips.found_fields(*[F.col(c) for c in ("bank", "amount", "date", "sender", "receiver", "reference")]).alias("found"))


@query("ext_completeness", "WITH " + FOUND_SQL + "SELECT idx, round((CAST(bank AS INT) + CAST(amount AS INT) + CAST(date AS INT) + CAST(sender AS INT) + CAST(receiver AS INT) + CAST(reference AS INT)) / 6.0, 2) AS completeness FROM w")
def ext_completeness(spark, sf_dir):
    text = F.col("raw_text")
    f = feed(spark, sf_dir).withColumn("p", slips.labelled_parties(F.col("lines")))
    return f.select("idx", slips.completeness(
        X.bank_longest_keyword(text), X.amount_near_label(F.col("lines")), X.date_text(text), F.col("p.sender"),
        F.col("p.receiver"), X.reference_short(text)).alias("completeness"))


@query("ext_fill_rate", "WITH " + FOUND_SQL + """, u AS (SELECT unnest([{'field': 'bank', 'f': bank}, {'field': 'amount', 'f': amount}, {'field': 'date', 'f': date}, {'field': 'sender', 'f': sender},
  {'field': 'receiver', 'f': receiver}, {'field': 'reference', 'f': reference}], recursive := true) FROM w) SELECT field, count_if(f) AS filled, count(*) AS n, CAST(count_if(f) AS DOUBLE) / count(*) AS share FROM u GROUP BY field""")
def ext_fill_rate(spark, sf_dir):
    """How often each field is found."""
    return slips.fill_rates(found_fields(spark, sf_dir), "found")


@query("ext_qr_payload", """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'จ่ายบิล ' || o_custkey ELSE 'สแกนจ่าย ' || '0002015802TH54' || lpad(CAST(length(CAST(o_custkey AS VARCHAR)) AS VARCHAR), 2, '0') || o_custkey || ' ขอบคุณ' END AS text FROM orders)
SELECT id, nullif(regexp_extract(text, '000201[0-9a-zA-Z]+'), '') AS payload, CASE WHEN id % 7 <> 0 THEN regexp_extract(text, 'TH54..([0-9]+)', 1) END AS amount FROM t""")
def ext_qr_payload(spark, sf_dir):
    """The payment payload inside of a text, and the amount it holds."""
    key = F.col("o_custkey").cast("string")
    payload = F.concat(F.lit("0002015802TH54"), F.lpad(F.length(key).cast("string"), 2, "0"), key)
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("จ่ายบิล "), key)).otherwise(F.concat(F.lit("สแกนจ่าย "), payload, F.lit(" ขอบคุณ")))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), payments.qr_payload(text).alias("payload"))
    return found.select("id", "payload", payments.tlv_amount(F.col("payload")).alias("amount"))


@query("ext_emv_fields", """
WITH RECURSIVE p AS (SELECT o_orderkey AS id, concat('000201', '5802TH', '54', lpad(CAST(length(printf('%.2f', o_totalprice)) AS VARCHAR), 2, '0'), printf('%.2f', o_totalprice),
     CASE WHEN o_orderkey % 5 = 0 THEN '62xx99' ELSE '6304ABCD' END) AS payload FROM orders),
w AS (SELECT id, payload, 1 AS p0, 0 AS pos, NULL::VARCHAR AS tag, NULL::VARCHAR AS value FROM p
  UNION ALL SELECT id, payload, p0 + 4 + CAST(substr(payload, p0 + 2, 2) AS INT), pos + 1, substr(payload, p0, 2),
     substr(payload, p0 + 4, CAST(substr(payload, p0 + 2, 2) AS INT)) FROM w WHERE p0 <= length(payload) AND TRY_CAST(substr(payload, p0 + 2, 2) AS INT) IS NOT NULL)
SELECT id, pos, tag, value FROM w WHERE pos > 0""")
def ext_emv_fields(spark, sf_dir):
    return payload_feed(spark, sf_dir).select("id", F.posexplode(payments.tlv_fields(F.col("payload"))).alias("p", "f")).select(
        "id", (F.col("p") + 1).alias("pos"), F.col("f.id").alias("tag"), F.col("f.value").alias("value"))


def payload_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.format_string("%.2f", "o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(
        F.lit("0002015802TH54"), F.lpad(F.length(amount).cast("string"), 2, "0"), amount,
        F.when(F.col("o_orderkey") % 5 == 0, "62xx99").otherwise("6304ABCD")).alias("payload"))


@query("join_qr_reconcile", """SELECT idx, t_amount AS amount, qr AS qr_amount, coalesce(qr, t_amount) AS final_amount,
  coalesce(round(qr * 100) <> round(t_amount * 100), false) AS disagrees FROM (SELECT *, CASE WHEN t_key % 2 = 0 THEN
  CAST(printf('%.2f', o_totalprice + CASE WHEN t_key % 8 = 0 THEN 1 ELSE 0 END) AS DOUBLE) END AS qr
  FROM @FEED f JOIN orders ON o_orderkey = t_key)""")
def join_qr_reconcile(spark, sf_dir):
    """Slips joined with the QR payload scanned from the same file."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").filter("o_orderkey % 2 = 0")
    value = F.format_string("%.2f", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 8 == 0, 1).otherwise(0))
    scans = o.select(F.col("o_orderkey").alias("key"), F.concat(F.lit("0002015802TH54"), F.lpad(F.length(value).cast("string"), 2, "0"), value).alias("payload"))
    parsed = feed(spark, sf_dir).select("idx", X.amount_cascade(F.col("raw_text"), F.col("lines")).alias("amount"), F.expr("idx div 2").alias("key"))
    return payments.reconcile(parsed.join(scans, "key", "left"), "amount", "payload").select("idx", "amount", "qr_amount", "final_amount", "disagrees")


@query("ext_merge_fill", """SELECT idx, CASE WHEN t_key % 3 = 0 THEN coalesce(t_amount, 0.0) + 1 ELSE t_amount END AS amount,
   CASE WHEN t_key % 5 = 0 THEN 'P' || t_key ELSE t_ref END AS transaction_id FROM @FEED WHERE t_copy = 0 OR true""")
def ext_merge_fill(spark, sf_dir):
    """A primary extraction (present for some slips and fields) merged over the rule extraction."""
    rules_ = feed(spark, sf_dir).select("idx", X.amount_cascade(F.col("raw_text"), F.col("lines")).alias("amount"),
                                        X.reference(F.col("raw_text")).alias("transaction_id"))
    truth = slip_feed(spark, sf_dir, truth=True)
    primary = truth.filter((F.col("t_key") % 3 == 0) | (F.col("t_key") % 5 == 0)).select(
        "idx", F.when(F.col("t_key") % 3 == 0, F.coalesce("t_amount", F.lit(0.0)) + 1).alias("amount"),
        F.when(F.col("t_key") % 5 == 0, F.concat(F.lit("P"), F.col("t_key").cast("string"))).alias("transaction_id"))
    return slips.merge_fill(primary, rules_, "idx", ["amount", "transaction_id"])


@query("ext_slip_job", """SELECT idx, file_name, t_bank AS bank_code, t_amount AS amount, t_date AS transaction_date, t_time AS transaction_time,
  t_ref AS transaction_id, t_memo AS memo, t_sender AS sender_name, t_sender_acc AS sender_account, t_receiver AS receiver_name,
  t_receiver_acc AS receiver_account, t_receiver_bank AS receiver_bank, NOT t_empty AS success,
  CASE WHEN t_empty THEN 'EMPTY_TEXT' END AS error FROM @FEED""")
def ext_slip_job(spark, sf_dir):
    return slips.parse_slips(slip_feed(spark, sf_dir)).select(
        "idx", "file_name", "bank_code", "amount", "transaction_date", "transaction_time", "transaction_id", "memo", "sender_name",
        "sender_account", "receiver_name", "receiver_account", F.col("receiver_bank_code").alias("receiver_bank"), "success", "error")


BANK_CELLS = ["ธนาคารกสิกรไทย", "ธนาคารกสีกรไทบ", "ธนาคารไทยเครดิต", "SCB", "ธนาคารไม่รู้จัก", "Krungthai", "ธ.ก.ส.", "กรุงเทพฯ", "ttb bank"]
BANK_SHOWN = [("KBANK (ธนาคารกสิกรไทย)", 99), ("KBANK (ธนาคารกสิกรไทย)", 99), ("TCB (ธนาคารไทยเครดิตเพื่อรายย่อย)", 99), ("SCB (ธนาคารไทยพาณิชย์)", 100),
              ("ธนาคารไม่รู้จัก", 0), ("KTB (ธนาคารกรุงไทย)", 99), ("BAAC (ธนาคารเพื่อการเกษตรและสหกรณ์การเกษตร)", 66),
              ("BBL (ธนาคารกรุงเทพ)", 99), ("TTB (ธนาคารทหารไทยธนชาต)", 66)]
_SHOWN_SQL = " ".join(f"WHEN {i} THEN '{d}'" for i, (d, _) in enumerate(BANK_SHOWN))
_CONF_SQL = " ".join(f"WHEN {i} THEN {c}" for i, (_, c) in enumerate(BANK_SHOWN))


def bank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.get(F.array(*[F.lit(c) for c in BANK_CELLS]), (F.col("o_orderkey") % len(BANK_CELLS)).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), cell.alias("cell"), "o_totalprice", "o_custkey", "o_orderdate")


@query("ext_bank_verify", f"""SELECT o_orderkey AS id, CASE o_orderkey % 9 {_SHOWN_SQL} END AS bank_display,
  CASE o_orderkey % 9 {_CONF_SQL} END AS bank_confidence FROM orders""")
def ext_bank_verify(spark, sf_dir):
    return banks.verify_banks(bank_cells(spark, sf_dir), "cell").select("id", "bank_display", "bank_confidence")


@query("ext_validate_job", f"""SELECT o_orderkey AS id, CASE o_orderkey % 9 {_SHOWN_SQL} END AS bank_name,
  CASE WHEN o_orderkey % 2 = 0 THEN '100.0%' ELSE printf('%.1f%%', CAST(CASE o_orderkey % 9 {_CONF_SQL} END AS DOUBLE)) END AS bank_confidence,
  concat(format('{{:,.2f}}', o_totalprice), ' THB') AS amount, CASE WHEN o_orderkey % 2 = 0 THEN '100.0%' ELSE '99.0%' END AS amount_confidence,
  concat(year(o_orderdate) + 28 + 543, strftime(o_orderdate, '-%m-%d')) AS transaction_date, CASE WHEN o_orderkey % 2 = 0 THEN '100.0%' ELSE '99.0%' END AS date_confidence,
  concat('Somchai ', translate(CAST(o_custkey AS VARCHAR), '0123456789', 'abcdefghik')) AS sender_name, CASE WHEN o_orderkey % 2 = 0 THEN '100.0%' ELSE '99.0%' END AS sender_confidence,
  o_orderkey % 2 = 0 AS qr_verified FROM orders""")
def ext_validate_job(spark, sf_dir):
    """Bank, amount, date and name validated together; a long QR payload settles every confidence."""
    v = banks.verify_banks(bank_cells(spark, sf_dir), "cell").withColumn("qr", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("0002015802TH"), 4)).otherwise(""))
    name = F.concat(F.lit("Mr. Somchai "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghik"))
    day = F.expr("cast(cast(make_date(year(o_orderdate) + 28, month(o_orderdate), day(o_orderdate)) as date) as string)")
    s = v.select("id", "bank_display", "bank_confidence", "qr", X.amount_display(F.concat(F.format_number("o_totalprice", 2), F.lit(" บาท"))).alias("a"),
                 X.date_to_buddhist(day).alias("d"), X.name_without_title(name).alias("n"))
    verified = F.length("qr") > 20

    def shown(c):
        return F.when(verified, "100.0%").otherwise(F.format_string("%.1f%%", c.cast("double")))
    return s.select("id", F.col("bank_display").alias("bank_name"), shown(F.col("bank_confidence")).alias("bank_confidence"), F.col("a.amount").alias("amount"),
                    shown(F.col("a.confidence")).alias("amount_confidence"), F.col("d.normalized").alias("transaction_date"), shown(F.col("d.confidence")).alias("date_confidence"),
                    F.col("n.name").alias("sender_name"), shown(F.col("n.confidence")).alias("sender_confidence"), verified.alias("qr_verified"))
