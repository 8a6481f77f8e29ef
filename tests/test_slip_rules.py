"""The whole parsing job runs its rules in one Python function per text; each field is what the column functions of the single jobs find."""
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from golden_texts import GOLDEN
from slipweave import rules as R
from slipweave.functions import fields as X
from slipweave.functions.text import raw_lines
from slipweave.operators import match as M, slips

WORDS = [*[name for _, name in R.BANK_NAMES], "k  plus", "scb easy", "SCB", "ttb", "b", "ธ.ก.ส.", "prompt pay", *R.SENDER_LABELS, *R.RECEIVER_LABELS, *R.MEMO_LABELS, *R.NAME_NOISE, *R.PERSON_PREFIXES,
         *R.MERCHANT_TEXT_MARKERS, *R.SEPARATOR_LINES, *[m for pair in R.THAI_MONTHS for m in pair], "W.A.", "จำนวนเงิน", "Amount:", "ค่าธรรมเนียม", "รหัส", "Ref", "Transaction  ID:", "เลขอ้างอิง", "บาท", "THB", "to:", "TO：",
         "นาย สมชาย ใจดี", "น.ส. สมหญิง รักดี", "Siri Mart abcd", "CJ 2044 Nong Pling", "O'Neil & Sons", "XXX-X-XX558-9", "XXXXXXXX5879", "123-4-56789-0", "123-456789-0", "(010753700088205)", "KB000002200099",
         "202508161903564508", "260421102630069281", "10,000.00", "0.00", "2000.50", "1,234,567,890.12", "๑,๒๓๔.๕๖", "๑๖/๐๘/๒๕๖๘", "31-02-2025", "1.2.68", "16 ส.ค. 68", "30 ก.พ. 68", "5 มิถุนายน 256", "19:18",
         "๙:๑๘", "18.30 น.", "18.30 นา", "พร้อมเพย์ e-wallet", "a", "ก", "้", "é", "回", "😀", "١٢٣", "Ⅷ", "½"]
SEPARATORS = ["\n"] * 14 + [" "] * 10 + ["", "  ", ": ", "：", "\t", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", " ", "\xa0", "　", "​", ",", "-", "\n\n", " \n "]


def odd_texts(n: int, seed: int = 3) -> list:
    """Nulls, blank texts, golden slips with lines lost, moved and changed, and words of the rules in any order."""
    r = random.Random(seed)

    def changed():
        rows = r.choice(list(GOLDEN.values()))[0].split("\n")
        for _ in range(r.randint(1, 5)):
            i = r.randrange(len(rows))
            rows[i:i + r.randint(0, 1)] = [r.choice([rows[i] + r.choice(SEPARATORS) + r.choice(WORDS), r.choice(WORDS), r.choice(WORDS) + ": " + rows[i], rows[i][1:]])]
        return "\n".join(rows)

    def mixed():
        return "".join(r.choice(WORDS) + r.choice(SEPARATORS) for _ in range(r.randint(0, 28)))
    return [None, "", " \n ", "\n", *(changed() if r.random() < 0.4 else mixed() for _ in range(n))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(odd_texts(2500))), "idx long, raw_text string")


def test_all_fields_are_those_of_the_column_functions(spark, odd):
    text = F.coalesce("raw_text", F.lit(""))
    lined = X.with_bank(slips.with_lines(odd.withColumn("_text", text)), "_text", "_bank").drop("_text")
    scalar = lined.select(
        "*", F.col("_bank.code").alias("bank_code"), F.col("_bank.confidence").alias("bank_confidence"), X.amount_cascade(text, F.col("lines")).alias("amount"),
        X.date_cascade(text, F.col("lines")).alias("transaction_date"), X.time_cascade(text).alias("transaction_time"), X.reference(text).alias("transaction_id"), X.memo(raw_lines(text)).alias("memo"))
    whole = slips.with_receiver_bank(slips.with_parties(scalar))
    own_bank = X.is_merchant_payment(text, F.col("receiver_name")) & (F.col("receiver_bank_code") == F.col("bank_code"))
    names = ["bank_code", "bank_confidence", "amount", "transaction_date", "transaction_time", "transaction_id", "memo", "sender_name", "sender_account", "receiver_name", "receiver_account", "receiver_bank_code"]
    want = whole.withColumn("receiver_bank_code", F.when(~F.coalesce(own_bank, F.lit(False)), F.col("receiver_bank_code"))).select("idx", *names, (F.size("lines") > 0).alias("success"))
    got = {row["idx"]: row.asDict() for row in slips.parse_slips(odd).collect()}
    rows = [row.asDict() for row in want.collect()]
    assert len(rows) == len(got) == 2504
    for row in rows:
        other = got[row["idx"]]
        assert {n: other[n] for n in row} == row, other["raw_text"]
    for n in names:
        assert sum(row[n] is not None for row in rows) > 100, n


def test_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "x.jpg", GOLDEN["full"][0], [1, 2]), (2, None, None, None)], "idx long, file_name string, raw_text string, more array<int>").repartition(4)
    parsed = slips.parse_slips(df)
    assert parsed.columns[:4] == df.columns
    rows = {row["idx"]: row for row in parsed.collect()}
    assert (rows[1]["more"], rows[1]["file_name"], rows[1]["currency"], rows[1]["error"]) == ([1, 2], "x.jpg", "THB", None)
    assert (rows[2]["raw_text"], rows[2]["success"], rows[2]["error"], rows[2]["sender_bank"]) == (None, False, "EMPTY_TEXT", None)
    assert parsed.filter("idx > 5").collect() == []


def test_invalid_utf8_is_a_text(spark):
    df = spark.createDataFrame([(1, bytearray("โอนเงินสำเร็จ\n100.00 ".encode() + b"\xff\xfe\n"))], "idx long, b binary").select("idx", F.col("b").cast("string").alias("raw_text"))
    row = slips.parse_slips(df).drop("raw_text").first()
    assert row["amount"] == 100.0 and row["success"]


def test_facts_run_the_rules_in_one_function(spark, odd):
    """No nested column functions per line: those cost several times what the rules cost."""
    plan = M.fact_rows(slips.parse_slips(odd.withColumn("file_path", F.lit("")).withColumn("file_name", F.lit(""))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan.split("MapInArrow")[1]


def test_labelled_fields_are_those_of_the_column_functions(spark, odd):
    text = F.col("raw_text")
    lined = slips.with_lines(odd).withColumn("p", slips.labelled_parties(F.col("lines")))
    want = lined.select("idx", X.bank_longest_keyword(text).alias("bank"), X.amount_near_label(F.col("lines")).alias("amount"), X.date_text(text).alias("date"),
                        F.col("p.sender").alias("sender"), F.col("p.receiver").alias("receiver"), X.reference_short(text).alias("reference"))
    got = {row["idx"]: row.asDict() for row in slips.labelled_fields(odd).collect()}
    rows = [row.asDict() for row in want.collect()]
    for row in rows:
        assert {n: got[row["idx"]][n] for n in row} == row, got[row["idx"]]["raw_text"]
    for n in ("bank", "date", "sender", "receiver", "reference"):
        assert sum(row[n] != "Unknown" for row in rows) > 100, n
    assert len(rows) == len(got) and sum(row["amount"] > 0 for row in rows) > 100


def test_fill_rates_run_the_rules_in_one_function(spark, sf_dir):
    plan = entry.queries()["ext_fill_rate"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan
