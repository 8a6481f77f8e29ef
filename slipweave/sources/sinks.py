"""Writers. Every job that writes returns what a reader of the written table sees."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from slipweave import rules as R
from slipweave.functions.text import combine_datetime, money_text
from slipweave.operators.ordered import with_ordinal
from slipweave.session import shared_dir


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: later passes start from the written
    table, also after executors are lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict = {}


def stored(spark, key: str, build) -> DataFrame:
    """A derived input table, written once per application and shared by all later queries."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _STORED:
        df = build()
        path = shared_dir(spark)
        df.write.parquet(path)
        _STORED[slot] = (path, df.schema)
    path, schema = _STORED[slot]
    return spark.read.schema(schema).parquet(path)


def write_audit(facts: DataFrame, summary: DataFrame, path: str) -> None:
    """Audit rows as JSON lines and the summary as its own one-row file."""
    facts.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def _flat(facts: DataFrame) -> Column:
    return F.struct(*[c for c in facts.columns if c != "index"])


def _parties(facts: DataFrame) -> Column:
    """As a parser hands results out: one object per party, the date with a time of day."""
    side = lambda who: F.struct(*[F.col(f"{who}_{p}").alias(p) for p in ("name", "account", "bank")]).alias(who)
    moment = F.concat(F.col("transaction_date").cast("string"), F.lit("T00:00:00")).alias("transaction_date")
    return F.struct("file_name", "file_path", "file_hash", "raw_text", "is_slip", "amount", moment, "transaction_time", "transaction_id", "memo", "bank_name", side("sender"), side("receiver"),
                    F.col("error").alias("error_message"))


def _displayed(facts: DataFrame) -> Column:
    """As a display keeps them: camel case, date and time in one text, amounts with separators and currency."""
    shown = F.struct(combine_datetime(F.col("transaction_date").cast("string"), F.col("transaction_time")).alias("transaction_date_time"), "sender_name", "receiver_name",
                     money_text(F.col("amount")).alias("amount_transferred"), "bank_name").alias("extracted_transaction_metadata")
    camel = [F.col(f"{who}_{p}").alias(f"{who}{p.title()}") for who in ("sender", "receiver") for p in ("account", "bank")]
    return F.struct(F.col("file_name").alias("source_file_name"), "file_path", "file_hash", "raw_text", "is_slip", F.col("transaction_id").alias("transactionId"), F.col("transaction_time").alias("transactionTime"),
                    "memo", "error", shown, *camel)


SHAPES = {"flat": _flat, "parties": _parties, "displayed": _displayed}


def write_audit_documents(facts: DataFrame, path: str, per_document: int = 1000, shape: str = "flat", mode: str = "overwrite") -> None:
    """Audit files in the nested form {summary, results[]}: one JSON document per block of rows, so no
    document grows with the table. ``shape`` is that of the results, one of SHAPES."""
    block = F.expr(f"index div {per_document}")
    docs = facts.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("index", SHAPES[shape](facts).alias("r")))).alias("rows"))
    payload = F.to_json(F.struct(F.struct(F.size("rows").cast("bigint").alias("scanned_files"), F.col("block").alias("document_no")).alias("summary"),
                                 F.transform("rows", lambda x: x["r"]).alias("results")))
    docs.select(payload.alias("value")).write.mode(mode).text(path)


#: Ids of a numbered batch: its number times this, and the row's number in it.
BATCH_IDS = 1 << 32


def append_records(df: DataFrame, path: str, case_number: str = R.DEFAULT_CASE_NUMBER, batch: int | None = None) -> None:
    """Appends evidence rows with ids, defaults for missing values and the time. The table is a folder per batch.

    A numbered ``batch`` has a range of ids of its own, so batches may be written at the same time, and it replaces its own folder, so one that is written again
    after a failure leaves the same rows with the same ids. Without a number the ids continue the table and the next free number is taken, which only one writer at a time may do.
    """
    spark = df.sparkSession
    first = 0 if batch is None else batch * BATCH_IDS
    if batch is None:
        try:
            last = spark.read.parquet(path).agg(F.max("id"), F.max("batch")).first()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            last = None, None
        first, batch = last[0] or 0, 0 if last[1] is None else last[1] + 1
    n = with_ordinal(df, "index", "_n")

    def known(c):
        return F.coalesce(F.col(c), F.lit("UNKNOWN")).alias(c)
    rows = n.select((F.col("_n") + F.lit(first)).alias("id"), F.lit(case_number).alias("case_number"), known("bank_name"),
                    combine_datetime(F.col("transaction_date").cast("string"), F.col("transaction_time")).alias("transaction_date"),
                    F.col("transaction_time"), known("transaction_id"), known("sender_name"), known("receiver_name"),
                    F.coalesce("amount", F.lit(0.0)).alias("amount"), F.current_timestamp().alias("created_at"), F.lit(batch).cast("bigint").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_ledger_pages(ledger: DataFrame, path: str, pages_per_folder: int = 10_000) -> None:
    """Ledger rows by page. Folders hold a range of pages: one folder per page of 20 rows would be more
    folders than a file system takes."""
    ledger.withColumn("page_folder", F.expr(f"page_no div {pages_per_folder}")).write.mode("overwrite").partitionBy("page_folder").parquet(path)
