"""File sources, sinks and streams on temporary folders."""
import json

from pyspark.sql import functions as F

from slipweave.operators import ledger, match
from slipweave.sources import scan, sinks
from slipweave.streaming import ingest


def test_scan_orders_and_filters(spark, tmp_path):
    (tmp_path / "B").mkdir()
    for name in ("b.JPG", "a.png", "note.txt", "B/c.tif"):
        (tmp_path / name).write_bytes(b"x" * 3)
    got = scan.scan_files(spark, str(tmp_path), with_content=True).collect()
    assert [r.name for r in got] == ["a.png", "b.JPG", "c.tif"]
    assert all(r.length == 3 and len(r.file_hash) == 64 for r in got)


def test_audit_replay(spark, tmp_path):
    row = dict(file_name="a.jpg", file_path="", file_hash="", raw_text="", is_slip=True, transaction_date="2025-05-15", transaction_time="16:00", sender_name="นาย ก",
               receiver_name="น.ส. ทดสอบ  ระบบ", amount=10.0, currency="THB", transaction_id="T")
    (tmp_path / "audit.json").write_text(json.dumps({"summary": {"scanned_files": 2}, "results": [row, {**row, "file_name": "b.jpg"}, None,
                                                    {**row, "receiver_name": "คนอื่น"}]}, ensure_ascii=False, indent=1))
    got = match.replay_audit(scan.read_audit(spark, str(tmp_path / "audit.json")), "ทดสอบ ระบบ").orderBy("index").collect()
    assert [(r.file_name, r.duplicate, r.duplicate_of) for r in got] == [("a.jpg", False, None), ("b.jpg", True, "a.jpg")]


def test_ids_continue_over_appends(spark, tmp_path):
    schema = "index long, bank_name string, transaction_date date, transaction_time string, transaction_id string, sender_name string, receiver_name string, amount double"
    for lo in (0, 3):
        sinks.append_records(spark.createDataFrame([(lo + i, None, None, None, None, None, None, None) for i in range(3)], schema), str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r")).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[0].bank_name == "UNKNOWN" and rows[0].amount == 0.0 and rows[0].transaction_date == "UNKNOWN"


def test_audit_documents_of_any_shape(spark, tmp_path):
    """Field names of several kinds, a single result, a bare list, and documents that can't be read, in one folder."""
    given = {"a.json": {"summary": {"scanned_files": 9}, "results": [{"sender": {"name": "A", "bank": "B"}, "amount": "1,234.50 THB", "transaction_date": "2025-05-15T10:00:00", "is_slip": True}, 5, None]},
             "b.json": {"results": {"senderName": "C", "extracted_transaction_metadata": {"transaction_date_time": "2025-05-16  /  09:30", "amount_transferred": "-"}, "file_path": "/x/y.png"}},
             "c.json": [{"sender_name": " ", "source_file_name": "z.png", "currency": "USD"}], "d.json": {"results": "x"}, "e.json": 7, "g.json": {"summary": {}}}
    for name, payload in given.items():
        (tmp_path / name).write_text(json.dumps(payload, indent=1))
    (tmp_path / "f.json").write_text("{")
    documents = scan.audit_documents(spark, str(tmp_path))
    said = {r.file[-6]: (r.problem, r.scanned_files, r.results, r.skipped) for r in scan.audit_summaries(documents).collect()}
    assert said == {"a": (None, 9, 3, 2), "b": (None, None, 1, 0), "c": (None, None, 1, 0), "d": ("RESULTS_NOT_A_LIST", None, 0, 0), "e": ("NOT_AN_OBJECT", None, 0, 0),
                    "f": ("NOT_JSON", None, 0, 0), "g": (None, None, 0, 0)}
    images = spark.createDataFrame([("y.png", "/img/2/y.png"), ("y.png", "/img/1/y.png")], "name string, path string")
    rows = scan.read_audit(spark, str(tmp_path), images=images).orderBy("index").collect()
    assert [(r.file_name, r.file_path, r.sender_name, r.sender_bank, r.amount, r.currency, r.transaction_date, r.transaction_time, r.is_slip) for r in rows] == [
        ("record-1", None, "A", "B", 1234.5, "THB", "2025-05-15", None, True), ("y.png", "/img/1/y.png", "C", None, None, "THB", "2025-05-16", "09:30", None), ("z.png", None, None, None, None, "USD", None, None, None)]


def test_a_batch_written_again_changes_nothing(spark, tmp_path):
    schema = "index long, bank_name string, transaction_date date, transaction_time string, transaction_id string, sender_name string, receiver_name string, amount double"
    path = str(tmp_path / "r")

    def append(batch, *numbers):
        sinks.append_records(spark.createDataFrame([(n, None, None, None, f"t{n}", None, None, 1.0) for n in numbers], schema), path, batch=batch)

    def table():
        return sorted((r.id, r.batch, r.transaction_id) for r in spark.read.parquet(path).collect())
    append(1, 5, 6)
    append(0, 1, 2, 3)
    before = table()
    append(1, 5, 6)
    assert table() == before == [(1, 0, "t1"), (2, 0, "t2"), (3, 0, "t3"), ((1 << 32) + 1, 1, "t5"), ((1 << 32) + 2, 1, "t6")]


def test_late_rows_are_kept_aside(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), "no long, id long, t string").select("no", "id", F.col("t").cast("timestamp").alias("ts")).write.mode("append").parquet(folder)
        ingest.keep_late(ingest.watch_folder(spark, folder, "no long, id long, ts timestamp"), "id", "ts", "no", "1 HOUR", out, mark)
    arrive((1, 1, "2024-01-01 00:10:00"), (2, 1, "2024-01-01 00:00:00"), (3, 2, "2024-01-01 00:30:00"))
    arrive((4, 1, "2024-01-01 00:20:00"), (5, 3, "2024-01-01 03:00:00"))
    arrive((6, 4, "2024-01-01 00:40:00"), (7, 1, "2024-01-01 02:00:00"), (8, 3, "2024-01-01 02:10:00"))
    arrive()
    read = lambda kind: sorted(r.no for r in spark.read.parquet(f"{out}/{kind}").collect())
    assert read("kept") == [2, 3, 5, 7] and read("late") == [6]


def test_late_repeat_is_new_after_the_window(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, ts timestamp"

    def arrive(*rows):
        spark.createDataFrame([(i, t) for i, t in rows], "id long, t string").select("id", F.col("t").cast("timestamp").alias("ts")).write.mode("append").parquet(folder)
        ingest.run_to_end(ingest.drop_repeats(ingest.watch_folder(spark, folder, schema), "id", "ts", "1 hour"), out, mark)
    arrive((1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"))
    arrive((2, "2024-01-01 05:00:00"))
    arrive((1, "2024-01-01 06:00:00"), (3, "2024-01-01 01:00:00"))
    got = sorted((r.id, str(r.ts)) for r in spark.read.parquet(out).collect())
    assert [i for i, _ in got] == [1, 1, 2]


def test_batch_summary_lists_the_failed_files(spark):
    schema = "index long, file_name string, error string, millis long"
    rows = [(i, f"s{i}.jpg", "EMPTY_TEXT" if i % 3 == 0 else None, 1000 * i) for i in (7, 3, 9, 1, 0, 4)]
    row = ledger.batch_summary(spark.createDataFrame(rows, schema).repartition(4)).first()
    assert [tuple(f) for f in row.failed_files] == [(0, "s0.jpg", "EMPTY_TEXT"), (3, "s3.jpg", "EMPTY_TEXT"), (9, "s9.jpg", "EMPTY_TEXT")]
    assert (row.total_files, row.processed_files, row.success_count, row.failure_count, row.avg_seconds) == (6, 6, 3, 3, 4.0)
    none = ledger.batch_summary(spark.createDataFrame([], schema)).first()
    assert (none.total_files, none.failed_files, none.avg_seconds) == (0, [], 0.0)
