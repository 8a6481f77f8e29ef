"""Run registered queries against their SQL on DuckDB: python tests/check_oracle.py [sf_dir] [name ...]"""
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from slipweave import session  # noqa: E402


#: Queries without SQL, and the tests that hold them against brute force, an exact round trip or held-out accuracy.
TESTED_ELSEWHERE = {"op2_surrogates": "tests/llm/test_texts.py", "op3_long_lines": "tests/llm/test_copies.py", "op4_divergence_rules": "tests/llm/test_texts.py", "op5_simhash_groups": "tests/llm/test_copies.py",
                    "op6_bpe_round_trip": "tests/llm/test_texts.py", "op8_token_counts": "tests/llm/test_texts.py", "op9_language_id": "tests/llm/test_texts.py", "lid_pages": "tests/llm/test_texts.py",
                    "op10_run_index_dedup": "tests/llm/test_copies.py", "pipeline": "tests/llm/test_pipeline.py"}


def canon(df):
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or str(v) in ("NaT", "<NA>", "nan"):
                cells.append("~")
            elif hasattr(v, "isoformat"):
                cells.append(str(v)[:19].replace(" 00:00:00", ""))
            elif isinstance(v, float) or type(v).__name__.startswith("float"):
                cells.append(repr(float(v)))
            elif type(v).__name__.startswith(("int", "uint")):
                cells.append(repr(float(v)))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def compare(spark, con, sf_dir, name):
    t0 = time.time()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    secs = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} (no sql, see {TESTED_ELSEWHERE.get(name)})", secs, name in TESTED_ELSEWHERE
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} / {sorted(want.columns)}", secs, False
    a, b = canon(got), canon(want)
    if a == b:
        return f"ok {len(a)}", secs, True
    only_a = sorted(set(a) - set(b))[:2]
    only_b = sorted(set(b) - set(a))[:2]
    return f"DIFF spark {len(a)} sql {len(b)}\n   cols {sorted(got.columns)}\n   spark {only_a}\n   sql   {only_b}", secs, False


if __name__ == "__main__":
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = session.build("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    names = args or list(entry.queries())
    bad = 0
    for n in names:
        try:
            text, secs, ok = compare(spark, con, sf_dir, n)
        except Exception as e:  # noqa: BLE001
            text, secs, ok = f"ERROR {type(e).__name__} {str(e)[:600]}", 0, False
        bad += not ok
        print(f"@@ {n:24s} {secs:6.2f}s {text[:1500]}", flush=True)
    print("@@ failed:", bad, "of", len(names), flush=True)
    os._exit(0)
