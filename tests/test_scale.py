"""What slip parsing and file lists do per row: texts are read once, and only narrow rows are shuffled."""
import math
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from slipweave import rules as R
from slipweave.functions import fields as X
from slipweave.functions import text as T, word_runs
from slipweave.functions.regex import prefix_tree
from slipweave.operators import documents, ledger, match
from slipweave.plans.slip_reports import facts, matched, target_name


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_and_lines_brute_force(spark):
    r = random.Random(7)
    words = ["scb", "scb easy", "scbeasy", "กรุงศรี", "กรุงศรีอยุธยา", "อยุธยา", "easy", "a.b", "x"]
    texts = ["", " \n ", *("".join(r.choice([*words, " ", "\n", "\r\n", "\t", "\x1f", "\x85", "　", "sc", "กรุง", "-"]) for _ in range(r.randint(1, 12))) for _ in range(400))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    found = T.occurring(F.col("t"), words)
    rows = df.select("i", "t", T.lines(F.col("t")).alias("lines"), T.contains_any(F.col("t"), words).alias("any"), *[F.contains(found, F.lit(w)).alias(f"w{k}") for k, w in enumerate(words)]).collect()
    for row in rows:
        assert row["lines"] == [x for x in (p.strip(T._BLANKS) for p in re.split(T._LINE_BREAK, row["t"])) if x]
        assert row["any"] == any(w in row["t"] for w in words)
        assert [row[f"w{k}"] for k in range(len(words))] == [w in row["t"] for w in words]


def test_texts_are_read_once(spark, sf_dir):
    """The keywords of a bank do not lower the text one by one, labelled names are not looked for in every line, no lambda decodes a pattern."""
    plan = optimized(entry.queries()["ext_completeness"](spark, sf_dir))
    assert len(re.findall(r"lower\(raw_text", plan)) <= 1
    plan = optimized(entry.queries()["ext_parties"](spark, sf_dir))
    assert not re.search(r"RLIKE", plan)


def test_numbering_moves_no_texts(spark, sf_dir):
    plan = optimized(entry.queries()["src_text_batch"](spark, sf_dir))
    assert not [line for line in plan.split("\n") if "text#" in line and re.search(r"Window|Sort|Repartition|Join|Aggregate", line)]
    below = plan.split("Window", 1)[1]
    assert not re.search(r"Project \[[^\]]*\btext#\d+[,\]]", below)


def test_common_texts_take_small_classes(spark):
    """Lines of ASCII and Thai texts come from two small classes, in one run over the text however long it is, and are those of the classes of all blanks."""
    assert T._COMMON in optimized(spark.range(1).select(T.lines(F.col("id").cast("string")).alias("l")))
    r = random.Random(11)
    texts = ["กa" * 200_000 + "\n b ", *("".join(r.choice(["ก", "น.ส.", "x", " ", "\n", "  ", "-", "7", "\x85", "é", " "]) for _ in range(r.randint(0, 30))) for _ in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for row in df.select("t", T.lines(F.col("t")).alias("lines")).collect():
        assert row["lines"] == [x for x in (p.strip(T._BLANKS) for p in re.split(T._LINE_BREAK, row["t"])) if x]


def test_word_lists_begin_with_one_range():
    """Java tests the members of a class beyond Latin one by one: word lists look ahead for one range and a set of ASCII characters."""
    for words in (R.SENDER_LABELS, R.RECEIVER_LABELS, R.NAME_NOISE, R.PERSON_PREFIXES):
        ahead = re.match(r"\(\?=\[(.*?)\]\)", prefix_tree(words)).group(1)
        assert len([c for c in ahead if c > "~"]) == 2
        assert all(re.match(f"[{ahead}]", w) for w in words)


def test_account_share_brute_force(spark):
    """An account token makes up 65 % of the counted characters, or all of the line but blanks (digits of other scripts count in the line only)."""
    r = random.Random(5)
    parts = ["xxx", "123", "๑๒๓", "-", " ", "4567890", "นาย", "ab", "X", ":", "　", ".", "12"]
    texts = ["", " ", "xxx-x-xx123-4", " ๑๒๓๔๕๖ ", "๑๒๓๔๕๖ a", *("".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(600))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    hits = 0
    for row in df.select("t", X.account_token(F.col("t")).alias("token"), X.account_like(F.col("t")).alias("like")).collect():
        want = False
        if row["token"] is not None:
            token, line = (re.sub(r"[\s\x1c-\x1f]+", "", c) for c in (row["token"], row["t"]))
            token_chars, line_chars = len(re.sub("[^A-Za-z0-9xX-]", "", token)), len(re.sub(r"[^A-Za-z0-9ก-๙xX\.-]", "", line))
            want = token.lower() == line.lower() or line_chars > 0 and token_chars >= R.ACCOUNT_SHARE * line_chars
        assert row["like"] == want, row
        hits += want
    assert hits > 50


def test_held_cells_are_compared_one_by_one(spark):
    """A list of cells would be built by interpreted code, each cell with all that it is made of, for every row."""
    cells = ["date", "time", "bank", "sender", "receiver", "receiver_bank", "amount", "memo"]
    rows = [["-"] * 8, *[["-"] * k + ["x"] + ["-"] * (7 - k) for k in range(8)]]
    df = spark.createDataFrame(rows, cells)
    held = df.select(ledger.has_extracted(df).alias("h"))
    assert [row["h"] for row in held.collect()] == [False] + [True] * 8
    assert "lambda" not in optimized(held)


def test_reports_keep_other_columns(spark, sf_dir):
    """Rows and reports are written together without meeting in a join."""
    f = facts(spark, sf_dir)
    both = ledger.nested_report(f, "file_name", "amount")
    assert "Join" not in optimized(both)
    want = {row["index"]: (row["file_name"], row["amount"]) for row in f.select("index", "file_name", "amount").collect()}
    assert {row["index"]: (row["file_name"], row["amount"]) for row in both.collect()} == want


def test_replayed_records_are_read_once(spark, sf_dir, tmp_path):
    """Groups and rows of the duplicates both start from the matched rows as they were written, not from the records."""
    f = facts(spark, sf_dir)
    f.drop("fingerprint").withColumn("review_reason", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/records")
    done = match.replay_audit(spark.read.parquet(f"{tmp_path}/records"), target_name())
    assert done.inputFiles() and not [path for path in done.inputFiles() if f"{tmp_path}/records" in path]
    wanted = match.flag_duplicates(matched(f).filter("target_matched"))
    columns = ["index", "fingerprint", "duplicate", "duplicate_of", "review_required", "review_reason"]
    assert sorted(map(str, done.select(columns).collect())) == sorted(map(str, wanted.select(columns).collect()))


def test_rarest_runs_brute_force(spark):
    """The first runs in one order for all texts, and of those only what passes the sieve, which holds all of its values and few others."""
    r = random.Random(3)
    texts = [None, "", " \n", "a b", *(" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 40))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    degrees = word_runs.counts(df, 3)
    known, cells = word_runs.Words(), {}
    runs = {i: word_runs.runs_of(t, 3, known).tolist() for i, t in enumerate(texts) if t is not None}
    assert all(len(found) == len({tuple(t.split()[k:k + 3]) for k in range(max(len(t.split()) - 2, 1))}) for t, found in ((texts[i], found) for i, found in runs.items()))
    for found in runs.values():
        for s in found:
            cells[s % len(degrees)] = cells.get(s % len(degrees), 0) + 1
    assert all(degrees[c] == n for c, n in cells.items() if n < 128) and max(cells.values()) < 1 << 20
    order = spark.sparkContext.broadcast(degrees)
    first = {i: sorted(found, key=lambda s: (degrees[s % len(degrees)], s))[:len(found) - math.ceil(len(found) * 0.8 - 1e-9) + 1] for i, found in runs.items()}
    signed = lambda s: s - (1 << 64) if s >> 63 else s
    assert sorted(row["s"] for row in word_runs.rarest(df, order, 3, 0.8).collect()) == sorted(signed(s) for found in first.values() for s in found)
    kept = {s for found in first.values() for s in found[::2]}
    held = spark.sparkContext.broadcast(word_runs.sieve(spark.createDataFrame([(signed(s),) for s in kept], "s bigint")))
    got = [(row["doc_id"], row["n"], row["s"]) for row in word_runs.rarest(df, order, 3, 0.8, held).collect()]
    want = [(i, len(runs[i]), signed(s)) for i, found in first.items() for s in found if s in kept]
    assert set(want) <= set(got) and len(got) <= len(want) + 20 and len(set(got)) == len(got)


def test_runs_of_texts_are_never_shuffled(spark, sf_dir):
    """What is written and shuffled of the texts are the rarest runs that another text has, and the runs of texts in pairs."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(400))) for i in range(50)], "doc_id long, text string")
    firsts = docs.select("doc_id")
    prefix = documents._rarest(docs, firsts, 0.8, 5, 512)
    assert prefix.count() == 0
    pairs = docs.filter("doc_id = 0").select("doc_id", F.lit(1).cast("bigint").alias("other"))
    assert [tuple(row) for row in documents._similarities(pairs, docs, 5).collect()] == [(0, 1, 0.0)]
