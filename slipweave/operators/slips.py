"""Slip parsing jobs: a table of texts becomes a table of fields, without a shuffle."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from slipweave import rules as R
from slipweave.functions import fields as X, slip_rules
from slipweave.functions.regex import any_of, quoted
from slipweave.functions.text import contains_any, first_of, first_where, has, let, lines, raw_lines, rx, squeeze, strip, sub


def with_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.withColumn("lines", lines(F.coalesce(F.col(text), F.lit(""))))


def with_parties(df: DataFrame) -> DataFrame:
    """Adds sender and receiver name and account from ``lines``.

    Each line is described once (name, account, labels); the five rule stages then pick the first line
    that qualifies.
    """
    def describe(l):
        return let(F.struct(F.lower(l).alias("low"), X.account_token(l).alias("token")), lambda x: F.struct(
            X.name_of_line(l, x["token"]).alias("name"), strip(x["token"]).alias("acc"),
            X.sender_label(x["low"]).alias("s"), X.receiver_label(x["low"]).alias("r"), l.alias("line")))
    described = df.withColumn("_d", F.transform("lines", describe))
    around = described.withColumn("_l", F.transform("_d", lambda d, i: F.struct(
        i.alias("i"), d["name"].alias("name"), d["acc"].alias("acc"), d["s"].alias("s"), d["r"].alias("r"),
        d["line"].alias("line"),
        F.get("_d", i + 1)["name"].alias("name1"), F.get("_d", i + 1)["acc"].alias("acc1"),
        F.coalesce(F.get("_d", i + 1)["acc"], F.get("_d", i + 2)["acc"]).alias("acc_below"))))

    labelled = around.select(
        "*",
        first_of(F.transform("_l", lambda x: F.when(x["s"], F.coalesce(x["name"], x["name1"])))).alias("_sn"),
        first_of(F.transform("_l", lambda x: F.when(x["s"], F.coalesce(x["acc"], x["acc1"])))).alias("_sa"),
        first_of(F.transform("_l", lambda x: F.when(x["r"], F.coalesce(x["name"], x["name1"])))).alias("_rn"),
        first_of(F.transform("_l", lambda x: F.when(x["r"], F.coalesce(x["acc"], x["acc1"])))).alias("_ra"),
        F.get(F.filter("_l", lambda x: x["r"]), F.lit(0))["i"].alias("_cue"),
        F.get(F.filter("_l", lambda x: x["r"] & ~(x["name"].isNotNull() & x["acc"].isNotNull())), F.lit(0))["i"]
        .alias("_late_cue"))

    # sender by position: first unlabelled name with an account on it or on the two lines below
    inferred = labelled.withColumn("_q", F.when(F.col("_sn").isNull() | F.col("_sa").isNull(), first_where(
        "_l", lambda x: x["name"].isNotNull() & ~x["r"] & F.coalesce(x["acc"], x["acc_below"]).isNotNull())))
    sender = inferred.select(
        "*", F.coalesce("_sn", F.col("_q.name")).alias("sender_name"),
        F.coalesce("_sa", F.coalesce("_q.acc", "_q.acc_below")).alias("sender_account"))

    # receiver below the first receiver cue
    section = sender.withColumn("_sec", F.when(F.col("_rn").isNull() | F.col("_ra").isNull(), F.filter(
        "_l", lambda x: (x["i"] > F.col("_cue")) & ~x["r"] & ~x["line"].isin(R.SEPARATOR_LINES))))
    named = section.withColumn("_k", F.when(F.col("_rn").isNull(), first_where("_sec", lambda x: x["name"].isNotNull())))
    cued = named.select(
        "*", F.coalesce("_rn", "_k.name").alias("_rn3"),
        F.coalesce("_ra", first_of(F.transform("_sec", lambda x: F.when(
            ~F.equal_null(x["i"], F.col("_k.i")),
            F.coalesce(x["acc"], x["acc1"]))))).alias("_ra3"))

    # receiver by name and account together, not the sender's
    def together(x):
        other = ~F.equal_null(x["acc"], F.col("sender_account"))
        both = x["name"].isNotNull() & x["acc"].isNotNull()
        below = (x["name"].isNotNull() & x["acc_below"].isNotNull()
                 & ~F.equal_null(x["acc_below"], F.col("sender_account")))
        return (both & ~x["s"] & other) | (~both & F.coalesce(x["i"] > F.col("_late_cue"), F.lit(False)) & ~x["r"] & below)

    open_ = F.col("_rn3").isNull() | F.col("_ra3").isNull()
    paired = cued.withColumn("_q4", F.when(open_, first_where("_l", together)))
    paired = paired.select(
        "*", F.coalesce("_rn3", "_q4.name").alias("_rn4"),
        F.coalesce("_ra3", F.when(F.col("_q4.acc").isNotNull(), F.col("_q4.acc")).otherwise(F.col("_q4.acc_below")))
        .alias("_ra4"))

    # first name with an account below the sender's account
    start = F.coalesce(F.get(F.filter("_l", lambda x: F.contains(x["line"], F.col("sender_account"))), F.lit(0))["i"] + 1,
                       F.lit(0))
    open_ = F.col("_rn4").isNull() | F.col("_ra4").isNull()
    last = paired.withColumn("_start", start).withColumn("_q5", F.when(open_, first_where(
        "_l", lambda x: (x["i"] >= F.col("_start")) & x["name"].isNotNull()
        & F.coalesce(x["acc"], x["acc_below"]).isNotNull()
        & ~F.equal_null(F.coalesce(x["acc"], x["acc_below"]), F.col("sender_account")))))
    done = last.select("*", F.coalesce("_rn4", "_q5.name").alias("receiver_name"),
                       F.coalesce("_ra4", F.coalesce("_q5.acc", "_q5.acc_below")).alias("receiver_account"))
    return done.drop(*[c for c in done.columns if c.startswith("_")])


def with_receiver_bank(df: DataFrame) -> DataFrame:
    """Bank of the first six lines of the receiver section, else of four lines from the second account."""
    cue = first_where(F.transform("lines", lambda l, i: F.when(let(F.lower(l), X.receiver_label), i)), lambda i: i.isNotNull())
    accounts = F.filter(F.transform("lines", lambda l, i: F.when(has(l, R.ACCOUNT_PATTERN), i)), lambda i: i.isNotNull())
    located = df.withColumn("_cue", cue).withColumn("_second", F.get(accounts, F.lit(1)))
    picked = located.withColumn("_part", F.when(F.col("_cue").isNotNull(), F.slice("lines", F.col("_cue") + 1, F.lit(6)))
                                .when(F.col("_second").isNotNull(), F.slice("lines", F.col("_second") + 1, F.lit(4))))
    scored = X.with_bank(picked.withColumn("_text", F.array_join("_part", "\n")), "_text", "_rb")
    return (scored.withColumn("receiver_bank_code", F.nullif(F.col("_rb.code"), F.lit("UNKNOWN")))
            .drop("_cue", "_second", "_part", "_text", "_rb"))


def _with_rules(df: DataFrame, of_text: Callable, columns: dict[str, str]) -> DataFrame:
    """Adds what ``of_text`` makes of ``raw_text``, as ``columns`` (name -> type): one Python function over Arrow batches, all other columns pass through."""
    at, names = df.columns.index("raw_text"), [*df.columns, *columns]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "double": pa.float64(), "date": pa.date32(), "boolean": pa.bool_()}
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            rows = [of_text(t and t.decode("utf-8", "replace")) for t in texts]
            fields = zip(*rows) if rows else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, kinds[k]) for c, k in zip(fields, columns.values())]], names=names)
    parsed = StructType(df.schema.fields + StructType.fromDDL(", ".join(f"{c} {k}" for c, k in columns.items())).fields)
    return df.mapInArrow(run, parsed)


def parse_slips(df: DataFrame) -> DataFrame:
    """End-to-end job: text row -> fact row. Empty texts become failed rows, never exceptions.

    All rules run on a text in one Python function. The column functions above say the same and serve the jobs that need some fields only.
    """
    return _with_rules(df, slip_rules.parse, slip_rules.COLUMNS)


# ---- other party variants ---------------------------------------------------------------------

def labelled_parties(line_array: Column) -> Column:
    """struct(sender, receiver) from labels only; masked names first, 'Unknown' when absent."""
    def name(line):
        # a masked name has a mask in it, a plain one a blank
        token = lambda s: F.coalesce(F.when(has(s, r"[\*xX]"), rx(s, R.LABELLED_MASKED)), F.when(has(s, r"\s"), rx(s, R.LABELLED_NAME)))
        return let(strip(let(strip(X.without_label(line)), token)),
                   lambda found: F.when((F.length(found) >= 2) & ~contains_any(found, R.LABELLED_NOISE), found))

    described = F.transform(line_array, lambda l: let(F.lower(l), lambda low: F.struct(
        l.alias("line"), contains_any(low, R.LABELLED_SENDER).alias("s"), contains_any(low, R.LABELLED_RECEIVER).alias("r"))))

    def pick(arr, flag):
        # names are looked for in labelled lines and those below them only
        return F.coalesce(first_of(F.transform(arr, lambda x, i: F.when(
            x[flag], F.coalesce(name(x["line"]), name(F.get(arr, i + 1)["line"]))))), F.lit("Unknown"))
    return F.get(F.transform(F.array(described), lambda arr: F.struct(
        pick(arr, "s").alias("sender"), pick(arr, "r").alias("receiver"))), F.lit(0))


def labelled_fields(df: DataFrame) -> DataFrame:
    """Adds the six fields of the labelled variant: bank by the longest keyword, amount near a label, date as text, labelled parties, short reference."""
    return _with_rules(df, slip_rules.labelled, slip_rules.LABELLED_COLUMNS)


def prefix_parties(line_array: Column) -> Column:
    """struct(sender, receiver): the last labelled line wins, then the first two titled names."""
    def clean(v):
        for p in R.PREFIX_CLEANUPS:
            v = sub(v, p, "")
        return strip(v)

    words = R.PREFIX_SENDER + R.PREFIX_RECEIVER

    def by_label(arr, keys):
        def of_line(line, i):
            def tried(low):
                long_ = lambda v: F.when(F.length(v) > 3, v)
                below = let(clean(F.coalesce(F.get(arr, i + 1), F.lit(""))), lambda b: F.when((F.length(b) > 3) & ~contains_any(F.lower(b), words), b))
                return F.coalesce(*[F.when(F.contains(low, F.lit(kw)), F.coalesce(
                    let(clean(F.regexp_extract(line, f"(?i){quoted(kw)}\\s*[:\\-]?\\s*(.+)", 1)), long_), below)) for kw in keys])
            return F.when(contains_any(F.lower(line), keys), let(F.lower(line), tried))
        return F.get(F.reverse(F.filter(F.transform(arr, of_line), lambda v: v.isNotNull())), F.lit(0))

    def titled(arr):
        names = F.transform(arr, lambda l: clean(rx(l, R.PREFIX_NAME, 1, True)))
        return F.array_distinct(F.filter(names, lambda n: F.length(n) > 3))

    def choose(arr):
        return F.struct(F.coalesce(by_label(arr, R.PREFIX_SENDER), F.get(titled(arr), F.lit(0)), F.lit("UNKNOWN")).alias("sender"),
                        F.coalesce(by_label(arr, R.PREFIX_RECEIVER), F.get(titled(arr), F.lit(1)), F.lit("UNKNOWN")).alias("receiver"))
    return F.get(F.transform(F.array(line_array), choose), F.lit(0))


def pivot_parties(line_array: Column) -> Column:
    """struct(sender, receiver): nearest acceptable line above and below the pivot line."""
    def describe(raw):
        l = F.replace(raw, F.lit(R.RANK_REPAIR[0]), F.lit(R.RANK_REPAIR[1]))
        titled = l.rlike(R.PIVOT_TITLE)
        base = ~(l.rlike(R.PIVOT_BANK_LINE) | l.rlike(r"\d") | l.rlike(R.PIVOT_SYSTEM_LINE)) & (
            titled | l.rlike(R.PIVOT_PLAIN_NAME))
        return F.struct(l.alias("line"), titled.alias("titled"), base.alias("up"),
                        (base & (l != "***") & ~F.contains(F.lower(l), F.lit("xxx"))).alias("down"),
                        F.rlike(l, F.lit(any_of(R.PIVOT_WORDS))).alias("pivot"))

    def choose(arr):
        at = F.array_position(F.transform(arr, lambda x: x["pivot"]), F.lit(True)).cast("int")
        above = F.get(F.reverse(F.filter(arr, lambda x, i: (i < at - 1) & x["up"])), F.lit(0))["line"]
        below = F.get(F.filter(arr, lambda x, i: (i > at - 1) & x["down"]), F.lit(0))["line"]
        names = F.filter(arr, lambda x: x["titled"])
        sender = F.when(at > 0, above)
        receiver = F.when(at > 0, below)
        return F.struct(
            F.coalesce(sender, F.get(names, F.lit(0))["line"], F.lit("Unknown")).alias("sender"),
            F.coalesce(F.when(sender.isNull(), F.get(names, F.lit(1))["line"]), receiver, F.lit("Unknown")).alias("receiver"))
    return F.get(F.transform(F.array(F.transform(line_array, describe)), choose), F.lit(0))


def found_fields(bank, amount, date, sender, receiver, ref) -> Column:
    """map(field -> whether the extraction found it) of the six fields that completeness counts."""
    found = {"bank": bank != "Unknown", "amount": amount > 0, "date": date != "Unknown", "sender": sender != "Unknown", "receiver": receiver != "Unknown", "reference": ref != "Unknown"}
    return F.create_map(*[x for name, c in found.items() for x in (F.lit(name), F.coalesce(c, F.lit(False)))])


def completeness(bank, amount, date, sender, receiver, ref) -> Column:
    found = F.map_values(found_fields(bank, amount, date, sender, receiver, ref))
    return F.round(F.size(F.filter(found, lambda c: c)) / F.lit(6.0), 2)


def fill_rates(df: DataFrame, found: str) -> DataFrame:
    """field, filled, n, share: in how many of all rows each field of the map column was found."""
    return df.select(F.explode(found).alias("field", "_f")).groupBy("field").agg(
        F.count_if("_f").alias("filled"), F.count("*").alias("n"), (F.count_if("_f") / F.count("*")).alias("share"))


def merge_fill(primary: DataFrame, rules: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Primary extraction wins per field, rule extraction fills the gaps."""
    p, r = primary.alias("p"), rules.alias("r")
    return p.join(r, key, "full").select(key, *[F.coalesce(F.col(f"p.{c}"), F.col(f"r.{c}")).alias(c) for c in columns])


def brand_fallback(bank: Column, brand: Column) -> Column:
    """The bank of the text; where that is unknown, the brand that a second source has recognised."""
    unknown = lambda c: F.coalesce(c, F.lit(R.UNKNOWN_BANK[0])) == R.UNKNOWN_BANK[0]
    return F.when(unknown(bank) & ~unknown(brand), brand).otherwise(bank)
