"""Target matching, fingerprints, de-duplication and review flags over the slip fact table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave import rules as R
from slipweave.functions import fields as X
from slipweave.functions.text import (contains_any, date_only, normalize_amount, normalize_for_match, normalize_text,
                                      satang)
from slipweave.operators.ordered import HOT_GROUPS, lookup


def probable_slip(amount: Column, sender: Column, receiver: Column, bank: Column, raw_text: Column) -> Column:
    party = (normalize_text(sender) != "") | (normalize_text(receiver) != "")
    known = ~normalize_text(bank).isin("", R.UNKNOWN_BANK[1])
    words = contains_any(normalize_for_match(raw_text), R.SLIP_WORDS)
    return amount.isNotNull() & (party | known | words)


def target_match(target: str, receiver: Column, raw_text: Column) -> Column:
    """The target name is part of the receiver name or of the text; blanks and case do not matter."""
    wanted = " ".join(target.replace("​", "").split()).lower()
    return F.contains(normalize_for_match(receiver), F.lit(wanted)) | F.contains(normalize_for_match(raw_text), F.lit(wanted))


GRAM_WIDTHS = (8, 4, 2, 1)


def _grams(c: Column, width: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (width - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.lit(width), F.substring(c, i, F.lit(width)))))


def _inner_words(c: Column) -> Column:
    """The words of a normalised name but the first and the last: where the name occurs in a text, these are whole words of it."""
    words = F.split(c, " ")
    return F.array_distinct(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""))


def match_targets(slips: DataFrame, targets: DataFrame, widths: tuple[int, ...] = GRAM_WIDTHS) -> DataFrame:
    """Every (slip, target) pair whose target occurs in the receiver name or the text; ``index`` identifies a slip.

    A target is represented by its rarest inner word; one of fewer than three words by its rarest gram, of the largest of ``widths`` that fits into it. The texts are
    unfolded into (index, hash) only, into words where a target is represented by one and into grams of the widths that targets use; the exact test then
    runs on each candidate pair once.
    """
    norm = targets.select("*", normalize_for_match(F.col("target")).alias("_t"))
    hay = slips.withColumn("_hay", F.concat(normalize_for_match(F.col("receiver_name")), F.lit("\n"),
                                            normalize_for_match(F.col("raw_text"))))
    fits = F.coalesce(*[F.when(F.length("_t") >= w, F.lit(w)) for w in sorted(widths, reverse=True)], F.lit(0))
    sized = norm.select(F.col("_t"), F.when(F.size(_inner_words(F.col("_t"))) > 0, -1).otherwise(fits).alias("_w")).distinct()
    used = sorted(r["_w"] for r in sized.select("_w").distinct().collect())  # at most one row per width
    everywhere = F.array(F.lit(0).cast("bigint"))
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(F.lit(-1), w))
    pick = everywhere
    for w in used:
        pick = F.when(F.col("_w") == w, hashed(_inner_words(F.col("_t"))) if w < 0 else _grams(F.col("_t"), w) if w else everywhere).otherwise(pick)
    exploded = sized.select("_t", F.explode(pick).alias("_g"))
    counted = exploded.groupBy("_g").agg(F.count("*").alias("_n"))
    chosen = exploded.join(counted, "_g").groupBy("_t").agg(F.min(F.struct("_n", "_g"))["_g"].alias("_g"))
    probe = lambda w: hashed(F.split("_hay", "[ \n]")) if w < 0 else _grams(F.col("_hay"), w) if w else everywhere
    probes = F.flatten(F.array(*[probe(w) for w in used])) if used else everywhere
    candidates = (hay.select("index", F.explode(F.array_distinct(probes)).alias("_g")).join(chosen, "_g").select("index", "_t").distinct())
    found = hay.join(candidates, "index").filter(F.contains("_hay", F.col("_t")))
    return found.join(norm, "_t").drop("_hay", "_t")


#: Short escapes of control characters in JSON: fixed values.
CONTROL_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def fingerprint_fields() -> dict[str, Column]:
    return {
        "amount": normalize_amount(F.col("amount")),
        "receiver_bank": normalize_text(F.col("receiver_bank")),
        "receiver_name": normalize_text(F.col("receiver_name")),
        "sender_bank": normalize_text(F.col("sender_bank")),
        "sender_name": normalize_text(F.col("sender_name")),
        "transaction_date": date_only(F.col("transaction_date").cast("string")),
        "transaction_id": normalize_text(F.col("transaction_id")),
        "transaction_time": normalize_text(F.col("transaction_time")),
    }


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds ``fingerprint``: sha256 of the canonical JSON of eight fields, NULL when a required one is empty."""
    parts = fingerprint_fields()
    staged = df.select("*", *[v.alias(f"_f_{k}") for k, v in parts.items()])

    def escaped(c):
        plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        full = plain
        for code in range(0x20):
            full = F.replace(full, F.lit(chr(code)), F.lit(CONTROL_ESCAPES.get(code, f"\\u{code:04x}")))
        return F.when(c.rlike("[\\x00-\\x1f]"), full).otherwise(plain)
    body = []
    for i, k in enumerate(sorted(parts)):
        body += [F.lit(('{' if i == 0 else ', ') + f'"{k}": "'), escaped(F.col(f"_f_{k}")), F.lit('"')]
    complete = F.lit(True)
    for k in R.FINGERPRINT_REQUIRED:
        complete = complete & (F.col(f"_f_{k}") != "")
    return (staged.withColumn("fingerprint", F.when(complete, F.sha2(F.concat(*body, F.lit("}")), 256)))
            .drop(*[f"_f_{k}" for k in parts]))


def fact_rows(parsed: DataFrame) -> DataFrame:
    """Parsed slips as the audit fact table, before any target is applied."""
    named = (parsed.withColumn("bank_name", X.bank_name(F.col("bank_code")))
             .withColumn("receiver_bank", F.when(F.col("receiver_bank_code").isNotNull(), X.bank_name(F.col("receiver_bank_code")))))
    return with_fingerprint(named).select(
        F.col("idx").alias("index"), "file_path", "file_name", F.sha2("raw_text", 256).alias("file_hash"), "raw_text",
        probable_slip(F.col("amount"), F.col("sender_name"), F.col("receiver_name"), F.col("bank_name"), F.col("raw_text"))
        .alias("is_slip"),
        "transaction_date", "transaction_time", "sender_bank", "sender_name", "sender_account", "receiver_bank",
        "receiver_name", "receiver_account", "amount", "currency", "transaction_id", "memo", "bank_name", "fingerprint", "error")


def flag_duplicates(df: DataFrame, keys: list[str] | None = None, hot: int = HOT_GROUPS) -> DataFrame:
    """Adds duplicate, duplicate_of, review_required and review_reason.

    Among matched slips with a fingerprint the first index is the original. ``keys`` separates reports
    (for example one per target). Incomplete fingerprints go to review instead.
    """
    keys = [*(keys or []), "fingerprint"]
    if "review_reason" not in df.columns:
        df = df.withColumn("review_reason", F.lit(None).cast("string"))
    matched = F.col("is_slip") & F.col("target_matched")
    eligible = matched & F.col("fingerprint").isNotNull()
    groups = (df.filter(eligible).groupBy(*keys)
              .agg(F.min(F.struct("index", "file_name")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1"))
    found = lookup(df, groups, keys, eligible, "_n", "index", hot)
    duplicate = F.coalesce(F.col("_first.index") != F.col("index"), F.lit(False))
    incomplete = matched & F.col("fingerprint").isNull()
    reason = F.coalesce("review_reason", F.when(incomplete, F.lit(R.REVIEW_INCOMPLETE)))
    return found.select(*[c for c in df.columns if c != "review_reason"], duplicate.alias("duplicate"),
                        F.when(duplicate, F.col("_first.file_name")).alias("duplicate_of"), reason.alias("review_reason"),
                        (reason.isNotNull() | (F.col("error").isNotNull() & F.col("audit_replay")
                                               if "audit_replay" in df.columns else F.lit(False))).alias("review_required"))


def selection(df: DataFrame) -> DataFrame:
    """Adds ``selection``: unique, review, duplicate or none."""
    slip = F.col("is_slip") & F.col("target_matched")
    return df.withColumn("selection", F.when(F.col("duplicate"), "duplicate")
                         .when(slip & F.col("review_required"), "review")
                         .when(slip & F.col("amount").isNotNull(), "unique").otherwise("none"))


def lawyer_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ten counters and the total of the unique matched slips, one pass."""
    slip = F.col("is_slip") & F.col("target_matched")
    unique = slip & ~F.col("duplicate") & ~F.col("review_required") & F.col("amount").isNotNull()
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("scanned_files"), F.count("*").alias("processed_files"),
        F.count_if("is_slip").alias("probable_slips"), F.count_if("target_matched").alias("matched_raw_before_dedup"),
        F.count_if("target_matched").alias("target_matched"), F.count_if(unique).alias("unique_matched"),
        F.count_if("duplicate").alias("duplicates_excluded"), F.count_if("review_required").alias("review_required"),
        F.count_if(F.col("error").isNotNull()).alias("ocr_failed"),
        (F.coalesce(F.sum(F.when(unique, satang(F.col("amount")))), F.lit(0)) / F.lit(100.0)).alias("total_amount"))


def replay_audit(records: DataFrame, target: str) -> DataFrame:
    """Audit records (stored columns) back to fact rows for another target; only matched rows are kept
    and de-duplicated. They are written first, so that the records are read once."""
    from slipweave.sources.sinks import materialize

    raw = F.coalesce("raw_text", F.lit(""))
    rows = with_fingerprint(records).withColumn("raw_text", raw).withColumn("is_slip", F.coalesce("is_slip", F.lit(False)))
    rows = rows.withColumn("target_matched", target_match(target, F.col("receiver_name"), F.col("raw_text")))
    reason = F.coalesce(F.col("review_reason"), F.when(F.col("fingerprint").isNull(), F.lit(R.REVIEW_INCOMPLETE)),
                        F.when(~F.col("is_slip"), F.lit(R.REVIEW_NOT_SLIP)))
    matched = rows.filter("target_matched").withColumn("review_reason", reason).withColumn("audit_replay", F.lit(True))
    return flag_duplicates(materialize(matched)).drop("audit_replay")
