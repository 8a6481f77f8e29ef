"""Field extraction from slip text as column expressions.

Every cascade works on one row at a time: the lines of a slip stay an array inside the row, so a table
of slips is parsed without a shuffle. Precedence is the order of ``coalesce`` branches, which stop at
the first hit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave import rules as R
from slipweave.functions.regex import DIGIT, THAI, any_of, literal_core, quoted, to_java
from slipweave.functions.text import (ascii_digits, contains_any, first_of, first_where, has, let, occurring, rx, rx_all,
                                      squeeze, strip, sub, to_int)


# ---- banks ------------------------------------------------------------------------------------

def _sql_test(column: str, pattern: str, words: str) -> str:
    core = literal_core(pattern)
    guard = f"contains({words}, '{core}')" if core else "true"
    return guard if core == pattern else f"({guard} AND {column} RLIKE r'{to_java(pattern)}')"


#: Account patterns are made of digits and dashes, so they are looked for in such runs only.
ACCOUNT_RUN = r"[\d-]{12,}"


def with_bank(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out`` = struct(code, confidence): the best scored bank, the earlier rule on ties.

    A hit weighs the length of its pattern; the sums run in whole hundredths so that ties are exact. The text is read once for the words that patterns contain and
    once for runs of digits and dashes; the tests run on what was found.
    """
    cores = [core for _, patterns, _ in R.BANK_PATTERNS for core in map(literal_core, patterns) if core]
    parts = []
    for ord_, (code, patterns, account) in enumerate(R.BANK_PATTERNS):
        # count and weight of the hits travel in one integer: 1000 per hit plus tenths
        packed = " + ".join(f"CASE WHEN {_sql_test('_low', p, '_words')} THEN {1000 + max(len(p), 5)} ELSE 0 END" for p in patterns)
        bonus = f"CASE WHEN _runs RLIKE r'{to_java(account)}' THEN 100 ELSE 0 END" if account else "0"
        parts.append(f"named_struct('packed', {packed}, 'bonus', {bonus}, 'neg_ord', {-ord_}, 'code', '{code}')")
    read = df.withColumn("_low", F.lower(text)).withColumn("_words", occurring(F.col("_low"), cores)).withColumn(
        "_runs", F.array_join(rx_all(F.col(text), ACCOUNT_RUN), "\n"))
    scored = (read.withColumn("_raw", F.expr(f"array({', '.join(parts)})"))
              .withColumn("_sc", F.expr(
                  "filter(transform(_raw, r -> named_struct('score', (r.packed % 1000) * "
                  "CASE WHEN r.packed >= 2000 THEN 13 ELSE 10 END + r.bonus, 'neg_ord', r.neg_ord, 'code', r.code)), "
                  "r -> r.score > 0)")))
    return scored.withColumn(out, F.expr(
        "named_struct('code', coalesce(array_max(_sc).code, 'UNKNOWN'), 'confidence', "
        "coalesce(array_max(_sc).score / nullif(aggregate(_sc, 0, (a, r) -> a + r.score), 0), 0D))")
    ).drop("_low", "_words", "_runs", "_raw", "_sc")


def bank_name(code: Column) -> Column:
    out = F.lit(R.UNKNOWN_BANK[1])
    for c, name in R.BANK_NAMES:
        out = F.when(code == c, F.lit(name)).otherwise(out)
    return out


def bank_longest_keyword(text: Column) -> Column:
    """Code of the longest keyword contained in the text, the earlier keyword on ties."""
    ranked = sorted(range(len(R.BANK_KEYWORDS)), key=lambda i: (-len(R.BANK_KEYWORDS[i][0]), i))
    return let(occurring(F.lower(text), [word.lower() for word, _ in R.BANK_KEYWORDS]), lambda found: F.coalesce(
        *[F.when(F.contains(found, F.lit(R.BANK_KEYWORDS[i][0].lower())), F.lit(R.BANK_KEYWORDS[i][1])) for i in ranked], F.lit("Unknown")))


def bank_last_group(text: Column) -> Column:
    """The last brand group with a keyword in the text."""
    return let(occurring(F.lower(text), [k for _, keys in R.BRAND_KEYWORDS for k in keys]), lambda found: F.coalesce(
        *[F.when(contains_any(found, keys), F.lit(brand)) for brand, keys in reversed(R.BRAND_KEYWORDS)], F.lit("UNKNOWN")))


# ---- amounts ----------------------------------------------------------------------------------

def amount_value(token: Column) -> Column:
    """A number token as an amount; NULL for more than nine integer digits, non-numbers, zero and values
    beyond the limit."""
    def check(plain):
        short = F.length(F.regexp_extract(plain, r"^\d*", 0)) <= 9
        return F.when(short, let(plain.try_cast("double"), lambda v: F.when((v > 0) & (v <= R.AMOUNT_MAX), v)))
    return let(ascii_digits(F.replace(token, F.lit(","), F.lit(""))), check)


def amount_cascade(text: Column, line_array: Column) -> Column:
    """Labelled or two-decimal number of the first line that has one, then the text patterns, then the
    largest two-decimal number that is not a year."""
    def of_line(line):
        found = F.coalesce(amount_value(rx(line, R.AMOUNT_LABELLED, 1, True)), amount_value(rx(line, R.AMOUNT_DECIMAL, 1)))
        return F.when(has(line, r"\d") & ~has(line, R.AMOUNT_SKIP_LINE, True), found)

    by_line = first_of(F.transform(line_array, of_line))
    by_pattern = [first_of(F.transform(rx_all(text, p, 1, True), amount_value)) for p in R.AMOUNT_PATTERNS]
    largest = F.array_max(F.filter(F.transform(rx_all(text, r"[\d,]+\.\d{2}"), amount_value),
                                   lambda v: v.isNotNull() & ~v.between(2000, 2100)))
    return F.coalesce(by_line, *by_pattern, largest)


def amount_near_label(line_array: Column) -> Column:
    """Highest (label priority, value) over every number of every line, 0.0 when there is none."""
    def of_line(line):
        near = contains_any(F.lower(line), R.AMOUNT_LABELS_NEAR)
        return let(F.when(near, 10).otherwise(1), lambda priority: F.transform(rx_all(line, r"[\d,]+\.?\d{0,2}"), lambda m: F.struct(
            priority.alias("priority"), ascii_digits(F.replace(m, F.lit(","), F.lit(""))).try_cast("double").alias("value"))))

    numbers = F.filter(F.flatten(F.transform(line_array, of_line)),
                       lambda s: (s["value"] > 0) & ~s["value"].between(2000, 2100))
    return F.coalesce(F.array_max(numbers)["value"], F.lit(0.0))


def amount_by_currency(text: Column) -> Column:
    tries = []
    for p in R.AMOUNT_CURRENCY_PATTERNS:
        value = ascii_digits(F.replace(rx(text, p, 1, True), F.lit(","), F.lit(""))).try_cast("double")
        tries.append(F.when(value > 0, value))
    return F.coalesce(*tries, F.lit(0.0))


def amount_display(text: Column) -> Column:
    """struct(amount, confidence) of a noisy amount cell."""
    cleaned = F.regexp_replace(F.regexp_replace(text, "[฿B$€THBthbบาท]", ""), r"(?U)\s+", "")
    number = F.regexp_extract(cleaned, r"\d+(?:,\d{3})*(?:\.\d{2})?", 0)
    dots = F.regexp_replace(cleaned, r"[^\d.]", "")
    return (F.when(F.coalesce(text, F.lit("")) == "", F.struct(F.lit("").alias("amount"), F.lit(0).alias("confidence")))
            .when(number != "", F.struct(
                F.concat(number, F.lit(" THB")).alias("amount"),
                F.when(F.length(text) - F.length(number) <= 5, 99).otherwise(85).alias("confidence")))
            .when(dots != "", F.struct(F.concat(dots, F.when(F.contains(dots, F.lit(".")), "").otherwise(".00"),
                                                F.lit(" THB")).alias("amount"), F.lit(60).alias("confidence")))
            .otherwise(F.struct(F.lit("0.00 THB").alias("amount"), F.lit(0).alias("confidence"))))


# ---- dates and times --------------------------------------------------------------------------

def _date(year: Column, month: Column, day: Column) -> Column:
    """NULL for an impossible date. Months and days have two digits at most."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return let(year, lambda y: F.when((y >= 1) & (y <= 9999), F.concat(
        F.lpad(y.cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day)).try_cast("date")))


def _common_era(year: Column) -> Column:
    return F.when(year > 2100, year - R.BUDDHIST_OFFSET).otherwise(year)


def _numeric_date(text: Column, pattern: str, year_rule) -> Column:
    def build(parts):
        return _date(let(to_int(parts[2]), year_rule), to_int(parts[1]), to_int(parts[0]))
    return let(rx(text, pattern), lambda m: F.when(m.isNotNull(), let(_date_parts(m), build)))


def _date_parts(token: Column) -> Column:
    """The three numbers of a numeric date as texts."""
    return F.split(F.translate(token, "-.", "//"), "/")


def month_scan() -> list[tuple[str, int]]:
    table = []
    for number, (full, short) in enumerate(R.THAI_MONTHS, start=1):
        table += [(full, number), (short, number), (short.rstrip("."), number)]
    table += R.MONTH_SCAN_ALIASES
    return sorted(table, key=lambda t: -len(t[0]))


def _named_month_date(text: Column) -> Column:
    """Date with a written month. Longer month names are tried first; per name only its first place in
    the text counts. The year is looked at but not consumed, so neighbouring dates may share digits."""
    ranks = F.create_map(*[F.lit(v) for i, (name, number) in enumerate(month_scan()) for v in (name, i * 100 + number)])
    day_month, year = rf"\d{{1,2}}\s*(?:{any_of([n for n, _ in month_scan()])})", r"\s*\d{2,4}"
    # the text is read once: a look-ahead takes the whole date, what follows consumes day and month only
    tokens = rx_all(text, f"(?=({day_month}{year})){day_month}(?={year})", 1)
    parts = F.transform(tokens, lambda t: let(rx(t, r"\d+\Z"), lambda y: F.struct(
        rx(t, r"^\d{1,2}").alias("d"), strip(rx(F.substring(t, F.lit(1), F.length(t) - F.length(y)), r"^\d{1,2}\s*(.*)", 1)).alias("m"), y.alias("y"))))

    def build(p, i):
        year = let(to_int(p["y"]), lambda y: _common_era(F.when(y < 100, y + 2500).otherwise(y)))
        return let(F.element_at(ranks, p["m"]), lambda key: F.struct(
            (key.cast("int") / 100).cast("int").alias("rank"), i.alias("pos"), _date(year, key % 100, to_int(p["d"])).alias("date")))

    def best(found):
        valid = F.filter(found, lambda x: x["date"].isNotNull() & ~F.exists(
            found, lambda y: (y["rank"] == x["rank"]) & (y["pos"] < x["pos"])))
        return F.array_min(valid)["date"]
    return let(F.transform(parts, build), best)


def date_cascade(text: Column, line_array: Column) -> Column:
    """First valid date by rule order; an impossible calendar date falls through to the next rule."""
    long_form = _numeric_date(text, R.NUMERIC_DATE_LONG, _common_era)
    short_form = _numeric_date(text, R.NUMERIC_DATE_SHORT, lambda y: y + F.when(y < 70, 2000).otherwise(1900))
    thai_month = _named_month_date(text)
    compact = first_of(F.transform(rx_all(text, R.COMPACT_DATE), lambda m: _date(
        to_int(F.substring(m, 1, 4)), to_int(F.substring(m, 5, 2)), to_int(F.substring(m, 7, 2)))))

    def of_reference_line(line):
        return F.when(has(line, R.COMPACT_DATE_LINE, True), let(rx(line, R.COMPACT_SHORT_DATE), lambda m: _date(
            to_int(F.substring(m, 1, 2)) + 2000, to_int(F.substring(m, 3, 2)), to_int(F.substring(m, 5, 2)))))
    return F.coalesce(long_form, short_form, thai_month, compact, first_of(F.transform(line_array, of_reference_line)))


def time_cascade(text: Column) -> Column:
    def clock(pattern):
        # the pattern matches the found piece as it did the text
        return let(rx(text, pattern), lambda m: F.when(m.isNotNull(), F.concat(F.lpad(rx(m, pattern, 1), 2, "0"), F.lit(":"), rx(m, pattern, 2))))
    return F.coalesce(*[clock(p) for p in R.TIME_PATTERNS])


def date_to_buddhist(text: Column) -> Column:
    """struct(normalized, confidence): month names to Thai short form, years to the Buddhist era."""
    value = F.trim(text)
    for english, (_, short) in zip(R.ENGLISH_MONTHS, R.THAI_MONTHS):
        value = F.regexp_replace(value, f"(?i){english}", short)

    def year_25(v):
        short_year = F.regexp_extract(v, r"[\s.\-/](\d{2})(?:\s|\z)", 1)
        return F.when(short_year.try_cast("int").between(51, 98), F.regexp_replace(
            v, r"(?s)^(.*?[\s.\-/])(\d{2})(?=\s|\z)", "$125$2")).otherwise(v)

    # a common-era year is a separate word of four digits starting with 20
    def to_be(v):
        pieces = F.split(v, r"(?<![A-Za-z0-9_])(?=20\d{2}(?![A-Za-z0-9_]))")
        shifted = F.array_join(F.transform(pieces, lambda p: F.when(
            p.rlike(r"^20\d{2}(?![A-Za-z0-9_])"),
            F.concat((F.substring(p, 1, 4).try_cast("int") + R.BUDDHIST_OFFSET).cast("string"),
                     F.substring(p, 5, 1 << 20))).otherwise(p)), "")
        return F.struct(shifted.alias("normalized"),
                        F.when(v.rlike(r"(?<![A-Za-z0-9_])20\d{2}(?![A-Za-z0-9_])"), 99).otherwise(80).alias("confidence"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.struct(F.lit("").alias("normalized"), F.lit(0).alias("confidence"))
                  ).otherwise(F.get(F.transform(F.transform(F.array(value), year_25), to_be), F.lit(0)))


def date_text(text: Column) -> Column:
    """The date as dd/mm/yyyy or 'dd month yyyy' text, 'Unknown' when none is found."""
    def numeric(pattern, rule):
        def build(p):
            return F.concat_ws("/", two(to_int(p[0])), two(to_int(p[1])), let(to_int(p[2]), rule).cast("string"))
        return let(rx(text, pattern), lambda m: F.when(m.isNotNull(), let(_date_parts(m), build)))

    def in_words(m):
        day, month, year = (rx(m, R.THAI_DATE_LOOSE, g) for g in (1, 2, 3))
        return F.when(m.isNotNull(), F.concat_ws(" ", two(to_int(day)), strip(month), let(to_int(year), _common_era).cast("string")))

    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    written = let(rx(text, R.THAI_DATE_LOOSE), in_words)
    return F.coalesce(numeric(R.NUMERIC_DATE_LONG, _common_era),
                      numeric(R.NUMERIC_DATE_SHORT, lambda y: y + F.when(y < 70, 2000).otherwise(1900)),
                      written, F.lit("Unknown"))


def time_text(text: Column) -> Column:
    pattern = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"

    def build(m):
        hh, mm, ss = (rx(m, pattern, g) for g in (1, 2, 3))
        return F.when(m.isNotNull(), F.concat(F.lpad(to_int(hh).cast("string"), 2, "0"), F.lit(":"), mm, F.coalesce(F.concat(F.lit(":"), ss), F.lit(""))))
    return F.coalesce(let(rx(text, pattern), build), F.lit("Unknown"))


def date_day_repaired(text: Column) -> Column:
    """Thai or English short-month date; an impossible day is read backwards, else becomes 14; the time
    is appended. Falls back to a plain dd/mm/yyyy."""
    names = any_of([short for _, short in R.THAI_MONTHS]) + "|" + "|".join(R.ENGLISH_MONTHS)
    pattern = rf"(\d{{1,2}})\s*({names})\s*(\d{{2,4}})"
    clock = rx(text, r"\b\d{2}:\d{2}(?::\d{2})?\b")

    def fixed(day):
        turned = F.reverse(day.cast("string")).try_cast("int")
        return F.when(day <= 31, day).when((day > 9) & (turned <= 31), turned).otherwise(F.lit(14))

    def build(m):
        return F.when(m.isNotNull(), F.concat(
            let(to_int(rx(m, pattern, 1, True)), fixed).cast("string"), F.lit(" "), rx(m, pattern, 2, True), F.lit(" "), rx(m, pattern, 3, True),
            F.coalesce(F.concat(F.lit(" - "), clock), F.lit(""))))
    written = let(rx(text, pattern, 0, True), build)
    return F.coalesce(written, rx(text, r"\b(\d{2})/(\d{2})/(\d{4}|\d{2})\b"), F.lit("UNKNOWN"))


# ---- references, memo -------------------------------------------------------------------------

def reference(text: Column) -> Column:
    return F.coalesce(*[strip(rx(text, p, 1, True)) for p in R.REFERENCE_PATTERNS])


def reference_short(text: Column) -> Column:
    return F.coalesce(*[strip(rx(text, p, 1, True)) for p in R.REFERENCE_PATTERNS_SHORT], F.lit("Unknown"))


def memo(raw_line_array: Column) -> Column:
    """Text after a memo label or on the next line, unless it reads like another field."""
    labels = any_of(R.MEMO_LABELS)
    after = f"(?i)(?:{labels})[: \\t\\x0B\\f\\x1C-\\x1F\\x85\\xA0]*([^\\n].*)"

    def candidates(arr):
        def of_line(line, i):
            same = F.nullif(strip(F.regexp_extract(line, after, 1)), F.lit(""))
            following = F.nullif(strip(F.get(arr, i + 1)), F.lit(""))
            return F.when(contains_any(F.lower(line), R.MEMO_LABELS), F.coalesce(same, following))
        return F.filter(F.transform(arr, of_line), lambda c: c.isNotNull())

    def acceptable(c):
        other = F.lit(False)
        for p in R.REFERENCE_PATTERNS + R.AMOUNT_PATTERNS:
            other = other | has(c, p, True)
        for p in [R.NUMERIC_DATE_LONG, R.NUMERIC_DATE_SHORT, R.THAI_DATE_LOOSE] + R.TIME_PATTERNS:
            other = other | has(c, p)
        return ~other
    found = F.get(F.transform(F.array(raw_line_array), candidates), F.lit(0))
    return first_where(found, acceptable)


# ---- accounts and names -----------------------------------------------------------------------

def account(line: Column) -> Column:
    return strip(account_token(line))


def account_token(line: Column) -> Column:
    # every account begins with three of its characters, perhaps behind a word
    return F.when(has(line, r"[xX\d]{3}"), rx(line, R.ACCOUNT_PATTERN))


def account_like(value: Column, token: Column | None = None) -> Column:
    """The account token makes up most of the line, or all of it but blanks. ``token`` is the line's account token where that is known."""
    def of_token(found):
        token_chars = F.length(F.regexp_replace(found, "[^A-Za-z0-9xX-]+", ""))
        line_chars = F.length(F.regexp_replace(value, f"[^A-Za-z0-9{THAI}xX\\.-]+", ""))
        share = let(line_chars, lambda n: (n > 0) & (token_chars >= R.ACCOUNT_SHARE * n))
        return F.when(found.isNull(), F.lit(False)).when(F.length(found) == F.length(value), F.lit(True)).otherwise(share | (strip(found) == strip(value)))
    return let(account_token(value) if token is None else token, of_token)


def noise_vocabulary() -> list[str]:
    """Tokens of headers, bank names and bank patterns."""
    import re
    texts = [name for _, name in R.BANK_NAMES] + [p for _, ps, _ in R.BANK_PATTERNS for p in ps]
    tokens = set(R.HEADER_TOKENS)
    for t in texts:
        bare = re.sub(r"\\[A-Za-z.]", " ", t).lower()
        tokens.update(re.findall(f"[a-z]{{3,}}|[{THAI}]{{2,}}", bare))
    return sorted(tokens)


def name_tokens_of_low(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"[A-Za-z]{{2,}}|[{THAI}]{{2,}}"), F.lit(0))


def name_tokens(value: Column) -> Column:
    return name_tokens_of_low(F.lower(value))


def is_header_name(value: Column) -> Column:
    """Nothing but bank or header words."""
    vocab = noise_vocabulary()

    def of_tokens(tokens):
        return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(vocab))

    def of_low(low):
        packed = F.regexp_replace(low, f"[^a-z0-9{THAI}]+", "")
        return let(name_tokens_of_low(low), of_tokens) | let(packed, lambda c: (c == "") | c.isin(vocab))
    return let(F.lower(value), of_low)


def clean_person(value: Column) -> Column:
    """Title and leading Thai words; the text itself when there are none."""
    word = f"[{THAI}]{{2,}}(?= |$)"
    head = f"(?:{R.PERSON_TITLE_TOKEN}(?= |$)|{word})"
    found = F.regexp_extract(squeeze(value), f"(?:^|(?<= )){head}(?: {word})*", 0)
    return F.coalesce(F.nullif(found, F.lit("")), strip(value))


def clean_merchant(value: Column) -> Column:
    """Latin merchant name without bank noise; NULL when fewer than two words stay."""
    bare = F.regexp_replace(sub(value, R.MERCHANT_NOISE, " ", True), r"[^A-Za-z0-9&.,'() -]+", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ \-.,]+|[ \-.,]+$", "")

    def of_bare(b):
        kept = F.array_join(F.filter(F.split(b, " "), lambda t: (F.length(t) > 1) | has(t, "[0-9]")), " ")
        return F.when(F.regexp_count(b, F.lit(r"\d")) < 8, let(kept, lambda k: F.when(
            (F.regexp_count(k, F.lit("[A-Za-z]{2,}")) >= 2) & ~is_header_name(k), k)))
    # cleaning never adds words, so a text without two Latin words is out at once
    return F.when(has(value, "[A-Za-z]{2}") & has(value, "(?s)[A-Za-z]{2}.*?[^A-Za-z][A-Za-z]{2}"), let(bare, of_bare))


def name_of_line(line: Column, token: Column | None = None) -> Column:
    """Person or merchant name found on one trimmed line, else NULL. ``token`` is the line's account token where that is known."""
    nothing = F.lit(None).cast("string")

    def titled(flat):
        reads_as_transaction = has(flat, r"\d{1,2}[:.]\d{2}|\d[\d,]*\.\d{2}|\d{6,}")
        return F.when((F.length(flat) >= 4) & ~reads_as_transaction & ~is_header_name(flat), clean_person(flat))

    def plain(found):
        return F.when((F.length(found) >= 4) & ~contains_any(found, R.NAME_NOISE) & ~is_header_name(found)
                      & ~account_like(found), clean_person(found))

    def decide(x):
        s, untitled_number = x["s"], x["digits"] & ~x["prefix"]
        own = None if token is None else F.when(_has_colon(line), account_token(s)).otherwise(token)
        return (F.when((s == "") | (untitled_number & x["thai"]), nothing)
                .when(account_like(s, own), nothing)
                .when(untitled_number, clean_merchant(s))
                .otherwise(F.coalesce(F.when(x["thai"] & x["prefix"], let(squeeze(s), titled)),
                                      let(strip(rx(s, R.THAI_NAME)), plain), clean_merchant(s))))

    def describe(s):
        return let(F.struct(s.alias("s"), contains_any(s, R.PERSON_PREFIXES).alias("prefix"), has(s, r"\d").alias("digits"),
                            has(s, f"[{THAI}]").alias("thai")), decide)
    # a trimmed line without a label needs no trimming again
    return let(F.when(_has_colon(line), strip(without_label(line))).otherwise(line), describe)


def _has_colon(line: Column) -> Column:
    return F.contains(line, F.lit(":")) | F.contains(line, F.lit("："))


def without_label(line: Column) -> Column:
    """The line behind its first colon and the blanks after it."""
    return F.when(_has_colon(line), F.regexp_replace(line, r"^[^:：]*[:：]\s*", "")).otherwise(line)


def sender_label(low: Column) -> Column:
    """Of a line in lower case."""
    return contains_any(low, R.SENDER_LABELS)


def receiver_label(low: Column) -> Column:
    """Of a line in lower case."""
    return contains_any(low, R.RECEIVER_LABELS) | (F.contains(low, F.lit("to")) & has(low, R.RECEIVER_WORD))


def is_merchant_payment(text: Column, receiver: Column) -> Column:
    name = F.coalesce(receiver, F.lit(""))
    return (contains_any(F.lower(text), R.MERCHANT_TEXT_MARKERS)
            | contains_any(F.lower(name), R.MERCHANT_NAME_MARKERS) | has(name, R.MERCHANT_LATIN))


def name_without_title(value: Column) -> Column:
    """struct(name, confidence): one leading title removed, bullets dropped."""
    titles = any_of(R.NAME_TITLES)
    bare = F.trim(value)
    titled = F.rlike(bare, F.lit(f"^(?i)(?:{titles})"))
    cut = F.trim(F.regexp_replace(F.regexp_replace(bare, f"^(?i)(?:{titles})\\s*", ""), r"^[-•*\[\]()]+", ""))
    return F.when(F.coalesce(value, F.lit("")) == "", F.struct(F.lit("").alias("name"), F.lit(0).alias("confidence"))
                  ).otherwise(F.struct(cut.alias("name"), F.when(titled, 99).otherwise(90).alias("confidence")))
