"""Column helpers for text, money and ordered lookups. All are plain Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from slipweave.functions.regex import SPACE, literal_core, prefix_tree, to_java

_LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"

_BREAKS = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029"

_BLANKS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                  0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def rx(col, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """First match of a rule pattern, NULL (not '') when there is none."""
    return let(F.regexp_extract(col, to_java(pattern, ignore_case), group), lambda found: F.when(found != "", found))


def rx_all(col, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(col, F.lit(to_java(pattern, ignore_case)), F.lit(group))


def _found(col, java: str) -> Column:
    """As RLIKE, which decodes its pattern for every row where it stands inside of a lambda."""
    return F.regexp_instr(col, F.lit(java)) > 0


def has(col, pattern: str, ignore_case: bool = False) -> Column:
    """Pattern test; a literal every match must contain is tested first, it is much cheaper."""
    test = _found(col, to_java(pattern, ignore_case))
    core = literal_core(pattern)
    return F.contains(col, F.lit(core)) & test if core and not (ignore_case and core.lower() != core.upper()) else test


def sub(col, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(col, to_java(pattern, ignore_case), replacement)


def strip(col) -> Column:
    return F.trim(col, F.lit(_BLANKS))


def squeeze(col) -> Column:
    """Whitespace runs become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, f"[{SPACE}]+", " "))


def contains_any(col, words) -> Column:
    """Whether one of the literal words occurs; one pass over the text, which is computed once."""
    return _found(col, prefix_tree(words))


def occurring(col, words) -> Column:
    """The longest word that begins at each place of the text, as one short text: it contains exactly those of the words that the text contains."""
    return F.array_join(F.regexp_extract_all(col, F.lit(f"(?=({prefix_tree(words, longest=True)}))"), F.lit(1)), "\n")


#: Texts of nothing but printable ASCII, Thai and line feeds: their only blank is the space. Runs of one class each are read greedily, with one start.
_COMMON = r"\A(?:[\n -~]*+[ก-๙]*+)*+\z"


def lines(col) -> Column:
    """Trimmed, non-empty lines in order: from a character that is no blank to the last such one before the line ends.

    Texts of common characters alone need two classes of two characters; the classes of all blanks, which Java tests one by one, are for the others.
    """
    solid, inner = f"[!-~ก-๙[^{_BLANKS}]]", f"[ -~ก-๙[^{_BREAKS}]]"
    every = F.regexp_extract_all(col, F.lit(f"{solid}(?:{inner}*{solid})?"), F.lit(0))
    return F.when(_found(col, _COMMON), F.regexp_extract_all(col, F.lit(r"[^ \n](?:[^\n]*[^ \n])?"), F.lit(0))).otherwise(every)


def raw_lines(col) -> Column:
    return F.split(col, _LINE_BREAK)


def let(value, fn) -> Column:
    """``fn(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def first_of(array) -> Column:
    """First non-null element, NULL when there is none."""
    return F.get(F.filter(array, lambda x: x.isNotNull()), F.lit(0))


def first_where(array, cond) -> Column:
    return F.get(F.filter(array, cond), F.lit(0))


def ascii_digits(col) -> Column:
    return F.translate(col, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def to_int(col) -> Column:
    return ascii_digits(col).try_cast("int")


def normalize_text(col) -> Column:
    """NULL becomes '', zero-width spaces go, whitespace is squeezed."""
    return squeeze(F.replace(F.coalesce(col, F.lit("")), F.lit("​"), F.lit("")))


def normalize_for_match(col) -> Column:
    return F.lower(normalize_text(col))


def two_decimals(value) -> Column:
    """A DOUBLE with two decimals: its exact binary value is rounded, exact halves to the even digit.

    The fraction is taken in steps of 2**-55, or of 2**-59 below 1/8, whose hundredfold fits a BIGINT; what is below a step counts too.
    """
    def finish(whole, scale, steps, down):
        below = (steps - down) * 100

        def rounded(hundred):
            def up(rest, cents):
                half = F.shiftright(scale, 1)
                tie = (rest == half) & ((below > F.floor(below)) | (F.pmod(cents, F.lit(2)) == 1))
                return cents + ((rest > half) | tie).cast("int")
            return let(F.pmod(hundred, scale), lambda rest: let(whole * 100 + ((hundred - rest) / scale).cast("bigint"), lambda cents: up(rest, cents)))
        return let(down * 100 + F.floor(below), rounded)

    def cents_of(size):
        small = size < 0.125
        bits, scale = F.when(small, F.lit(59)).otherwise(F.lit(55)), F.when(small, F.lit(1 << 59)).otherwise(F.lit(1 << 55)).cast("bigint")
        return let(F.floor(size), lambda whole: let((size - whole) * F.pow(F.lit(2.0), bits), lambda steps: let(F.floor(steps), lambda down: finish(whole, scale, steps, down))))

    def shown(cents):
        return F.concat(((cents - F.pmod(cents, F.lit(100))) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    sign = F.when(value < 0, "-").otherwise("")
    return let(F.abs(value), lambda size: F.when(size < 1e13, F.concat(sign, let(cents_of(size), shown))).when(F.isnan(size), "nan")
               .when(size == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.format_string("%.2f", value)))


def normalize_amount(col) -> Column:
    """Two decimals as text, '' when it is not a number."""
    value = col.try_cast("double")
    return F.when(value.isNotNull(), two_decimals(value)).otherwise(F.lit(""))


def date_only(col) -> Column:
    return F.split_part(normalize_text(col), F.lit("T"), F.lit(1))


def money_text(col, currency: str = "THB") -> Column:
    return F.coalesce(F.concat(F.format_number(col, 2), F.lit(f" {currency}")), F.lit("-"))


def satang(col) -> Column:
    """Baht amount as integer satang; every sum in the library runs on this."""
    return F.round(col * 100).cast("bigint")


def baht(col) -> Column:
    return col.cast("double") / F.lit(100.0)


def first_present(*cols) -> Column:
    """First value that is not blank, '-' when all are."""
    return F.coalesce(*[F.when(strip(c.cast("string")) != "", c.cast("string")) for c in cols], F.lit("-"))


def clock_part(col) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col, r"\b\d{1,2}:\d{2}(?::\d{2})?\b", 0), F.lit("")), F.lit("-"))


def calendar_part(col) -> Column:
    clock = clock_part(col)
    rest = F.trim(F.regexp_replace(F.replace(col, clock, F.lit("")), r"\s*/\s*", " "))
    return F.when((col == "-") | (clock == "-"), col).otherwise(F.coalesce(F.nullif(rest, F.lit("")), col))


def combine_datetime(date_col, time_col) -> Column:
    day = F.coalesce(date_col, F.lit("UNKNOWN"))
    known = (day != "UNKNOWN") & (F.coalesce(time_col, F.lit("")) != "")
    return F.when(known, F.concat(F.split_part(day, F.lit("T"), F.lit(1)), F.lit("  /  "), time_col)).otherwise(day)


def first_number(col) -> Column:
    """First signed number of a text, 0 when there is none."""
    found = F.regexp_extract(F.replace(col, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))


def archive_name(col) -> Column:
    return F.regexp_replace(F.trim(col), r"\s+", "_")
