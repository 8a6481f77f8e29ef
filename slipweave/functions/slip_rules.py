"""The rules of a slip over one text, in Python: what the column expressions of ``fields`` and ``slips`` say, for the job that needs all fields of a slip.

A row that passes through some hundred nested column functions costs more in these functions than in its patterns. Here a word that no line can contain is looked for once in the text, and
what a line holds is worked out when a rule first asks for it. Case is ignored as the rules' own dialect does, so that the Kelvin sign counts as a k and the long s as an s.
"""
from __future__ import annotations

import re
from datetime import date

from slipweave import rules as R
from slipweave.functions.fields import ACCOUNT_RUN, month_scan, noise_vocabulary
from slipweave.functions.regex import DIGIT, THAI, any_of, literal_core

_THAI_DIGITS = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")


def rule(pattern: str, ignore_case: bool = False) -> re.Pattern:
    """A rule pattern as it is, but for digits: those of the rules are ASCII and Thai ones."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append((DIGIT if in_class else f"[{DIGIT}]") if pattern[i + 1] == "d" else pattern[i:i + 2])
            i += 2
            continue
        in_class = ch == "[" or in_class and ch != "]"
        out.append(ch)
        i += 1
    return re.compile("".join(out), re.IGNORECASE if ignore_case else 0)


_DIGIT = re.compile(f"[{DIGIT}]")
_THAI = re.compile(f"[{THAI}]")


def _present(words, text: str) -> list[str]:
    return [w for w in words if w in text]


def _any(words: list[str], text: str) -> bool:
    for w in words:
        if w in text:
            return True
    return False


def _group(pattern: re.Pattern, text: str, group: int = 1) -> str | None:
    """The group of the first match; None where it is empty."""
    m = pattern.search(text)
    return m.group(group) or None if m else None


# ---- banks ------------------------------------------------------------------------------------

#: Per bank its code, (core, pattern where the core alone is not enough, weight) of each pattern, and the account pattern.
_BANKS = [(code, [(literal_core(p), None if literal_core(p) == p else rule(p), max(len(p), 5)) for p in patterns], rule(account) if account else None)
          for code, patterns, account in R.BANK_PATTERNS]
#: Account patterns are made of digits and dashes, so they are looked for in such runs only.
_ACCOUNT_RUN = rule(ACCOUNT_RUN)


def bank(text: str, low: str) -> tuple[str, float]:
    """Code and confidence of the best scored bank, the earlier rule on ties."""
    best, best_code, total, runs = 0, "UNKNOWN", 0, "\n".join(_ACCOUNT_RUN.findall(text))
    for code, patterns, account in _BANKS:
        hits = weight = 0
        for core, pattern, w in patterns:
            if core in low and (pattern is None or pattern.search(low)):
                hits += 1
                weight += w
        score = weight * (13 if hits >= 2 else 10) + (100 if account and runs and account.search(runs) else 0)
        total += score
        if score > best:
            best, best_code = score, code
    return best_code, best / total if total else 0.0


# ---- amounts ----------------------------------------------------------------------------------

_LABELLED, _DECIMAL, _SKIP_LINE = rule(R.AMOUNT_LABELLED, True), rule(R.AMOUNT_DECIMAL), rule(R.AMOUNT_SKIP_LINE, True)
_AMOUNTS = [rule(p, True) for p in R.AMOUNT_PATTERNS]
_TWO_DECIMALS = rule(r"[\d,]+\.\d{2}")


def amount_value(token: str | None) -> float | None:
    if not token:
        return None
    plain = token.replace(",", "").translate(_THAI_DIGITS)
    if len(plain.partition(".")[0]) > 9:
        return None
    try:
        value = float(plain)
    except ValueError:
        return None
    return value if 0 < value <= R.AMOUNT_MAX else None


def amount(text: str, lines: list[str]) -> float | None:
    for line in lines:
        if _DIGIT.search(line) and not _SKIP_LINE.search(line):
            value = amount_value(_group(_LABELLED, line))
            if value is None:
                value = amount_value(_group(_DECIMAL, line))
            if value is not None:
                return value
    for pattern in _AMOUNTS:
        for m in pattern.finditer(text):
            value = amount_value(m.group(1))
            if value is not None:
                return value
    found = [v for v in map(amount_value, _TWO_DECIMALS.findall(text)) if v is not None and not 2000 <= v <= 2100]
    return max(found, default=None)


# ---- dates and times --------------------------------------------------------------------------

_LONG, _SHORT = rule(R.NUMERIC_DATE_LONG), rule(R.NUMERIC_DATE_SHORT)
_COMPACT, _COMPACT_LINE, _COMPACT_SHORT = rule(R.COMPACT_DATE), rule(R.COMPACT_DATE_LINE, True), rule(R.COMPACT_SHORT_DATE)
_MONTHS = {name: (rank, number) for rank, (name, number) in enumerate(month_scan())}
_NAMES = any_of(_MONTHS)
# the text is read once: a look-ahead takes the whole date, what follows consumes day and month only
_NAMED_MONTH = rule(rf"(?=(\d{{1,2}})\s*({_NAMES})\s*(\d{{2,4}}))\d{{1,2}}\s*(?:{_NAMES})(?=\s*\d{{2,4}})")
_TIMES = [rule(p) for p in R.TIME_PATTERNS]


def _date(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _common_era(year: int) -> int:
    return year - R.BUDDHIST_OFFSET if year > 2100 else year


def _named_month_date(text: str) -> date | None:
    """Longer month names count before others; per name only its first place in the text."""
    if not _present(_MONTHS, text):
        return None
    found: dict[int, date | None] = {}
    for m in _NAMED_MONTH.finditer(text):
        rank, number = _MONTHS[m.group(2)]
        if rank not in found:
            year = int(m.group(3))
            found[rank] = _date(_common_era(year + 2500 if year < 100 else year), number, int(m.group(1)))
    return next((found[rank] for rank in sorted(found) if found[rank]), None)


def transaction_date(text: str, lines: list[str]) -> date | None:
    m = _LONG.search(text)
    found = m and _date(_common_era(int(m.group(3))), int(m.group(2)), int(m.group(1)))
    if not found and (m := _SHORT.search(text)):
        year = int(m.group(3))
        found = _date(year + (2000 if year < 70 else 1900), int(m.group(2)), int(m.group(1)))
    found = found or _named_month_date(text)
    if found:
        return found
    for m in _COMPACT.finditer(text):
        found = _date(int(m.group(1)), int(m.group(2)), int(m.group(3)))
        if found:
            return found
    for line in lines:
        if _COMPACT_LINE.search(line) and (m := _COMPACT_SHORT.search(line)):
            found = _date(2000 + int(m.group(1)), int(m.group(2)), int(m.group(3)))
            if found:
                return found
    return None


def transaction_time(text: str) -> str | None:
    for pattern in _TIMES:
        m = pattern.search(text)
        if m:
            return f"{m.group(1).rjust(2, '0')}:{m.group(2)}"
    return None


# ---- references, memo -------------------------------------------------------------------------

_REFERENCES = [rule(p, True) for p in R.REFERENCE_PATTERNS]
_MEMO = re.compile(f"(?:{any_of(R.MEMO_LABELS)})[: \\t\\x0B\\f\\x1C-\\x1F\\x85\\xA0]*([^\\n].*)", re.IGNORECASE)
_OTHER_FIELD = [*_REFERENCES, *_AMOUNTS, *map(rule, [R.NUMERIC_DATE_LONG, R.NUMERIC_DATE_SHORT, R.THAI_DATE_LOOSE]), *_TIMES]


def reference(text: str) -> str | None:
    for pattern in _REFERENCES:
        found = _group(pattern, text)
        if found:
            return found.strip()
    return None


def memo(text: str, low: str) -> str | None:
    labels = _present(R.MEMO_LABELS, low)
    if not labels:
        return None
    raw = text.splitlines()
    for i, line in enumerate(raw):
        if _any(labels, line.lower()):
            found = (_group(_MEMO, line) or "").strip() or (raw[i + 1].strip() if i + 1 < len(raw) else "")
            if found and not any(p.search(found) for p in _OTHER_FIELD):
                return found
    return None


# ---- accounts and names -----------------------------------------------------------------------

# every account begins with three of its characters, perhaps behind a word
_ACCOUNT_HEAD, _ACCOUNT = rule(r"[xX\d][xX\d]{2}"), rule(R.ACCOUNT_PATTERN)
_TOKEN_REST, _LINE_REST = re.compile("[^A-Za-z0-9xX-]+"), re.compile(f"[^A-Za-z0-9{THAI}xX\\.-]+")
_VOCABULARY = frozenset(noise_vocabulary())
_WORDS, _UNPACKED = re.compile(f"[A-Za-z]{{2,}}|[{THAI}]{{2,}}"), re.compile(f"[^a-z0-9{THAI}]+")
_WORD = f"[{THAI}]{{2,}}(?= |$)"
_PERSON = re.compile(f"(?:^|(?<= ))(?:{R.PERSON_TITLE_TOKEN}(?= |$)|{_WORD})(?: {_WORD})*")
_LATIN_PAIR = re.compile("[A-Za-z]{2}.*?[^A-Za-z][A-Za-z]{2}", re.DOTALL)
_MERCHANT_NOISE, _NOT_MERCHANT = rule(R.MERCHANT_NOISE, True), re.compile("[^A-Za-z0-9&.,'() -]+")
_LATIN_WORD, _ASCII_DIGIT = re.compile("[A-Za-z]{2,}"), re.compile("[0-9]")
_BLANKS = re.compile(" +")
_TRANSACTION = rule(r"\d{1,2}[:.]\d{2}|\d[\d,]*\.\d{2}|\d{6,}")
_THAI_NAME = rule(R.THAI_NAME)
_LABEL = re.compile("^[^:：]*[:：]")
_TO, _MERCHANT_LATIN = rule(R.RECEIVER_WORD), rule(R.MERCHANT_LATIN)


def account_token(line: str) -> str | None:
    return _group(_ACCOUNT, line, 0) if _ACCOUNT_HEAD.search(line) else None


def account_like(value: str, token: str | None) -> bool:
    """The account token makes up most of the line, or all of it but blanks."""
    if token is None:
        return False
    if len(token) == len(value):
        return True
    n = len(_LINE_REST.sub("", value))
    return n > 0 and len(_TOKEN_REST.sub("", token)) >= R.ACCOUNT_SHARE * n or token.strip() == value.strip()


def is_header_name(value: str) -> bool:
    """Nothing but bank or header words."""
    low = value.lower()
    words = _WORDS.findall(low)
    if words and _VOCABULARY.issuperset(words):
        return True
    packed = _UNPACKED.sub("", low)
    return not packed or packed in _VOCABULARY


def clean_person(value: str) -> str:
    return _group(_PERSON, " ".join(value.split()), 0) or value.strip()


def clean_merchant(value: str) -> str | None:
    if not _LATIN_PAIR.search(value):
        return None
    bare = _BLANKS.sub(" ", _NOT_MERCHANT.sub(" ", _MERCHANT_NOISE.sub(" ", value))).strip(" -.,")
    if len(_ASCII_DIGIT.findall(bare)) >= 8:
        return None
    kept = " ".join([t for t in bare.split(" ") if len(t) > 1 or _ASCII_DIGIT.search(t)])
    return kept if len(_LATIN_WORD.findall(kept)) >= 2 and not is_header_name(kept) else None


class Slip:
    """The lines of a text; names, accounts and labels of a line are found when they are first asked for."""

    __slots__ = ("text", "low", "lines", "count", "_prefixes", "_noise", "_names", "_accounts", "_tokens", "sends", "receives")

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        self.lines = [line for line in map(str.strip, text.splitlines()) if line]
        self.count = len(self.lines)
        self._prefixes, self._noise = _present(R.PERSON_PREFIXES, text), _present(R.NAME_NOISE, text)
        self._names, self._tokens = {}, {}
        sender, receiver, to = _present(R.SENDER_LABELS, self.low), _present(R.RECEIVER_LABELS, self.low), "to" in self.low
        lows = [line.lower() for line in self.lines] if sender or receiver or to else []
        self.sends = {i for i, low in enumerate(lows) if _any(sender, low)}
        self.receives = {i for i, low in enumerate(lows) if _any(receiver, low) or to and "to" in low and _TO.search(low)}

    def token(self, i: int) -> str | None:
        try:
            return self._tokens[i]
        except KeyError:
            found = self._tokens[i] = account_token(self.lines[i]) if i < self.count else None
            return found

    def account(self, i: int) -> str | None:
        token = self.token(i)
        return token and token.strip()

    def account_below(self, i: int) -> str | None:
        return self.account(i + 1) or self.account(i + 2)

    def name(self, i: int) -> str | None:
        try:
            return self._names[i]
        except KeyError:
            found = self._names[i] = self._name(i) if i < self.count else None
            return found

    def _name(self, i: int) -> str | None:
        """Person or merchant name found on a line."""
        s, colon = self.lines[i], False
        if ":" in s or "：" in s:
            s, colon = _LABEL.sub("", s).strip(), True
        if not s:
            return None
        prefix, thai = _any(self._prefixes, s), _THAI.search(s)
        untitled_number = not prefix and _DIGIT.search(s)
        if untitled_number and thai or account_like(s, account_token(s) if colon else self.token(i)):
            return None
        if untitled_number:
            return clean_merchant(s)
        if thai and prefix:
            flat = " ".join(s.split())
            if len(flat) >= 4 and not _TRANSACTION.search(flat) and not is_header_name(flat):
                return clean_person(flat)
        found = _group(_THAI_NAME, s, 0)
        if found:
            found = found.strip()
            if len(found) >= 4 and not _any(self._noise, found) and not is_header_name(found) and not account_like(found, account_token(found)):
                return clean_person(found)
        return clean_merchant(s)


def parties(slip: Slip) -> tuple[str | None, str | None, str | None, str | None]:
    """Sender and receiver name and account: the five rule stages each pick the first line that qualifies."""
    name, acc, below, every = slip.name, slip.account, slip.account_below, range(slip.count)
    sends, receives = slip.sends, slip.receives

    def first(values):
        return next((v for v in values if v is not None), None)

    def labelled(flags, value):
        return first(value(i) or value(i + 1) for i in every if i in flags)
    sender, sender_acc = labelled(sends, name), labelled(sends, acc)
    receiver, receiver_acc = labelled(receives, name), labelled(receives, acc)

    # sender by position: first unlabelled name with an account on it or on the two lines below
    if sender is None or sender_acc is None:
        q = first(i for i in every if i not in receives and (acc(i) or below(i)) is not None and name(i) is not None)
        if q is not None:
            sender, sender_acc = sender or name(q), sender_acc or acc(q) or below(q)

    # receiver below the first receiver cue
    if (receiver is None or receiver_acc is None) and receives:
        section = [i for i in range(min(receives) + 1, slip.count) if i not in receives and slip.lines[i] not in R.SEPARATOR_LINES]
        k = first(i for i in section if name(i) is not None) if receiver is None else None
        if k is not None:
            receiver = name(k)
        receiver_acc = receiver_acc or first(acc(i) or acc(i + 1) for i in section if i != k)

    # receiver by name and account together, not the sender's
    if receiver is None or receiver_acc is None:
        late = first(i for i in every if i in receives and (acc(i) is None or name(i) is None))

        def together(i):
            if acc(i) is not None and name(i) is not None:
                return i not in sends and acc(i) != sender_acc
            return late is not None and i > late and i not in receives and below(i) is not None and below(i) != sender_acc and name(i) is not None
        q = first(i for i in every if together(i))
        if q is not None:
            receiver, receiver_acc = receiver or name(q), receiver_acc or acc(q) or below(q)

    # first name with an account below the sender's account
    if receiver is None or receiver_acc is None:
        start = 0 if sender_acc is None else first(i + 1 for i in every if sender_acc in slip.lines[i]) or 0
        q = first(i for i in range(start, slip.count) if (acc(i) or below(i)) not in (None, sender_acc) and name(i) is not None)
        if q is not None:
            receiver, receiver_acc = receiver or name(q), receiver_acc or acc(q) or below(q)
    return sender, sender_acc, receiver, receiver_acc


def receiver_bank(slip: Slip) -> str | None:
    """Bank of the first six lines of the receiver section, else of four lines from the second account."""
    if slip.receives:
        cue = min(slip.receives)
        part = slip.lines[cue:cue + 6]
    else:
        accounts = [i for i in range(slip.count) if slip.token(i) is not None]
        part = slip.lines[accounts[1]:accounts[1] + 4] if len(accounts) > 1 else []
    text = "\n".join(part)
    code = bank(text, text.lower())[0] if part else "UNKNOWN"
    return None if code == "UNKNOWN" else code


def is_merchant_payment(low: str, receiver: str | None) -> bool:
    name = receiver or ""
    return _any(R.MERCHANT_TEXT_MARKERS, low) or _any(R.MERCHANT_NAME_MARKERS, name.lower()) or _MERCHANT_LATIN.search(name) is not None


#: The columns of a parsed slip, in the order of ``parse``, with their types.
COLUMNS = {"bank_code": "string", "bank_confidence": "double", "amount": "double", "transaction_date": "date", "transaction_time": "string", "transaction_id": "string", "memo": "string",
           "sender_name": "string", "sender_account": "string", "receiver_name": "string", "receiver_account": "string", "receiver_bank_code": "string", "currency": "string",
           "sender_bank": "string", "success": "boolean", "error": "string"}


def parse(text: str | None) -> tuple:
    """The fields of one text. A text without lines is a failed slip, never an exception."""
    slip = Slip(text or "")
    text, low = slip.text, slip.low
    code, confidence = bank(text, low)
    sender, sender_acc, receiver, receiver_acc = parties(slip)
    other = receiver_bank(slip)
    if other is not None and other == code and is_merchant_payment(low, receiver):
        other = None
    return (code, confidence, amount(text, slip.lines), transaction_date(text, slip.lines), transaction_time(text), reference(text), memo(text, low),
            sender, sender_acc, receiver, receiver_acc, other, "THB", None, slip.count > 0, None if slip.count else "EMPTY_TEXT")


# ---- the labelled variant ---------------------------------------------------------------------

_KEYWORDS = sorted(((word.lower(), code) for word, code in R.BANK_KEYWORDS), key=lambda k: -len(k[0]))
_NEAR_NUMBER = rule(r"[\d,]+\.?\d{0,2}")
_LOOSE = rule(R.THAI_DATE_LOOSE)
_REFERENCES_SHORT = [rule(p, True) for p in R.REFERENCE_PATTERNS_SHORT]
_MASK, _MASKED, _BLANK, _PLAIN = rule(r"[\*xX]"), rule(R.LABELLED_MASKED), rule(r"\s"), rule(R.LABELLED_NAME)


def amount_near_label(lines: list[str], low: str) -> float:
    """Highest (label priority, value) over every number of every line, 0.0 when there is none."""
    labels, best = _present(R.AMOUNT_LABELS_NEAR, low), (0, 0.0)
    for line in lines:
        numbers = _NEAR_NUMBER.findall(line)
        if numbers:
            priority = 10 if labels and _any(labels, line.lower()) else 1
            for token in numbers:
                plain = token.replace(",", "").translate(_THAI_DIGITS)
                value = float(plain) if plain and plain != "." else 0.0
                if value > 0 and not 2000 <= value <= 2100:
                    best = max(best, (priority, value))
    return best[1]


def date_text(text: str) -> str | None:
    """The date as dd/mm/yyyy or 'dd month yyyy' text."""
    for pattern in (_LONG, _SHORT):
        if m := pattern.search(text):
            day, month, year = map(int, m.groups())
            year = _common_era(year) if pattern is _LONG else year + (2000 if year < 70 else 1900)
            return f"{day:02d}/{month:02d}/{year}"
    if m := _LOOSE.search(text):
        return f"{int(m.group(1)):02d} {m.group(2).strip()} {_common_era(int(m.group(3)))}"
    return None


def _labelled_name(line: str) -> str | None:
    s = _LABEL.sub("", line).strip()
    found = (_MASK.search(s) and _group(_MASKED, s, 0)) or (_BLANK.search(s) and _group(_PLAIN, s, 0))
    found = found and found.strip()
    return found if found and len(found) >= 2 and not _any(R.LABELLED_NOISE, found) else None


def labelled_party(lines: list[str], low: str, words: list[str]) -> str | None:
    """The first name of a labelled line or the one below it, masked names first."""
    labels = _present(words, low)
    for i, line in enumerate(lines if labels else []):
        if _any(labels, line.lower()):
            found = _labelled_name(line) or (_labelled_name(lines[i + 1]) if i + 1 < len(lines) else None)
            if found:
                return found
    return None


#: The columns of ``labelled``, with their types.
LABELLED_COLUMNS = {"bank": "string", "amount": "double", "date": "string", "sender": "string", "receiver": "string", "reference": "string"}


def labelled(text: str | None) -> tuple:
    """The six fields of the labelled variant: 'Unknown' or 0.0 where they are not found."""
    text = text or ""
    low = text.lower()
    lines = [line for line in map(str.strip, text.splitlines()) if line]
    code = next((code for word, code in _KEYWORDS if word in low), None)
    ref = next((found.strip() for found in (_group(p, text) for p in _REFERENCES_SHORT) if found), None)
    sender, receiver = labelled_party(lines, low, R.LABELLED_SENDER), labelled_party(lines, low, R.LABELLED_RECEIVER)
    return (code or "Unknown", amount_near_label(lines, low), date_text(text) or "Unknown", sender or "Unknown", receiver or "Unknown", ref or "Unknown")
