"""Safe cuts of texts for byte-level BPE, and a bounded cache of what the pieces encode to."""
from __future__ import annotations

import re

#: Between two characters that are not blank, a single space always begins a token of the byte-level pattern, and no special
#: string holds a space: both sides encode alone as they do together. Python's blanks include all of the tokenizer's.
SAFE = re.compile(r"(?<=\S)(?= \S)")
BLANKS = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Characters in the pieces of one generation of a cache.
CACHE_CHARS = 3 << 20


def cut(text: str) -> list[str]:
    """The text in pieces that encode independently; their concatenation is the text."""
    if not text:
        return []
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or BLANKS.search(text):
        return SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


class Encoded(dict):
    """What pieces encode to; the unknown pieces of a batch of texts are encoded together. When a generation of pieces has filled its
    room, those that were not used since are forgotten."""

    def __init__(self, encode, chars: int = CACHE_CHARS):
        super().__init__()
        self.encode, self.room, self.chars, self.older = encode, chars, chars, {}

    def fill(self, texts: list[list[str]]) -> None:
        if self.room < 0:
            self.older = dict(self)
            self.clear()
            self.room = self.chars
        wanted, older = set().union(*texts), self.older
        missing = [p for p in wanted if p not in self]
        new = [p for p in missing if p not in older]
        if len(new) < len(missing):
            self.update((p, older[p]) for p in missing if p in older)
        self.update(zip(new, self.encode(new), strict=True))
        self.room -= sum(map(len, missing))
