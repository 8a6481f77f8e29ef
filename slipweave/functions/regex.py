"""Translation of rule patterns to the Java dialect Spark evaluates.

The rules were written for a dialect whose ``\\w``, ``\\b``, ``\\d`` and ``\\s`` are Unicode aware but do not
count combining marks (Thai vowels above the line, tone marks) as word characters. Java has no such
class, so the four escapes are spelled out.
"""
from __future__ import annotations

DIGIT = "0-9๐-๙"
WORD = r"A-Za-z0-9_\p{L}\p{N}"
SPACE = r"\p{IsWhite_Space}\x1C-\x1F"
THAI = "ก-๙"
# every rule puts its word boundary next to a word character, so one look-around outside is enough; the
# look-ahead makes most positions fail on a plain class test
EDGE_BEFORE = f"(?=[A-Za-z{DIGIT}])(?<![{WORD}])"
EDGE_AFTER = f"(?![{WORD}])"

_CLASSES = {"d": DIGIT, "w": WORD, "s": SPACE}


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern with its word, digit, space and boundary escapes written out."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt in _CLASSES:
                out.append(_CLASSES[nxt] if in_class else f"[{_CLASSES[nxt]}]")
            elif nxt == "b" and not in_class:
                out.append(EDGE_BEFORE if not out or out[-1] in ("(", "|", ":") else EDGE_AFTER)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def quoted(text: str) -> str:
    """A literal text as a pattern."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def any_of(words) -> str:
    """An alternation of literal words."""
    return "|".join(quoted(w) for w in words)


def prefix_tree(words, longest: bool = False) -> str:
    """A pattern of all literal words in which words with a common beginning share it, so that most places of a text fail on their first character. It matches the
    shortest word that begins at a place, with ``longest`` the longest one."""
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def write(node):
        branches = [quoted(ch) + write(child) for ch, child in node.items() if ch]
        if "" in node and not (longest and branches):
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{body}?" if "" in node else body
    # ASCII characters are one set of bits, all others one range: Java tests the single members of a larger class one by one
    far = [ch for ch in root if ch > "~"]
    first = (f"{min(far)}-{max(far)}" if far else "") + "".join(quoted(ch) for ch in root if ch and ch <= "~")
    return f"(?=[{first}]){write(root)}" if len(root) > 3 and "" not in root else write(root)


def literal_core(pattern: str) -> str:
    """The longest literal text every match of the pattern contains, '' when there is no safe one."""
    if "|" in pattern or "(" in pattern or "[" in pattern:
        return ""
    runs, i = [""], 0
    while i < len(pattern):
        ch = pattern[i]
        step = 2 if ch == "\\" else 1
        literal = pattern[i + 1] if ch == "\\" and not pattern[i + 1].isalpha() else ("" if ch in "\\.^$?*+{" else ch)
        following = pattern[i + step:i + step + 1]
        if ch == "{":
            i = pattern.index("}", i) + 1
            runs.append("")
            continue
        if literal and following not in ("?", "*", "+", "{"):
            runs[-1] += literal
        else:
            runs.append("")
        i += step
    return max(runs, key=len)
