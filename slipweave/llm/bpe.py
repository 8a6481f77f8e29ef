"""Byte-level BPE encoding and decoding.

A pre-token is a doubly linked list of symbols. A priority queue holds the mergeable neighbours by merge rank, leftmost first among
equal ranks; an entry whose symbols have changed since it was queued is stale and skipped. The queues of short pre-tokens lie side by side in
one array, and all of them pop their least rank at once; a long pre-token has a heap. Decoding concatenates vocabulary strings and
maps their characters back to bytes; bytes that are no UTF-8 become replacement characters.

Special strings inside a text become their own id, as the file says. Null counts as empty: no ids. The vocabulary's path is a parameter and
each Python worker reads the file; encoded pieces are kept in a bounded cache, and Spark deals out the documents.
"""
from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from slipweave.llm.common import buffer_of, chunks, column, documents
from slipweave.llm.pieces import Encoded, cut
from slipweave.llm.registry import query


#: A rank beyond all merges, and a symbol that merges with nothing.
NONE, NOBODY = 1 << 30, (1 << 31) - 1
#: Pre-tokens of up to so many bytes are merged side by side; a longer one has a heap of its own.
SIDE_BY_SIDE = 64


def joined(parts: list[tuple]) -> tuple:
    if len(parts) == 2:
        (n, ids, decoded), (m, more, rest) = parts
        return n + m, ids + "," + more, decoded + rest
    n, ids, decoded = zip(*parts, strict=True) if parts else ((), (), ())
    return sum(n), ",".join(ids), b"".join(decoded)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.single = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.ranks = {p: r for r, p in enumerate(self.pairs.tolist())}
        self.tables = self._tables()
        back = {c: b for b, c in enumerate(letters)}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s.encode() for s, i in self.special.items()})
        self.names = {i: str(i) for i in self.strings}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.words = Encoded(self.merge_words)

    def _tables(self) -> list[tuple[np.uint64, np.ndarray]]:
        """Two hash tables from pair to rank: what finds its place taken in the first stands in the second."""
        rest, out = np.arange(len(self.pairs)), []
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
            table = np.zeros(1 << 20, dtype=np.int32)
            at = self._slot(self.pairs[rest], np.uint64(odd))
            table[at] = rest
            rest = rest[table[at] != rest]
            out.append((np.uint64(odd), table))
            if not len(rest):
                return out
        raise ValueError("the merges do not fit the tables")

    @staticmethod
    def _slot(pairs: np.ndarray, odd: np.uint64) -> np.ndarray:
        return (pairs.view(np.uint64) * odd) >> np.uint64(44)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs, NONE where they do not merge."""
        pair = a << 32 | b
        out = np.full(len(pair), NONE, dtype=np.int64)
        for odd, table in self.tables:
            rank = table[self._slot(pair, odd)].astype(np.int64)
            out = np.where(self.pairs[rank] == pair, rank, out)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token, by a heap of its own."""
        rank_of, merged = self.ranks.get, self.merged
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        # an entry is rank and position in one number
        queue = [r << 40 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of(a << 32 | b)) is not None]
        heapify(queue)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or rank_of(ids[i] << 32 | ids[j]) != entry >> 40:
                continue
            ids[i], ids[j] = new, _ = int(merged[entry >> 40]), -1
            k = after[i] = after[j]
            after[j] = n
            if k < n:
                before[k] = i
                if (r := rank_of(new << 32 | ids[k])) is not None:
                    heappush(queue, r << 40 | i)
            k = before[i]
            if k >= 0 and (r := rank_of(ids[k] << 32 | new)) is not None:
                heappush(queue, r << 40 | k)
        return [i for i in ids if i >= 0]

    def merge_side_by_side(self, words: list[bytes]) -> list[list[int]]:
        """Ids of short pre-tokens that all pop their queues at once. A queue is one slot per symbol for the merge with the next symbol:
        a merge refills or voids the slots that it makes stale, so the least slot of a word is always its next merge."""
        text = np.frombuffer(b"".join(words), np.uint8)
        n, sizes = len(text), np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        ids = np.append(self.single[text], NOBODY)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[starts] = n, n
        place = np.arange(n + 1)
        slots = self.rank_of(ids, ids[np.minimum(after, n)]) << 32 | place
        alive = np.ones(n, dtype=bool)
        while True:
            top = np.minimum.reduceat(slots[:n], starts)
            top = top[top < NONE << 32]
            if not len(top):
                break
            i = top & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            ids[i] = self.merged[top >> 32]
            alive[j] = False
            slots[j] = NONE << 32
            after[i], before[k] = k, i
            slots[i] = self.rank_of(ids[i], ids[k]) << 32 | i
            h = before[i]
            slots[h] = self.rank_of(ids[h], ids[i]) << 32 | h
        left = ids[:n][alive].tolist()
        bounds = np.concatenate(([0], np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64)))).tolist()
        return [left[a:b] for a, b in zip(bounds, bounds[1:])]

    def merge_words(self, words: list[str]) -> list[tuple]:
        """(number of ids, ids as text, decoded bytes) of pre-tokens and special strings."""
        coded, out = [w.encode() for w in words], [None] * len(words)
        for i, w in enumerate(words):
            if w in self.special:
                out[i] = self._told([self.special[w]])
        short = [i for i, w in enumerate(coded) if len(w) <= SIDE_BY_SIDE and out[i] is None]
        for lo in range(0, len(short), 1 << 14):
            part = short[lo:lo + (1 << 14)]
            for i, ids in zip(part, self.merge_side_by_side([coded[i] for i in part]), strict=True):
                out[i] = self._told(ids)
        return [self._told(self.merge(w)) if o is None else o for w, o in zip(coded, out, strict=True)]

    def _told(self, ids: list[int]) -> tuple:
        return len(ids), ",".join(map(self.names.__getitem__, ids)), self.bytes_of(ids)

    def pre_tokens(self, text: str) -> list[str]:
        """Words of the byte-level pattern, and special strings."""
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]
        if self.specials is None or "<" not in text and not self.specials.search(text):
            return self.pattern.findall(text)
        return [w for part in self.specials.split(text) if part for w in ([part] if part in self.special else self.pattern.findall(part))]

    def encode_pieces(self, pieces: list[str]) -> list[tuple]:
        """(number of ids, ids as text, decoded bytes) of pieces."""
        split = [self.pre_tokens(p) for p in pieces]
        self.words.fill(split)
        word = self.words.__getitem__
        return [word(ws[0]) if len(ws) == 1 else joined(list(map(word, ws))) for ws in split]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_pieces([text]) if ids for i in ids.split(",")]

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", errors="replace")


def _over_texts(docs: DataFrame, path: str, doc_id: str, text: str, fields: str, row_of) -> DataFrame:
    """Runs ``row_of`` over the texts in batches balanced by bytes; it gets (number of ids, ids as text, decoded bytes) of each piece of a text."""
    import pyarrow as pa

    given = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    schema = f"doc_id {dict(given.dtypes)['doc_id']}, {fields}"
    names, kinds = zip(*[f.split(" ") for f in fields.split(", ")], strict=True)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator) -> Iterator:
        gc.disable()  # nothing here forms cycles, and the cache holds millions of small objects
        known = Encoded(Codec(path).encode_pieces)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            data = data.tobytes()
            for lo, hi in chunks(offsets, 1 << 20):
                texts = [cut(data[offsets[i]:offsets[i + 1]].decode()) for i in range(lo, hi)]
                known.fill(texts)
                columns = list(zip(*[row_of(list(map(known.__getitem__, pieces))) for pieces in texts], strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(c, arrow[k]) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])
    return given.mapInArrow(run, schema)


def token_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (an array), decoded (the text of the ids): one row per row of docs."""
    def row_of(parts):
        _, ids, decoded = joined(parts)
        return np.fromstring(ids, dtype=np.int32, sep=",") if ids else [], decoded.decode("utf-8", errors="replace")
    return _over_texts(docs, path, doc_id, text, "ids array<int>, decoded string", row_of)


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the same ids and decoded texts, made where they arise."""
    def row_of(parts):
        n, ids, decoded = joined(parts)
        decoded = decoded.decode("utf-8", errors="replace").encode()
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()
    return _over_texts(docs, path, doc_id, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row_of)


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark, sf_dir):
    import public_tokenizers
    return token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
