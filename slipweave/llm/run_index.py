"""Removal of long repeated byte strings with a run-length index.

A byte goes when it is covered by a string of ``length`` bytes that starts at a second place as well.

1. Anchors. Every window of ``length`` bytes is assigned to the 48-byte gram in it with the least hash (the leftmost one of equals), so equal
   windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a segment. Only (gram hash, segment hash) of segments
   is shuffled. Segments that occur twice are repeated as a whole. Those that occur once, under a gram that occurs with other segments
   too, are open: parts of them may be repeated.
2. Pieces. Open segments and one copy of each repeated segment under their gram are cut into pieces of STEPS[0] windows, aligned at the gram,
   with a core of bytes that all windows of a piece hold. Pieces whose core is unique are dropped; equal pieces are repeated as a whole.
3. Index. The other pieces meet by core. Each task concatenates whole groups up to BLOCK_BYTES and builds a run-compressed Burrows-Wheeler
   transform with the suffix positions at the ends of its runs. The longest match of a suffix with its neighbours in suffix order is
   compared only at run ends and loses one byte per step inside a run, so matching statistics stream over the text from the
   sampled positions. Positions with statistics of ``length`` or more are marked.
4. Crowded cores, with more than CROWD pieces, are not collected in a task: their pieces are cut finer, down to single windows, an exact way by
   grouped counts alone.

Equal (gram, segment) hashes of 64 bits each count as equal strings. Null counts as empty; a text shorter than ``length`` has nothing to
remove; matches never cross documents. Rows are identified by (doc_id, hash of the text): rows that repeat both are one place each, so such a
text is removed as a whole from its first ``length`` bytes on, like any other exact copy.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from slipweave.llm.common import attach, buffer_of, chunks, column, documents, stored
from slipweave.llm.registry import query

LENGTH, GRAM = 400, 48
#: Bytes that one index is built over, and the pieces of a core that are still indexed.
BLOCK_BYTES, CROWD = 1 << 19, 512
#: Windows in the pieces that segments are cut into; all but the first for crowded cores.
STEPS = (192, 24, 3, 1)
#: Positions of a text looked at together.
REACH = 1 << 20
SEPARATOR = 0xFF


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, most significant first."""
    n = len(data) - 7
    return np.ndarray((n,), dtype=">u8", buffer=np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position on."""
    x = _loads(data)
    n = len(x) - (GRAM - 8)
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h ^= x[k:k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys, from minima of block prefixes and suffixes."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(keys.dtype).max, dtype=keys.dtype)
    padded[:n] = keys
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n - w + 1], prefix[w - 1:n])


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window, number of windows, gram hash, place of the gram in the first window) of the segments of the rows' texts, in parts."""
    n, w = len(data), length - GRAM + 1
    row_end = np.repeat(offsets[1:], np.diff(offsets)) if len(offsets) > 2 else None
    for lo in range(0, n - length + 1, REACH):
        hi = min(n, lo + REACH + length - 1)
        if hi - lo < length:
            break
        h = gram_hashes(data[lo:hi])
        place = np.arange(len(h), dtype=np.uint64)
        # 43 bits of the hash order the grams, 21 bits hold the position: ties go to the left
        at = (_least((h >> np.uint64(21) << np.uint64(21)) | place, w) & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.arange(lo, lo + len(at))
        good = start + length <= (offsets[1] if row_end is None else row_end[start])
        start, at = start[good], at[good]
        if not len(start):
            continue
        new = np.ones(len(start), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(start)))
        row = np.searchsorted(offsets, start[first], side="right") - 1
        yield row, start[first] - offsets[row], count, h[at[first]], at[first] + lo - start[first]


def segments(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, h, start, windows, lead, gram, body): the segments of texts (doc, h, text); lead is the place of the gram in the segment."""
    import pyarrow as pa
    import xxhash

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            data, offsets = buffer_of(batch.column(2))
            whole = memoryview(np.ascontiguousarray(data))
            parts = ((top, x) for top, end in chunks(offsets, REACH) for x in anchored(data[offsets[top]:offsets[end]], offsets[top:end + 1] - offsets[top], length))
            for top, (row, start, count, gram, lead) in parts:
                row = row + top
                lo = (offsets[row] + start).tolist()
                hi = (offsets[row] + start + count + length - 1).tolist()
                body = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(lo, hi, strict=True)], dtype=np.uint64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start), pa.array(count), pa.array(lead),
                                                  pa.array(gram.view(np.int64)), pa.array(body.view(np.int64))], names=["doc", "h", "start", "windows", "lead", "gram", "body"])
    return texts.mapInArrow(run, f"doc {dict(texts.dtypes)['doc']}, h bigint, start bigint, windows bigint, lead bigint, gram bigint, body bigint")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes, as far as ``depth`` bytes tell them apart."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    order = np.argsort(_loads(padded)[:n], kind="stable")
    key = _loads(padded)[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    known = 8
    # doubling works on the groups of still equal suffixes only; a rank is the place of its group's first member
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    while known < depth:
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        pos = order[open_]
        second = rank[np.minimum(pos + known, n)]
        group = head[open_]
        by = np.lexsort((second, group))
        pos, second = pos[by], second[by]
        order[open_] = pos
        split = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        new[open_] = split
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = head
        known *= 2
    return order


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text, with the suffix positions at both ends of every run."""

    def __init__(self, text: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        before = text[order - 1]
        heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        # suffixes that start their string have no byte before them: they are runs of their own
        self.text, self.depth, self.heads = text, depth, heads
        self.letters, self.first, self.last = before[heads], order[heads], order[np.append(heads[1:], len(order)) - 1]
        strings = np.flatnonzero(np.concatenate(([True], text[:-1] == SEPARATOR)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cut = np.concatenate((heads, place[strings], np.minimum(place[strings] + 1, len(order))))
        cut = np.unique(cut[(0 < cut) & (cut < len(order))])
        self.upper, self.lower = order[cut - 1], order[cut]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, exact up to ``depth`` bytes."""
        padded = np.concatenate((self.text, np.full(8, SEPARATOR, np.uint8)))
        words, n = _loads(padded), len(self.text)
        out, live, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live) and step < self.depth:
            x, y = words[np.minimum(a[live] + step, n)], words[np.minimum(b[live] + step, n)]
            same = (x == y) & (a[live] + step < n) & (b[live] + step < n)
            out[live] += np.where(same, 8, 0)
            rest = live[~same]
            if len(rest):
                d = x[~same] ^ y[~same]
                out[rest] += np.minimum(7, (63 - np.floor(np.log2(np.maximum(d, 1).astype(np.float64))).astype(np.int64)) // 8)
            live, step = live[same], step + 8
        return out

    def statistics(self) -> np.ndarray:
        """For every position a lower bound, exact up to ``depth``, of the longest match that starts there and at another position."""
        sampled = np.zeros(len(self.text), np.int64)
        match = self.common(self.upper, self.lower)
        np.maximum.at(sampled, self.lower, match + self.lower)
        np.maximum.at(sampled, self.upper, match + self.upper)
        # a match loses one byte with every step to the right, until a sampled one is longer
        return np.maximum(np.maximum.accumulate(sampled) - np.arange(len(self.text)), 0)


def marked(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes start at another place of the strings as well."""
    text = np.frombuffer(bytes([SEPARATOR]).join(bodies) + bytes([SEPARATOR]), np.uint8)
    # a match that starts k bytes before a window must be known to its full length, so depth is that of the longest string
    found = RunIndex(text, max(map(len, bodies))).statistics() >= length
    out, at = [], 0
    for b in bodies:
        out.append(found[at:at + len(b) - length + 1])
        at += len(b) + 1
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def indexed(rows: DataFrame, length: int, block: int = BLOCK_BYTES) -> DataFrame:
    """(doc, h, start, stop): bytes of rows (core, doc, h, start, bytes) that the index marks; all rows of a core are in one task."""
    import pyarrow as pa

    def solve(held: list[tuple]) -> Iterator:
        doc, h, start, stop = [], [], [], []
        for (_, d, key, s, _), flags in zip(held, marked([x[4] for x in held], length), strict=True):
            for a, b in zip(*_runs(flags), strict=True):
                doc.append(d)
                h.append(key)
                start.append(s + int(a))
                stop.append(s + int(b) + length)
        yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(h, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc", "h", "start", "stop"])

    kind = pa.int64() if dict(rows.dtypes)["doc"] == "bigint" else pa.int32() if dict(rows.dtypes)["doc"] == "int" else pa.string()

    def run(batches: Iterator) -> Iterator:
        held, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > block and row[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from solve(held)
    # one partition per block of bytes: the work is in the index, not in the bytes that adaptive execution would merge partitions by
    parts = 1 + (rows.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // block
    return (rows.select("core", "doc", "h", "start", "bytes").repartition(parts, "core").sortWithinPartitions("core")
            .mapInArrow(run, f"doc {dict(rows.dtypes)['doc']}, h bigint, start bigint, stop bigint"))


def pieces(rows: DataFrame, length: int, step: int) -> DataFrame:
    """(doc, h, start, windows, lead, gram, bytes, core, body): rows cut into pieces whose windows have the gram at the same place up to ``step``;
    core is a hash of the bytes that all windows of such a piece hold, and of its place; body one of all its bytes."""
    import pyarrow as pa
    import xxhash

    kinds = dict(rows.dtypes)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            take, out = [], []
            starts, windows, leads, grams, bodies = (batch.column(k).to_pylist() for k in range(2, 7))
            for i, (start, n, lead, gram, body) in enumerate(zip(starts, windows, leads, grams, bodies, strict=True)):
                last = lead - n + 1
                for k in range(last // step, lead // step + 1):
                    top, low = min(lead, step * k + step - 1), max(last, step * k)
                    a, m = lead - top, top - low + 1
                    part = body[a:a + m + length - 1]
                    core = body[lead - step * k:max(lead - step * k, lead - step * k - step + 1 + length)]
                    take.append(i)
                    out.append((start + a, m, top, gram, part, xxhash.xxh3_64_intdigest(core, seed=(gram + k) % (1 << 64)) - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            take = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns, types)],
                                             names=["doc", "h", "start", "windows", "lead", "gram", "bytes", "core", "body"])
    return rows.select("doc", "h", "start", "windows", "lead", "gram", "bytes").mapInArrow(
        run, f"doc {kinds['doc']}, h bigint, start bigint, windows bigint, lead bigint, gram bigint, bytes binary, core bigint, body bigint")


def _met(cut: DataFrame) -> DataFrame:
    """Pieces whose core occurs twice, with ``n``, how often, and ``mixed``, whether they differ."""
    shared = stored(cut.groupBy("core").agg(F.count("*").alias("n"), (F.min("body") != F.max("body")).alias("mixed")).filter("n > 1"))
    return stored(attach(cut, shared, ["core"], "n", cut.count()).filter("n is not null"))


def _whole(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("doc", "h", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop"))


def refined(rows: DataFrame, length: int, steps: tuple[int, ...]) -> DataFrame:
    """(doc, h, start, stop): the same for crowded cores, by ever smaller pieces; no core's rows meet in one task."""
    found = None
    for step in steps:
        met = _met(stored(pieces(rows, length, step)))
        equal, rows = _whole(met.filter("not mixed"), length), met.filter("mixed")
        found = equal if found is None else found.unionByName(equal)
    return found


def with_bytes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, doc, h, start, windows, lead, bytes) of wanted segments, which come without bytes."""
    lists = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "windows", "lead", "gram")).alias("list"))
    once = texts.alias("t").join(lists.alias("l"), F.expr("t.h = l.h and t.doc <=> l.doc")).select("t.doc", "t.h", F.encode("t.text", "utf-8").alias("text"), F.explode("l.list").alias("s"))
    return once.select("s.gram", "doc", "h", "s.start", "s.windows", "s.lead", F.substring("text", (F.col("s.start") + 1).cast("int"), (F.col("s.windows") + length - 1).cast("int")).alias("bytes"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD, block: int = BLOCK_BYTES) -> DataFrame:
    """(doc, h, spans): per text its repeated byte ranges [start, stop), which may overlap."""
    texts = docs.select(column(doc_id).alias("doc"), F.xxhash64(F.coalesce(column(text), F.lit(""))).alias("h"), F.coalesce(column(text), F.lit("")).alias("text"))
    cut = stored(segments(texts.filter(F.octet_length("text") >= length), length))
    total = cut.count()
    grams = stored(cut.groupBy("gram").agg(F.count("*").alias("n"), (F.min("body") != F.max("body")).alias("mixed")).filter("n > 1"))
    shared = stored(attach(cut, grams, ["gram"], "n", total).filter("n is not null").drop("n"))
    bodies = stored(shared.groupBy("gram", "body").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min_by(
        F.struct("doc", "h", "start", "windows", "lead"), F.xxhash64("doc", "h", "start")).alias("one")))
    # whole segments that are repeated
    many = stored(bodies.filter("n > 1").select("gram", "body", "n"))
    whole = _whole(attach(shared.drop("mixed", "lead"), many, ["gram", "body"], "n", total).filter("n is not null"), length)
    # different segments under one gram
    fetched = with_bytes(texts, bodies.filter("mixed").select("one.*", "gram"), length)
    met = _met(stored(pieces(fetched, length, STEPS[0])))
    few = F.col("n") <= crowd
    spans = whole.unionByName(_whole(met.filter("not mixed"), length)).unionByName(indexed(met.filter(F.col("mixed") & few), length, block))
    crowded = met.filter(F.col("mixed") & ~few)
    if not crowded.isEmpty():
        spans = spans.unionByName(refined(crowded, length, STEPS[1:]))
    return spans.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _joined(spans, n: int) -> tuple[np.ndarray, int]:
    """Which of n bytes the spans cover, and in how many runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    gone = np.cumsum(edge)[:n] > 0
    return gone, int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = True, crowd: int = CROWD,
                   block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, kept (the remaining bytes): one row per row of docs."""
    import pyarrow as pa

    spans = stored(repeated_spans(docs, length, doc_id, text, crowd, block))
    rows = docs.select(column(doc_id).alias("doc"), F.xxhash64(F.coalesce(column(text), F.lit(""))).alias("h"), F.coalesce(column(text), F.lit("")).alias("text"))
    met = rows.alias("r").join(spans.alias("s"), F.expr("r.h = s.h and r.doc <=> s.doc"), "left").select("r.doc", "r.text", "s.spans")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            lists = batch.column(2)
            out = []
            for i in range(len(batch)):
                body = data[offsets[i]:offsets[i + 1]]
                n, removed, runs = len(body), 0, 0
                if lists[i].is_valid:
                    flat = lists[i].values
                    gone, runs = _joined(np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1), n)
                    removed, body = int(gone.sum()), body[~gone]
                left = body.tobytes()
                out.append((n, removed, runs, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    result = met.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return result if keep_bytes else result.drop("kept")


@query("op10_run_index_dedup")
def op10_run_index_dedup(spark, sf_dir):
    """The contract's columns and ``text``, what is left of each text; characters that a removed run cuts show as U+FFFD."""
    return remove_repeats(documents(spark, sf_dir)).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
