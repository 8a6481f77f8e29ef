"""Operators on small fixtures: golden cases, brute force, skew and block boundaries."""
import json
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from slipweave.functions import fields as X
from slipweave.functions import text as T
from slipweave.operators import banks, documents, files, layout, match, ordered, payments, series, slips
from slipweave.sources import scan


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("cell, shown, at_least", [
    ("ธนาคารกสิกรไทย", "KBANK (ธนาคารกสิกรไทย)", 95), ("ธนาคารกสีกรไทบ", "KBANK (ธนาคารกสิกรไทย)", 60),
    ("ธนาคารไทยเครดิต", "TCB (ธนาคารไทยเครดิตเพื่อรายย่อย)", 80), ("SCB", "SCB (ธนาคารไทยพาณิชย์)", 100),
    ("ธนาคารไม่รู้จัก", "ธนาคารไม่รู้จัก", 0)])
def test_bank_verification(spark, cell, shown, at_least):
    row = banks.verify_banks(spark.createDataFrame([(cell,)], "v string"), "v").first()
    assert row.bank_display == shown and row.bank_confidence >= at_least


@pytest.mark.parametrize("cell, amount, at_least", [(" 1,234.50บาท ", "1,234.50 THB", 90), ("฿12 345", "12345 THB", 60), ("no amount", "0.00 THB", 0)])
def test_amount_display(spark, cell, amount, at_least):
    got = one(spark, cell, X.amount_display)
    assert got.amount == amount and got.confidence >= at_least


@pytest.mark.parametrize("cell, want, at_least", [("14 Oct 66 09:30", "14 ต.ค. 2566 09:30", 80), ("15 ม.ค. 2567 11:00", "15 ม.ค. 2567 11:00", 80),
                                                  ("2023-08-10", "2566-08-10", 99), ("14 Oct 66   09:30", "14 ต.ค. 2566   09:30", 80)])
def test_date_to_buddhist(spark, cell, want, at_least):
    got = one(spark, cell, X.date_to_buddhist)
    assert got.normalized == want and got.confidence >= at_least


@pytest.mark.parametrize("cell, want, confidence", [("นาย สมชาย ใจดี มาก", "สมชาย ใจดี มาก", 99), ("ด.ญ. มานะ รักเรียน", "มานะ รักเรียน", 99),
                                                    ("Mr. John Doe", "John Doe", 99), ("สมชาย ใจดี", "สมชาย ใจดี", 90)])
def test_name_without_title(spark, cell, want, confidence):
    assert tuple(one(spark, cell, X.name_without_title)) == (want, confidence)


def test_labelled_slip(spark):
    text = "ธนาคารกรุงไทย\nโอนเงินสำเร็จ\nวันที่ 15/05/2567 เวลา 14:32\nผู้โอน: นายสมชาย ใจดี\nผู้รับ: นางสาวมณี ดีมาก\nจำนวนเงิน 4,500.00 บาท\nเลขอ้างอิง N0067719\n"
    df = slips.with_lines(spark.createDataFrame([(text,)], "raw_text string"))
    r = df.select(slips.labelled_parties(F.col("lines")).alias("p"), X.date_text(F.col("raw_text")).alias("d"), X.time_text(F.col("raw_text")).alias("t"),
                  X.amount_near_label(F.col("lines")).alias("a"), X.bank_longest_keyword(F.col("raw_text")).alias("b")).first()
    assert (r.p.sender, r.p.receiver, r.d, r.t, r.a, r.b) == ("นายสมชาย ใจดี", "นางสาวมณี ดีมาก", "15/05/2024", "14:32", 4500.0, "KTB")


def test_prefix_parties_last_label_wins(spark):
    df = spark.createDataFrame([(["จาก: นาย ก้อง ดี", "123-4-56789-0", "จาก นาย แดง ใจ", "เข้าบัญชี", "น.ส. ฟ้า ใส"],), (["นาย ดำ มืด", "นาง ขาว ใส"],)], "lines array<string>")
    got = [tuple(r.p) for r in df.select(slips.prefix_parties(F.col("lines")).alias("p")).collect()]
    assert got == [("นาย แดง ใจ", "นส ฟ้า ใส"), ("ดำ มืด", "ขาว ใส")]


def test_fingerprint_bytes(spark):
    row = dict(transaction_date="2025-05-15", transaction_time="16:00", amount=100.0, sender_bank=None, sender_name='ก "ข"', receiver_bank="x", receiver_name="ค  ง",
               transaction_id="T1")
    df = spark.createDataFrame([tuple(row.values())], "transaction_date string, transaction_time string, amount double, sender_bank string, sender_name string, "
                                                      "receiver_bank string, receiver_name string, transaction_id string")
    want = {**row, "amount": "100.00", "sender_bank": "", "receiver_name": "ค ง"}
    canon = json.dumps(want, ensure_ascii=False, sort_keys=True)
    assert match.with_fingerprint(df).first().fingerprint == hashlib.sha256(canon.encode()).hexdigest()


def slip_row(i, fp, review=None, amount=100.0, matched=True):
    return (i, f"{'abc'[i % 3]}{i}.jpg", True, matched, fp, amount, review, None)


SLIPS = "index long, file_name string, is_slip boolean, target_matched boolean, fingerprint string, amount double, review_reason string, error string"


@pytest.mark.parametrize("hot", [512, 1])
def test_duplicates_and_summary(spark, hot):
    rows = [slip_row(0, "f"), slip_row(1, "f"), slip_row(2, None, amount=900.0), slip_row(3, "f"), slip_row(4, "g", matched=False)]
    done = match.flag_duplicates(spark.createDataFrame(rows, SLIPS), hot=hot)
    got = {r["index"]: (r.duplicate, r.duplicate_of, r.review_reason) for r in done.collect()}
    assert got == {0: (False, None, None), 1: (True, "a0.jpg", None), 2: (False, None, "INCOMPLETE_DEDUP_FIELDS"), 3: (True, "a0.jpg", None), 4: (False, None, None)}
    s = match.lawyer_summary(done).first()
    assert (s.target_matched, s.unique_matched, s.duplicates_excluded, s.review_required, s.total_amount) == (4, 1, 2, 1, 100.0)


@pytest.mark.parametrize("widths", [match.GRAM_WIDTHS, (3, 1)])
def test_target_pairs_equal_substring_test(spark, widths):
    rng = random.Random(3)
    names = ["".join(rng.choice("กขคง ") for _ in range(rng.randint(2, 6))).strip() or "ก" for _ in range(20)]
    texts = [(i, rng.choice(names), "".join(rng.choice("กขคง \n") for _ in range(40))) for i in range(60)]
    slips_df = spark.createDataFrame(texts, "index long, receiver_name string, raw_text string")
    targets = spark.createDataFrame([(n,) for n in sorted(set(names))], "target string")
    got = {(r["index"], r.target) for r in match.match_targets(slips_df, targets, widths).collect()}
    norm = lambda v: " ".join(v.split()).lower()
    want = {(i, n) for i, r, t in texts for n in set(names) if norm(n) in norm(r) or norm(n) in norm(t)}
    assert got == want


def test_tlv_stops_at_bad_length(spark):
    got = one(spark, "0002015802TH5404" + "9.5054041.2562xx99", payments.tlv_fields)
    assert [(f.id, f.value) for f in got] == [("00", "01"), ("58", "TH"), ("54", "9.50"), ("54", "1.25")]
    assert one(spark, "0002015802TH5404" + "9.5054041.25", payments.tlv_amount) == "1.25"


def test_blocks_do_not_change_results(spark):
    rng = random.Random(5)
    values = [(s, y, float(rng.choice([0, 0, 0, 5, 9]))) for s in range(3) for y in range(50)]
    rows = spark.createDataFrame(values, "series_id long, y long, activity double")

    def table(df):
        return sorted(tuple(r) for r in df.collect())
    for fn in (lambda b: series.smooth_weighted(rows, b), lambda b: series.smooth_box(rows, 5, b), lambda b: series.edge_delta(rows, b),
               lambda b: series.runs(rows, F.col("activity") > 0, b), lambda b: series.quiet_bands(rows, F.col("activity") == 0, F.col("activity"), 2, 1, 3, b),
               lambda b: ordered.running_total(rows, ["series_id"], "y", {"t": F.col("activity")}, b),
               lambda b: ordered.with_ordinal(rows, "y", "n", ["series_id"], b)):
        assert table(fn(7)) == table(fn(1 << 16))


def test_active_bounds_golden(spark):
    rows = spark.createDataFrame([(1, y, 9.0 if y in (21, 22, 61) else 0.0) for y in range(100)], "series_id long, y long, activity double")
    windows = spark.createDataFrame([(1, 10, 80)], "series_id long, start long, end long")
    r = series.active_bounds(rows, windows, 4.5, 3, 16).first()
    assert (r.has_content, r.from_y, r.to_y) == (True, 18, 65)


def test_fit_golden(spark):
    df = spark.createDataFrame([(600.0, 400.0, 900.0), (800.0, 908.0, 895.0), (10000.0, 10000.0, 895.0)], "w double, h double, f double")
    a = df.filter("f = 900").select(layout.box_fit(F.col("w"), F.col("h"), 800.0, 900.0).alias("b")).first().b
    assert tuple(a) == (1.0, 100.0, 500.0)
    b = df.filter("h = 908").select(layout.box_fit(F.col("w"), F.col("h"), 800.0, 895.0).alias("b")).first().b
    assert (b.scale, round(b.x, 6), round(b.y, 6)) == (0.98, 8.0, 5.16)
    assert df.filter("w = 10000").select(layout.box_fit(F.col("w"), F.col("h"), 800.0, 895.0).alias("b")).first().b is None
    assert layout.linear_scales(1, 0.9) == [1, 0.98, 0.96, 0.94, 0.92, 0.9]
    c = spark.createDataFrame([(645.0, 890.0), (1290.0, 1780.0), (1000.0, 500.0), (0.0, 5.0)], "w double, h double").select(
        layout.aspect_fit(F.col("w"), F.col("h")).alias("a")).collect()
    assert [r.a.scale if r.a else None for r in c] == [1.0, 0.5, 0.645, None]


def test_rollback_before_active_block(spark):
    """No quiet row near the ideal cut 42, which hits the block of rows 41 to 43: the cut goes two rows before it."""
    rows = [(1, y, 9.0 if 41 <= y <= 43 else 0.0, 9.0, 100) for y in range(100)]
    got = layout.gap_cuts(spark.createDataFrame(rows, "series_id long, y long, activity double, smooth double, height long"), 42, 20, 5, 2, 4.5, 2).orderBy("cut_no").first()
    assert (got.y, got.method, got.quality) == (39, "fallback_rollback", 0.0)


def brute_cuts(values, smooth, usable, up, down, tail, quiet, padding):
    n, at, out = len(values), 0, []
    while at < n:
        ideal = at + usable
        if ideal >= n:
            out.append((n, "end_of_image"))
            break
        near = [(smooth[y] * 20 + abs(y - ideal) * 0.08, y) for y in range(max(0, ideal - up), min(n - tail, ideal + down) + 1) if y < n and smooth[y] < quiet]
        if near and min(near)[1] > at:
            at = min(near)[1]
            out.append((at, "gap_valley"))
            continue
        low, high = at + 1, min(n - 1, ideal)
        active = [y for y in range(low + 1, high + 1) if values[y] >= quiet]
        if active:
            y = max(active)
            while y > low and values[y] >= quiet:
                y -= 1
            at = min(max(low, y + 1 - padding), high)
        else:
            at = max(low, high)
        out.append((at, "fallback_rollback"))
    return out


def test_gap_cuts_brute_force(spark):
    rng = random.Random(11)
    want, rows = {}, []
    for s in range(6):
        values = [float(rng.choice([0, 0, 3, 9, 9, 12])) for _ in range(rng.randint(15, 120))]
        n = len(values)
        smooth = [sum(values[max(0, y - 5):y + 6]) / len(values[max(0, y - 5):y + 6]) for y in range(n)]
        want[s] = brute_cuts(values, smooth, 20, 8, 3, 2, 5.0, 2)
        rows += [(s, y, values[y], smooth[y], n) for y in range(n)]
    df = spark.createDataFrame(rows, "series_id long, y long, activity double, smooth double, height long")
    got = {}
    for r in layout.gap_cuts(df, 20, 8, 3, 2, 5.0, 2).orderBy("series_id", "cut_no").collect():
        got.setdefault(r.series_id, []).append((r.y, r.method))
    assert got == want


def test_safe_cuts_cover_the_series(spark):
    rng = random.Random(2)
    heights = [(s, rng.randint(50, 400)) for s in range(5)]
    bands = [(s, c) for s, h in heights for c in sorted(rng.sample(range(1, h), 6))]
    got = layout.safe_cut_slices(spark.createDataFrame(bands, "series_id long, centre long"), spark.createDataFrame(heights, "series_id long, height long"),
                                 60, 22, 12, min_slice=8).orderBy("series_id", "slice_no").collect()
    for s, h in heights:
        mine = [r for r in got if r.series_id == s]
        assert mine[0].y_start == 0 and mine[-1].y_end == h
        assert all(a.y_end == b.y_start for a, b in zip(mine, mine[1:])) and all(r.y_end > r.y_start for r in mine)


def brute_slices(centres, height, page, up, down, least, min_slice):
    scales, out, start, k = layout.page_scales(least), [], 0, 0
    while start < height:
        lengths = [min(layout.rounded(page / x), height - start) for x in scales]

        def centre(row):
            above = [c for c in centres if row - up <= c <= row]
            below = [c for c in centres if row < c <= row + down]
            return max(above) if above else min(below) if below else None
        hits = [(centre(start + lengths[i]), i) for i in range(k, len(scales)) if centre(start + lengths[i]) is not None]
        end, to = hits[0] if hits else (start + lengths[k], len(scales) - 1)
        method = "EMERGENCY" if not hits else "SAFE_ZONE" if to == k else "SMART_SHRINK"
        if end <= start + min_slice:
            end = height if start and height - start <= min_slice else min(height, start + max(min_slice, lengths[k]))
        out.append((start, end, method, scales[to]))
        start, k = end, to
    return out


def test_safe_cuts_brute_force(spark):
    """Few and many centres; also pages so short that a centre above would not move the cut on."""
    rng = random.Random(3)
    heights = [(s, rng.randint(1, 500)) for s in range(24)]
    bands = [(s, c) for s, h in heights for c in rng.sample(range(h), min(h, rng.choice([0, 1, 4, 40])))]
    frames = spark.createDataFrame(bands, "series_id long, centre long"), spark.createDataFrame(heights + [(99, 0)], "series_id long, height long")
    for page, up, down, least, min_slice in ((60, 22, 12, 0.82, 8), (30, 25, 4, 0.5, 10), (7, 3, 9, 0.9, 1)):
        got = {}
        for r in layout.safe_cut_slices(*frames, page, up, down, least, min_slice).orderBy("series_id", "slice_no").collect():
            got.setdefault(r.series_id, []).append((r.y_start, r.y_end, r.method, r.scale))
        assert got == {s: brute_slices({c for t, c in bands if t == s}, h, page, up, down, least, min_slice) for s, h in heights}
    counts = {r.method: (r.n, r.mean_quality) for r in layout.cut_counts(layout.safe_cut_slices(*frames, 60, 22, 12, 0.82, 8)).collect()}
    assert set(counts) == {"SAFE_ZONE", "SMART_SHRINK", "EMERGENCY"} and all(q is None for _, q in counts.values())


def brute_split(parts, g):
    out, first = [], 0
    for i in range(1, len(parts)):
        (_, bottom, wide, _), (top, low, span, safe) = parts[i - 1], parts[i]
        gap = top - bottom
        cut = low - parts[first][0] > g.tallest and bottom - parts[first][0] >= g.least_part and safe and gap >= (g.wide_gap if max(wide, span) >= g.wide_span else g.gap)
        if cut and not (min(wide, span) >= g.media_span and gap <= g.media_gap):
            out.append((first, i))
            first = i
    return [(parts[a][0], parts[b - 1][1], b - a) for a, b in [*out, (first, len(parts))]]


def test_oversized_brute_force(spark):
    rng, limits, rows, want = random.Random(5), layout.SplitLimits(tallest=60, least_part=20, gap=2, wide_gap=4, wide_span=50, media_span=30, media_gap=3), [], {}
    for key in range(30):
        at, parts = rng.randint(0, 9), []
        for _ in range(rng.randint(1, 40)):
            height = rng.choice([1, 5, 12, 70])
            parts.append((at, at + height, float(rng.choice([10, 35, 60])), rng.random() < 0.5))
            at += height + rng.randint(0, 6)
        want[key % 4, key] = brute_split(parts, limits)
        rows += [(key % 4, key, *p) for p in parts]
    df = spark.createDataFrame(rows, "series_id long, object_no long, top long, bottom long, span double, safe boolean")
    got = {}
    for r in layout.split_oversized(df, limits).orderBy("series_id", "object_no", "part").collect():
        got.setdefault((r.series_id, r.object_no), []).append((r.top, r.bottom, r.fragments))
    assert got == want


def brute_pages(objects, height, g):
    """Object by object, page by page; objects are (id, top, bottom)."""
    def scale(h):
        return next(((True, x) for x in layout.shrink_scales() if h * x <= g.frame), (False, layout.shrink_scales()[-1]))

    def squeezed(used, size, x):
        shown = max(0, g.frame - used) / size
        if x < 0.5 or (shown < 0.25 and x < 0.9) or (shown < 0.45 and x < 0.78) or (used >= g.frame * 0.9 and x < 0.72):
            return False
        return used <= g.frame * 0.3 or (shown >= 0.5 and x >= 0.55) or x >= 0.6 or shown >= 0.65
    pages, at = [], 0
    while rest := [o for o in objects if o[2] > at]:
        start = max(at, rest[0][1] - 14) if pages else 0
        last = rest[0]
        for o in rest[1:]:
            projected, size = o[2] + 18 - start, o[2] - o[1]
            fits, x = scale(projected)
            if projected <= g.page or (size <= g.small_object and projected <= g.overflow) or (fits and squeezed(last[2] + 18 - start, size, x)):
                last = o
            else:
                break
        end = min(height, last[2] + 18)
        inside = [str(o[0]) for o in objects if o[1] >= start and o[2] <= end]
        pages.append((start, end, scale(last[2] + 18 - start)[1], len(inside), "|".join(inside)))
        at = end
    return pages


def test_pages_brute_force(spark):
    """Gaps above and below the padding, objects that lie in it, objects higher than a page, content that ends with the last object."""
    rng, rows, tops, want, g = random.Random(6), [], [], {}, layout.Geometry(800)
    for conv in range(40):
        at, objects = rng.choice([0, 30, 3000]), []
        for i in range(rng.randint(1, 40)):
            size = rng.choice([3, 9, 40, 150, 200, 400, 700, 1200, 2600])
            objects.append((i, at, at + size))
            at += size + rng.choice([0, 4, 10, 17, 18, 31, 40, 3000])
        height = objects[-1][2] + rng.choice([0, 5, 18, 500])
        want[conv] = brute_pages(objects, height, g)
        rows += [(conv, *o) for o in objects]
        tops.append((conv, height))
    df = spark.createDataFrame(rows, "conv_id long, object_id long, y_top long, y_bottom long").repartition(3)
    got = {}
    for r in layout.pack_pages(df, heights=spark.createDataFrame(tops, "conv_id long, height long")).orderBy("conv_id", "page_no").collect():
        got.setdefault(r.conv_id, []).append((r.y_start, r.y_end, r.scale, r.objects, r.object_ids))
    assert got == want
    assert layout.validate_pages(layout.pack_pages(df)).filter("rule in ('overlap', 'duplicate')").count() == 0
    assert layout.pack_pages(df.filter("conv_id < 0")).count() == 0


def test_split_points_brute_force(spark):
    rng, zones, heights, want = random.Random(8), [], [], set()
    for s in range(30):
        height = rng.randint(1, 300)
        own = sorted(rng.sample(range(height + 5), rng.choice([0, 2, 6])))
        own = [(own[i], own[i + 1] - rng.choice([0, 1])) for i in range(0, len(own), 2)]
        own = [(a, max(a, b)) for a, b in own]
        zones += [(s, a, b) for a, b in own]
        heights.append((s, height))
        at = 0
        while at < height:
            want.add((s, at))
            hit = [b for a, b in own if a <= at + 15 <= b]
            at = height if at + 15 >= height else min(height, min(hit) + 3) if hit else at + 15
        want.add((s, height))
    got = layout.split_points(spark.createDataFrame(zones, "series_id long, start long, end long"), spark.createDataFrame(heights, "series_id long, height long"), 15).collect()
    assert {(r.series_id, r.cut) for r in got} == want and len(got) == len(want)


def test_oversized_splits_at_safe_wide_gaps(spark):
    # limit is 2212 rows at width 800; only the third gap is safe
    rows = [(1, 0, i * 900, i * 900 + 860, 100.0, i == 3) for i in range(5)]
    got = layout.split_oversized(spark.createDataFrame(rows, "series_id long, object_no long, top long, bottom long, span double, safe boolean")).orderBy("part").collect()
    assert [(r.top, r.bottom, r.fragments) for r in got] == [(0, 2660, 3), (2700, 4460, 2)]


def test_near_copies_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(12)]
    docs = {}
    for i, b in enumerate(base):
        docs[i * 10] = " ".join(b)
        docs[i * 10 + 1] = " ".join(b)
        changed = list(b)
        changed[60] = "changed"
        docs[i * 10 + 2] = " ".join(changed)
    got = {r.doc_id: r for r in documents.near_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for i in range(12):
        a, b = grams(docs[i * 10]), grams(docs[i * 10 + 2])
        assert got[i * 10 + 1].kind == "exact" and got[i * 10 + 1].candidate_of == i * 10
        near = got[i * 10 + 2]
        assert near.candidate_of == i * 10 and math.isclose(near.similarity, len(a & b) / len(a | b))
    assert all(k % 10 in (1, 2) for k in got)


def test_near_groups_brute_force(spark):
    """Chains, crowds that share a run without being similar, and exact copies; every document is in the group that pair-by-pair comparison gives."""
    rng = random.Random(17)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(80)]
        for i in range(rng.choice([1, 3, 30])):
            t = list(base)
            for k in rng.sample(range(80), min(2, i)):
                t[k] = f"c{g}x{i}x{k}"
            texts.append(" ".join(t))
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(12):
        chain = list(chain)
        chain[10 * i:10 * i + 6] = [f"n{i}x{k}" for k in range(6)]
        texts.append(" ".join(chain))
    shared = " ".join(f"b{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"o{i}x{k}" for k in range(40)) for i in range(25)]
    texts += texts[::7] + ["", "", "short one"]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    want = {i: (group[i], "exact" if first[t] != i else "first" if group[i] == i else "near") for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for small in (4, 16):
        assert {r.doc_id: (r.group_id, r.kind) for r in documents.near_groups(df, small=small).collect()} == want
    assert documents.near_groups(df.filter("doc_id < 0")).count() == 0


def test_overlaps_brute_force(spark):
    """Few different turns, so that many lengths are possible and several are right."""
    rng = random.Random(19)
    convs = [[rng.choice("ab") for _ in range(rng.randint(1, 40))] for _ in range(60)]
    for i in range(0, 58, 3):
        convs[i + 1] = convs[i][-rng.randint(1, len(convs[i])):] + convs[i + 1]
    turns = spark.createDataFrame([(c, k, h) for c, t in enumerate(convs) for k, h in enumerate(t)], "conv_id long, pos long, h string").repartition(3)
    order = spark.createDataFrame([(c, c + 1, len(convs[c])) for c in range(len(convs) - 1)], "conv_id long, next_id long, n long")
    lengths = {c: max((k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]), default=0) for c, (a, b) in enumerate(zip(convs, convs[1:]))}
    found = layout.overlap_lengths(turns, order)
    assert {r.conv_id: r.overlap for r in found.collect()} == {c: k for c, k in lengths.items() if k}
    left = {}
    for r in layout.trimmed_turns(turns, found).orderBy("conv_id", "pos").collect():
        left.setdefault(r.conv_id, []).append((r.pos, r.h))
    cut = {c: lengths[c - 1] if c and lengths[c - 1] < len(t) else 0 for c, t in enumerate(convs)}
    assert left == {c: list(enumerate(t[cut[c]:])) for c, t in enumerate(convs)}


def test_money_helpers(spark):
    assert one(spark, "x 1,234.50 THB", T.first_number) == 1234.5
    assert one(spark, "none", T.first_number) == 0.0
    assert one(spark, "a​ \t b ", T.normalize_for_match) == "a b"


def test_ordered_helpers_keep_null_keys_and_positions(spark):
    rows = [("a", 0, 1), (None, 5, 2), (None, None, 4), ("a", None, 8), ("a", 3, 16), ("a", 3, 32), (None, 5, 2)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    ordinal = ordered.with_ordinal(df, "p", "n", ["k"], block=2).collect()
    assert sorted((r.k or "", r.n) for r in ordinal) == [("", 1), ("", 2), ("", 3), ("a", 1), ("a", 2), ("a", 3), ("a", 4)]
    assert {(r.k, r.v): r.n for r in ordinal}[None, 4] == 1 and {(r.k, r.v): r.n for r in ordinal}["a", 8] == 1
    totals = ordered.running_total(df, ["k"], "p", {"t": F.col("v")}, block=2).collect()
    assert len(totals) == len(rows) and {(r.k, r.v): r.t for r in totals}["a", 1] == 9 and max(r.t for r in totals if r.k is None) == 8
    best = ordered.running_max_before(df, ["k"], "p", F.col("v"), "m", block=2).collect()
    assert len(best) == len(rows) and {(r.k, r.v): r.m for r in best}["a", 1] == 8
    near = ordered.with_neighbours(df, ["k"], "p", 1, 1, {"s": lambda w: F.lag("v").over(w)}, block=2).collect()
    assert len(near) == len(rows)


def test_ordinal_by_a_pair(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (0, 9)], "p long, q long")
    assert {(r.p, r.q): r.n for r in ordered.with_ordinal(df, "p", "n", then=["q"]).collect()} == {(0, 9): 1, (1, 1): 2, (1, 2): 3}


def test_intervals_with_one_start(spark):
    spans = [(0, 5), (0, 9), (0, 7), (20, 30), (20, 22), (50, 51), (50, 60)]
    got = series.merge_gaps(spark.createDataFrame([("s", a, b) for a, b in spans], "series_id string, start long, end long"), 2).collect()
    assert sorted((r.start, r.end, r.parts) for r in got) == [(0, 9, 3), (20, 30, 2), (50, 60, 2)]


def test_natural_order_of_any_length(spark):
    names = ["f99999999999999999999.jpg", "f1234567890123456789012345.jpg", "F2.jpg", "f010.jpg", "f9.jpg", "f.jpg", "10", "9"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(files.natural_key(F.col("n"))).collect()]
    assert [n for n in got if n != "f.jpg"] == ["9", "10", "F2.jpg", "f9.jpg", "f010.jpg", "f99999999999999999999.jpg", "f1234567890123456789012345.jpg"]


def test_amounts_are_rounded_as_binary_values(spark):
    rng = random.Random(9)
    values = [0.125, 0.375, 1.005, 2.675, 0.005, 0.015, 0.115, -0.125, -3.456, 0.0, 12345678.905, 99999.995, 1e9 + 0.015] + [rng.randrange(10**9) / 1000 for _ in range(400)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.two_decimals(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.2f}" for r in got]


def test_fingerprint_escapes_control_characters(spark):
    import hashlib
    import json
    row = {"amount": 0.125, "receiver_bank": "b\x01", "receiver_name": 'a"\\\x02\x7f', "sender_bank": "", "sender_name": "s\x08", "transaction_date": "2024-01-02", "transaction_id": "t", "transaction_time": "10:00"}
    df = spark.createDataFrame([tuple(row.values())], "amount double, receiver_bank string, receiver_name string, sender_bank string, sender_name string, transaction_date string, transaction_id string, transaction_time string")
    want = hashlib.sha256(json.dumps({**row, "amount": "0.12"}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert match.with_fingerprint(df).first().fingerprint == want


def test_audit_files_without_numbers_keep_their_order(spark, tmp_path):
    import json
    slip = {"raw_text": "x", "is_slip": True, "transaction_date": "2024-01-02", "transaction_time": "10:00", "sender_name": "s", "receiver_name": "somchai", "amount": 5.0, "transaction_id": "t1"}
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"summary": {"scanned_files": 1}, "results": [{**slip, "file_name": f"{name}.jpg", "file_path": f"/{name}.jpg"}]}))
    done = match.replay_audit(scan.read_audit(spark, str(tmp_path)), "somchai").collect()
    assert {r.file_name: (r.duplicate, r.duplicate_of) for r in done} == {"a.jpg": (False, None), "b.jpg": (True, "a.jpg")}
