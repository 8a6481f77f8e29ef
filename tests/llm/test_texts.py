"""Tokens, languages, quality, privacy and mixing."""
import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import regex
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slipweave.llm import bpe, divergence, language, mixing, pieces, surrogates, token_counts
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|>", " a  b \n c  d <|endoftext|> x<|endoftext|>", "", "  ", "it's  we'll\t\tgo \x1c x \x85 y", "日本語 テキスト 👩‍👩‍👧 　 a", " lead", "trail ", "a\n\n\n b",
       "x" * 3000, "12 345 ² Ⅷ", "a b c  d", "<|endoftext", "é" * 200 + "!" * 100]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_equals_library(spark, sf_dir, library):
    texts = [t for _, t, _, _ in brute.documents(spark, sf_dir)][:60] + ODD
    codec = bpe.Codec(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(text) == want.ids
        assert codec.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)
        assert "".join(pieces.cut(text)) == text


def test_heap_and_side_by_side_agree():
    codec, rng = bpe.Codec(PATH), np.random.default_rng(2)
    words = ["".join(rng.choice(list("thearin "), rng.integers(1, 60))).encode() for _ in range(300)] + [b"a" * 60, "ü".encode() * 20]
    assert codec.merge_side_by_side(words) == [codec.merge(w) for w in words]


def test_decode_of_broken_ids(library):
    codec = bpe.Codec(PATH)
    ids = library.encode("日本", add_special_tokens=False).ids[:-1]
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_token_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (0, ODD[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.token_digests(df, PATH).collect())) == sorted(want)
    full = {r.doc_id: r for r in bpe.token_ids(df, PATH).collect()}
    assert full[99].ids == [] and full[1].decoded == ODD[1]
    for frame in (brute.edge_frame(spark), brute.empty_frame(spark)):
        assert bpe.token_digests(frame, PATH).count() == frame.count() == token_counts.token_counts(frame, PATH).count()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, sf_dir, name):
    path = public_tokenizers.path(name)
    rows = [(d, t) for d, t, _, _ in brute.documents(spark, sf_dir)][:80] + [(900 + i, t) for i, t in enumerate(ODD)] + [(999, None)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path).collect()}
    if name.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = [len(model.encode(t or "")) for _, t in rows]
    else:
        n = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == {d: (len((t or "").encode()), k, k > 512) for (d, t), k in zip(rows, n)}


def test_cache_forgets(library):
    known = pieces.Encoded(lambda words: [len(library.encode(w, add_special_tokens=False).ids) for w in words], chars=200)
    for k in range(50):
        texts = [pieces.cut(f"word{k} and word{k + 1} again")]
        known.fill(texts)
        assert sum(known[p] for p in texts[0]) == len(library.encode(f"word{k} and word{k + 1} again", add_special_tokens=False).ids)
        assert len(known) < 40


def test_base_rules_and_divergence(spark, sf_dir):
    rows = [(d, t, x) for d, t, x, _ in brute.documents(spark, sf_dir)]
    noise = [(9000 + i, "%%$$ ##@@ " * 40 + " ".join(f"{i}{k}&&" for k in range(60)), "en") for i in range(3)]
    edges = [(8000 + i, r[1], r[2]) for i, r in enumerate(brute.edge_rows())]
    got = {r.doc_id: r for part in (rows + noise, edges) for r in divergence.judge(spark.createDataFrame(part, "doc_id bigint, text string, lang string")).collect()}
    for d, t, _ in rows + noise + edges:
        n, chars, symbols, dup, repeat = brute.base_counts(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
        assert (r.char_distance is None) == (len(t or "") < divergence.MIN_CHARS) and (r.word_distance is None) == (n < divergence.MIN_WORDS)
    assert not any(got[9000 + i].kept for i in range(3))
    plain = [got[d] for d, t, _ in rows if not re.search(r"[#*$%&]{3}|!!| \| ", t) and not got[d].base_failed]
    assert all(r.kept for r in plain) and len(plain) > 100
    assert divergence.judge(brute.empty_frame(spark)).count() == 0


def test_references_are_whole_sums(spark, sf_dir):
    rows = brute.documents(spark, sf_dir)
    refs = divergence.references(spark.createDataFrame([(x, t) for _, t, x, _ in rows], "lang string, text string"))
    counts = Counter(divergence.normal(w) for _, t, x, _ in rows if x == "de" for w in brute.WORDS.findall(t))
    total, common = sum(counts.values()), {w: n for w, n in counts.items() if w and n >= sum(counts.values()) / divergence.COMMON}
    assert set(refs["de"][1]) == set(common) and len(common) <= divergence.COMMON
    assert refs["de"][2].tolist() == [common[w] for w in refs["de"][1]] + [total - sum(common.values())]
    assert divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0 and divergence.distance(np.array([1.0, 3]), np.array([2.0, 6])) < 1e-7


def test_rare_languages_have_their_own_reference(spark, sf_dir):
    """Rare languages in other scripts, and more of them than MIN_SHARE, are judged by their own texts."""
    rows = [(d, t, x) for d, t, x, _ in brute.documents(spark, sf_dir)]
    rng = np.random.default_rng(6)
    greek = "και το μια λέξη είναι στην πόλη με τους φίλους που ήρθαν από μακριά φορές ένα δρόμο θάλασσα σπίτι νύχτα".split()
    rare = [(9100 + k, " ".join(rng.choice(greek, 90)), f"el{k // 2}") for k in range(140)] + [(9300, None, "xx"), (9301, "short", "yy")]
    before = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(rows + rare, "doc_id bigint, text string, lang string").repartition(4)).collect()}
    assert len(got) == len(rows) + len(rare) and all(got[d].kept for d, _, _ in rare[:140]) and not got[9300].kept
    assert all(got[d] == before[d] for d, _, x in rows if x)
    for k in (0, 77):
        own = [t for _, t, x in rare if x == f"el{k // 2}"]
        classes = sum(divergence.char_classes(t.encode()) for t in own).astype(float)
        assert got[9100 + k].char_distance == round(divergence.distance(divergence.char_classes(rare[k][1].encode()).astype(float), classes), 9)


def test_language_fusion(spark, sf_dir):
    docs = brute.documents(spark, sf_dir)
    hosts = ["a.example.fr", "b.example.fr", "www.site.de", "x.co", None, "src0"]
    rows = [(d, t[:60 + d % 40], None if d % 3 else x, hosts[d % len(hosts)]) for d, t, x, _ in docs] + [(9000, None, "en", "a.example.fr"), (9001, "1234 !!", "de", None), (9002, "", None, None)]
    df = spark.createDataFrame(rows, "id bigint, text string, declared string, host string")
    got = {r.id: (r.lang, r.confidence) for r in language.identify(df).collect()}
    want = brute.posterior(rows, language.LANGUAGES)
    assert set(got) == set(want)
    for i, (lang, p) in want.items():
        assert abs(got[i][1] - p) < 1e-4 and (got[i][0] == lang or p < 0.51), (i, got[i], want[i])


def test_language_of_held_out_texts(spark, sf_dir):
    """Half of the rows declare nothing: their language is found from the others."""
    docs = brute.documents(spark, sf_dir)
    rows = [(d, t, x if d % 2 else None, None) for d, t, x, _ in docs]
    got = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id bigint, text string, declared string, host string")).collect()}
    hidden = [(d, x) for d, _, x, _ in docs if d % 2 == 0]
    assert sum(got[d].lang == x for d, x in hidden) / len(hidden) > 0.98 and all(got[d].kept for d, _ in hidden)


def test_language_edges(spark):
    df = brute.edge_frame(spark)
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} & {4, 5, 6} == set()
    assert language.keep_identified(brute.empty_frame(spark)).count() == 0


def test_other_languages_are_not_identified(spark, sf_dir):
    """Texts in languages without a model, whatever they are declared as; documents of the four languages stay."""
    docs = [(d, t, x, s) for d, t, x, s in brute.documents(spark, sf_dir)]
    other = ["Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
             "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
             "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。"]
    rows = docs + [(100_000 + i, t, x, "src0") for i, t in enumerate(other) for x in (None, "en")][::2] + [(200_000, other[0], "ru", None)]
    frame = spark.createDataFrame(rows, "id bigint, text string, declared string, host string")
    got = {r.id: (r.lang, r.confidence, r.kept) for r in language.identify(frame).collect()}
    assert all(v == ("und", 0.0, False) for k, v in got.items() if k >= 100_000)
    before = brute.posterior(rows, language.LANGUAGES)
    assert all(got[d][0] == before[d][0] and got[d][2] == (before[d][0] != "und" and before[d][1] >= language.MIN_CONFIDENCE) for d, _, _, _ in docs)


def test_surrogates_are_distinct_consistent_and_typed(spark):
    people = [(i, f"Mr. John Smith{i % 3 * 'x'} wrote a{i}.b@mail{i % 4}.example.com, call +1 (564) 555-{4000 + i} or +1 564 555 {4000 + i}; card 4111 1111 1111 1111; "
                  f"from 10.2.33.{100 + i}. Frau Anna Meier, Господин Иван Петров. token = \"{'0a1b2c3d4e' * 2}{i:02x}\"") for i in range(40)]
    rows = people + [(100, "nothing to hide 12 3.5"), (101, None), (102, ""), (0, "other text +1 (564) 555-4000"), (0, "other text +1 (564) 555-4000")]
    out = surrogates.replace_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(rows) and by[100][0].clean_text == "nothing to hide 12 3.5" and by[101][0].clean_text is None and by[102][0].clean_text == ""
    phones, mails, octets = set(), set(), set()
    for i, text in people:
        clean = next(r.clean_text for r in by[i] if r.text == text)
        a, b = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4});", clean).groups()[:3], re.search(r"or \+1 (\d{3}) (\d{3}) (\d{4});", clean).groups()
        assert a == b and "".join(a) != f"564555{4000 + i}"
        phones.add(a)
        mails.add(re.search(r"wrote (\S+@\S+\.com),", clean)[1])
        octets.add(re.search(r"from (\d{2}\.\d\.\d{2}\.\d{3})\.", clean)[1])
        card = re.search(r"card (\d{4}) (\d{4}) (\d{4}) (\d{4});", clean)
        digits = [int(x) for x in "".join(card.groups())]
        assert (sum(digits[1::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[::2])) % 10 == 0
        given = re.match(r"Mr\. (\S+) \S+ wrote", clean)[1]
        assert given in surrogates.GIVEN["latin", "m"] and re.search(r"Frau (\S+) ", clean)[1] in surrogates.GIVEN["latin", "f"]
        assert re.search(r"Господин (\S+) ", clean)[1] in surrogates.GIVEN["cyrillic", "m"] and "0a1b2c3d4e" not in clean
    assert len(phones) == len(mails) == len(octets) == len(people)
    shared = next(r.clean_text for r in by[0] if r.text.startswith("other"))
    assert shared.split("text ")[1] in next(r.clean_text for r in by[0] if r.text.startswith("Mr"))


def test_secrets_in_capitals_and_addresses_after_phones(spark):
    rows = [(1, 'TOKEN = "9233A8EC77B10D42" here'), (2, "PASSWORD=Abcdefgh12 and Api_Key: zyxwvuts99"), (3, "call +1 564 555 4000 10.2.223.204 now"), (4, "call +44 (20) 7946 0018 192.168.23.204, +1.564.555.4001"),
            (5, "+1 564 555.4002 and +49 30 1234 5678")]
    got = {r.doc_id: (r.n_entities, r.clean_text) for r in surrogates.replace_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i][0] for i in range(1, 6)] == [1, 2, 2, 3, 2]
    for i, hidden in ((1, "9233A8EC"), (2, "Abcdefgh12"), (2, "zyxwvuts99"), (3, ".223.204"), (3, "4000"), (4, ".23.204"), (4, "0018"), (4, "4001"), (5, "4002"), (5, "5678")):
        assert hidden not in got[i][1]
    assert re.fullmatch(r'TOKEN = "[0-9A-Z]{16}" here', got[1][1]) and re.fullmatch(r"call \+1 \d{3} \d{3} \d{4} \d{2}\.\d\.\d{3}\.\d{3} now", got[3][1])


def test_surnames_keep_gender_and_person(spark):
    """Госпожа Иванова and Господин Иванов are one surname in two forms; names beyond the lists are built, as long as the original or nearly so."""
    names = ["".join(p) for p in itertools.product(["Ка", "По", "Ли", "Се", "Ду"], ["ра", "го", "ми", "не", "вы"], ["ш", "т", "р", "л"], ["ов", "ев"])]
    rows = [(i, f"Господин {w}, Госпожа {w}а и Госпожа Анна {w}а") for i, w in enumerate(names)] + [(900, "Κυρία Βλάχου και Κύριος Παππός")]
    got = {r.doc_id: r.clean_text for r in surrogates.replace_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    drawn = set()
    for i, w in enumerate(names):
        man, woman, again = re.fullmatch(r"Господин (\w+), Госпожа (\w+) и Госпожа \w+ (\w+)", got[i]).groups()
        assert re.search("(ов|ев|ин)$", man) and woman == again == man + "а" and abs(len(man) - len(w)) <= 4
        drawn.add(man)
    assert len(drawn) == len(names) and not drawn & set(names)
    assert re.fullmatch(r"Κυρία \w+(ου|ού|ή|ίδου) και Κύριος \w+", got[900])


def _parts(kind, m):
    """What a mention says beside its form: the units that have one surrogate each."""
    if kind == "email":
        return [("email", m.lower())]
    if kind == "name":
        title, *words = m.split(" ")
        woman = regex.match(surrogates.WOMAN, m) is not None
        return [(f"given {woman}", w) for w in words[:-1]] + [("surname", re.sub("(ов|ев|ёв|ин|ын)а$", r"\1", words[-1]) if woman else words[-1])]
    if kind == "secret":
        return [("secret", re.search(r"[A-Za-z0-9_+/-]+$", m)[0])]
    return [("ip", m)] if kind == "ip" else [("iban", m.replace(" ", ""))] if kind == "iban" else [("phone" if kind == "phone" else kind, re.sub("[^0-9]", "", m))]


def test_surrogates_brute_force(spark, sf_dir):
    """On whole documents: entities are those that the patterns find one by one, the text between them stays, one unit has one surrogate, no two share one and none is real."""
    rows = [(d, t) for d, t, _, _ in brute.documents(spark, sf_dir)]
    got = {r.doc_id: r for r in surrogates.replace_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    any_of, kinds = regex.compile(surrogates.ANY), ["email", "secret", "name", "phone", "ip", "ssn", "card", "iban"]
    drawn = {}
    for d, text in rows:
        found = list(any_of.finditer(text or ""))
        assert got[d].n_entities == len(found), d
        pattern, at = "", 0
        for m in found:
            kind = next(k for k in kinds if regex.fullmatch(surrogates.PATTERNS[k], m[0]))
            # only names change their length
            pattern += regex.escape(text[at:m.start()]) + (r"(\w+\.?(?: [\w'’-]+)+?)" if kind == "name" else f"((?s:.{{{len(m[0])}}}))")
            at = m.end()
        new = regex.fullmatch(pattern + regex.escape(text[at:]), got[d].clean_text) if found else None
        assert (new is not None) == bool(found) and (found or got[d].clean_text == text)
        for m, s in zip(found, new.groups() if found else ()):
            kind = next(k for k in kinds if regex.fullmatch(surrogates.PATTERNS[k], m[0]))
            assert re.sub(r"\w", "", m[0]) == re.sub(r"\w", "", s) or kind in ("name", "ip")
            for (family, a), (_, b) in zip(_parts(kind, m[0]), _parts(kind, s), strict=True):
                assert drawn.setdefault((family, a), b) == b
    for family in {f for f, _ in drawn}:
        own = {a: b for (f, a), b in drawn.items() if f == family}
        assert len(set(own.values())) == len(own) and not set(own) & set(own.values())


def test_surrogates_of_a_crowded_form(spark):
    """All 256 last octets of width three and less: collisions are redrawn until all differ and none is real."""
    units = [("ssn", f"{i:03d}") for i in range(0, 1000, 2)]
    got = surrogates.assign(spark.createDataFrame(units, "kind string, core string")).collect()
    assert len({r.s for r in got}) == len(units) == len(got) and not {r.s for r in got} & {c for _, c in units}


def test_surrogates_edges(spark):
    out = surrogates.replace_personal_data(brute.edge_frame(spark))
    assert out.columns[-2:] == ["n_entities", "clean_text_"] and out.count() == len(brute.edge_rows())
    assert surrogates.replace_personal_data(brute.empty_frame(spark)).count() == 0


def test_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights, other = {"src0": 0.5, "src1": 0.1, "gone": 0.3}, 0.2
    rows = [(d, t, s) for d, t, _, s in brute.documents(spark, sf_dir)]
    rate = brute.mixing_rates(rows, weights, other, 40.0)
    got = mixing.mix_sources(docs, weights, other, epochs=40.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.countDistinct("shuffle_key").alias("k")).collect()
    assert all(r.n == r.m == r.k for r in got)
    assert {r.doc_id: r.n for r in got} == {d: n for d, _, s in rows if (n := brute.poisson(rate[s], mixing.SEED, d))}
    made = Counter()
    copies = {r.doc_id: r.n for r in got}
    for d, t, s in rows:
        made[s] += copies.get(d, 0) * (len(t.encode()) + 1)
    assert abs(made["src0"] / sum(made.values()) - 0.5 / 0.8) < 0.04


def test_mixing_edges(spark):
    df = brute.edge_frame(spark)
    out = mixing.mix_sources(df, {"a": 1.0}, 1.0, epochs=20.0)
    assert out.columns == [*df.columns, "copy_no_", "n_copies", "shuffle_key_"] and {r.doc_id for r in out.collect()} == {r[0] for r in brute.edge_rows()}
    assert mixing.mix_sources(df, {"a": 1.0}, 1.0, extra=False).columns == df.columns
    assert mixing.mix_sources(brute.empty_frame(spark), {"a": 1.0}, 1.0).count() == 0
