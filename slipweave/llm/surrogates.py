"""Surrogates for personal data.

Detected entities are replaced by made-up ones of the same kind and form. An entity is a list of units: an address has a local part and a
domain, a name its given names and its surname. Units with one (kind, core) get one surrogate everywhere, so mentions that refer to one
entity still do: a phone number written in two ways, or 'Mr. Smith' after 'Mr. John Smith'. A surrogate is drawn by a keyed hash of kind, core
and attempt: digits stay digits and letters stay letters of their case, names keep gender and script, card numbers keep a right check
digit, addresses keep their top-level domain, octets their width. The mention's own punctuation is kept. Surnames that differ by gender are one unit, the
form of a man, and appear in the form that the mention's honorific asks for. First draws of names come from short lists; where these are taken, names are
built from syllables, about as long as the original.

Collision checks run over the table of distinct units: a surrogate that another unit of its kind has, or that is itself a real unit, is
drawn again with the next attempt. Attempts from WIDEN on lengthen the surrogate, so the loop ends also where all values of a form are taken.

Texts without entities pass straight through without a shuffle; null stays null. Rows are met by (doc_id, hash of the text), so rows
that share a doc_id do not mix, and repeated rows are replaced alike. Names count as such after an honorific, secrets after a
keyword in capitals or not; a phone number ends before a blank and an internet address. The key is a secret of the caller.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave.llm.common import attach, column, documents, fresh, stored
from slipweave.llm.registry import query

KEY = "surrogate-key-1"
#: Attempts before surrogates get longer.
WIDEN = 6
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE, key=len, reverse=True)) + r")\b\.?"
WOMAN = "(?:" + "|".join(FEMALE) + r")\b"
WORD = r"\p{Lu}[\p{L}\p{M}'’-]*+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"{OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"""(?<![A-Za-z0-9])(?:(?i:token|secret|password|passwd|api[_-]?key)\s{0,2}[=:]\s{0,2}["']?[A-Za-z0-9_+/-]{8,}|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))""",
    "name": rf"(?<![\p{{L}}\p{{N}}]){TITLE} {WORD}(?: {WORD}){{0,2}}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": rf"(?<![\p{{L}}\p{{N}}+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)|[0-9]{{1,4}})(?:(?: (?!{IP})|[.-]?)[0-9]{{2,4}}){{1,4}}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){IP}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has one of; texts without it need no search.
SIGN = rf"[0-9@=:]|AKIA|(?<![\p{{L}}\p{{N}}]){TITLE} "
GIVEN = {
    ("latin", "m"): ["Adam", "Boris", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Hanna", "Ida", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Лидия"],
    ("greek", "m"): ["Ανδρέας", "Βασίλης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"],
}
SURNAMES = {
    "latin": ["Adler", "Bergman", "Castell", "Dorn", "Engel", "Falk", "Garner", "Holm", "Iversen", "Jansen", "Keller", "Lindt", "Moreau", "Norden", "Orlan", "Pereda"],
    "cyrillic": ["Белов", "Волков", "Громов", "Дубов", "Жуков", "Зимин", "Котов", "Лосев"],
    "greek": ["Αλεξίου", "Βλάχος", "Γεωργίου", "Δήμου", "Καλός", "Λάμπρου", "Μακρής", "Νικολάου"],
}


#: Syllables that further names are built from, and the endings of given names by gender and of surnames.
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstv" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδζκλμνπρστφ" for v in "αειου"],
}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("greek", "m"): "ς", ("greek", "f"): "να",
           "latin": "ner", "cyrillic": "нов", "greek": "νίδης"}
#: Endings of surnames of men and women, as (pattern of a woman's form, the man's) and (pattern of a man's form, the woman's), by script.
TO_MALE = {"cyrillic": [("(ов|ев|ёв|ин|ын)а$", "$1"), ("ская$", "ский"), ("цкая$", "цкий")]}
TO_FEMALE = {"cyrillic": [("(ов|ев|ёв|ин|ын)$", "$1а")], "greek": [("ίδης$", "ίδου"), ("ής$", "ή"), ("ός$", "ού"), ("ος$", "ου")]}


def _digest(kind: Column, core: Column, attempt: int, key: str, block: Column | int = 0) -> Column:
    block = block.cast("string") if isinstance(block, Column) else F.lit(str(block))
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, core, F.lit(str(attempt)), block), 256)


def _number(digest: Column, at: Column | int, width: int = 4) -> Column:
    return F.conv(F.substring(digest, at, width), 16, 10).cast("int")


def _letters(core: Column, kind: Column, attempt: int, key: str, keep: Column) -> Column:
    """The core with every digit and ASCII letter after the first ``keep`` characters drawn anew within its class."""
    hex_only = core.rlike("^[0-9a-f]+$")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(core) / 16).cast("int")), lambda b: _digest(kind, core, attempt, key, b))

    def drawn(c: Column, i: Column) -> Column:
        v = _number(F.get(blocks, F.floor(i / 16).cast("int")), (i % 16) * 4 + 1)
        letter = F.when(hex_only, F.lit(6)).otherwise(F.lit(26))
        return (F.when(i < keep, c).when(c.rlike("[0-9]"), (v % F.when(i == 0, F.lit(9)).otherwise(F.lit(10)) + F.when(i == 0, F.lit(1)).otherwise(F.lit(0))).cast("string"))
                .when(c.rlike("[a-z]"), F.char(v % letter + 97)).when(c.rlike("[A-Z]"), F.char(v % letter + 65)).otherwise(c))
    return F.array_join(F.transform(F.filter(F.split(core, ""), lambda c: c != ""), drawn), "")


def _check_digit(digits: Column) -> Column:
    """Luhn's check digit for the first fifteen digits."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + F.transform(F.array(F.substring(digits, i, 1).cast("int") * (F.lit(1) + i % 2)), lambda d: d - F.when(d > 9, F.lit(9)).otherwise(F.lit(0)))[0])
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _valid_card(core: Column) -> Column:
    return _check_digit(core) == F.substring(core, 16, 1)


def _octets(core: Column, kind: Column, attempt: int, key: str) -> Column:
    d = _digest(kind, core, attempt, key)

    def drawn(o: Column, i: Column) -> Column:
        v = _number(d, i * 4 + 1)
        return F.when(F.length(o) == 1, v % 9 + 1).when(F.length(o) == 2, v % 90 + 10).otherwise(v % 100 + 100).cast("string")
    return F.array_join(F.transform(F.split(core, r"\."), drawn), ".")


def script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _name(names: list[str], script: str, ending: str, kind: Column, core: Column, attempt: int, key: str) -> Column:
    """At first a name of the list; later ones are built from syllables and an ending, as long as the core at least up to one syllable."""
    d = _digest(kind, core, attempt, key)
    if not attempt:
        return F.get(F.array(*[F.lit(n) for n in names]), _number(d, 1, 6) % len(names))
    table = SYLLABLES[script]
    pick, count = F.array(*[F.lit(x) for x in table]), F.greatest(F.lit(1), F.least(F.lit(9), F.ceil((F.length(core) - len(ending)) / 2).cast("int"))) + min(1, (attempt - 1) // 2)
    return F.concat(F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.get(pick, _number(d, k * 6 + 1, 6) % len(table))), "")), F.lit(ending))


def _reformed(word: Column, rules: dict, script_of: Column) -> Column:
    """The word in the form of the other gender, by the first rule of its script that fits."""
    out = word
    for script_name, pairs in rules.items():
        changed = word
        for pattern, replacement in reversed(pairs):
            changed = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, replacement)).otherwise(changed)
        out = F.when(script_of == script_name, changed).otherwise(out)
    return out


def surrogate(kind: Column, core: Column, attempt: int, key: str) -> Column:
    """The surrogate of a unit at an attempt; kind is that of ``units_of``."""
    out = F.when(kind == "ip", _octets(core, kind, attempt, key))
    fresh_card = _letters(core, kind, attempt, key, F.lit(1))
    out = out.when((kind == "card") & _valid_card(core), F.concat(F.substring(fresh_card, 1, 15), _check_digit(fresh_card)))
    for (s, gender), names in GIVEN.items():
        out = out.when(kind == f"given-{s}-{gender}", _name(names, s, ENDINGS[s, gender], kind, core, attempt, key))
    for s, names in SURNAMES.items():
        out = out.when(kind == f"surname-{s}", _name(names, s, ENDINGS[s], kind, core, attempt, key))
    kept = F.when(kind == "card", 1).when(kind.isin("phone1", "phone2", "phone3"), F.substring(kind, 6, 1).cast("int")).when(kind == "iban", 2).when((kind == "secret") & core.startswith("AKIA"), 4).otherwise(0)
    out = out.otherwise(_letters(core, kind, attempt, key, kept))
    if attempt >= WIDEN:
        out = F.concat(out, F.when(kind.startswith("given") | kind.startswith("surname"), F.translate(F.substring(_digest(kind, core, attempt, key, 1), 1, attempt), "0123456789", "ghijklmnop"))
                       .otherwise(F.substring(F.translate(_digest(kind, core, attempt, key, 1), "abcdef", "012345"), 1, attempt - WIDEN + 1)))
    return out


def mention_kind(m: Column) -> Column:
    out = F.when(m.rlike("^(?:" + PATTERNS["email"] + ")$"), "email")
    for name in ("secret", "name", "phone", "ip", "ssn", "card", "iban"):
        out = out.when(m.rlike("^(?:" + PATTERNS[name] + ")$"), name)
    return out.otherwise("iban")


def units_of(m: Column) -> Column:
    """An array of (kind, core) of a mention."""
    kind = mention_kind(m)
    unit = lambda k, c: F.struct(k.alias("kind"), c.alias("core"))
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    digits = F.regexp_replace(m, "[^0-9]", "")
    country = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1))
    named = F.split(F.regexp_replace(m, f"^{TITLE} ", ""), " ")
    female = m.rlike(f"^{WOMAN}")
    gender = F.when(female, "f").otherwise("m")
    last = lambda i: i == F.size(named) - 1
    parts = F.transform(named, lambda w, i: unit(F.when(last(i), F.concat(F.lit("surname-"), script(w))).otherwise(F.concat(F.lit("given-"), script(w), F.lit("-"), gender)),
                                                 F.when(last(i) & female, _reformed(w, TO_MALE, script(w))).otherwise(w)))
    return (F.when(kind == "email", F.array(unit(F.lit("email"), F.concat(F.lower(local), F.lit("@"), F.lower(host))), unit(F.lit("domain"), F.lower(F.regexp_replace(host, r"\.[^.]*$", "")))))
            .when(kind == "secret", F.array(unit(F.lit("secret"), F.regexp_extract(m, r"([A-Za-z0-9_+/-]+)$", 1))))
            .when(kind == "name", parts)
            .when(kind == "phone", F.array(unit(F.concat(F.lit("phone"), F.greatest(country, F.lit(1)).cast("string")), digits)))
            .when(kind == "ip", F.array(unit(F.lit("ip"), m)))
            .when(kind == "iban", F.array(unit(F.lit("iban"), F.replace(m, F.lit(" "), F.lit("")))))
            .otherwise(F.array(unit(kind, digits))))


def _refill(m: Column, s: Column, pattern: str) -> Column:
    """The mention with its characters of the pattern replaced one by one by those of the surrogate; a longer surrogate's rest follows."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(a, c):
        hit = c.rlike(pattern)
        return F.struct(F.concat(a["out"], F.when(hit, F.substring(s, a["k"], 1)).otherwise(c)).alias("out"), (a["k"] + hit.cast("int")).alias("k"))
    return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, step, lambda a: F.concat(a["out"], F.substr(s, a["k"])))


def rendered(m: Column, s: Column) -> Column:
    """The mention with the surrogates ``s`` of its units."""
    kind, one = mention_kind(m), s[0]
    tld = F.concat(F.lit("."), F.substring_index(m, ".", -1))
    title = F.regexp_extract(m, f"^{TITLE} ", 0)
    return (F.when(kind == "email", F.concat(F.substring_index(one, "@", 1), F.lit("@"), s[1], tld))
            .when(kind == "secret", F.concat(F.regexp_replace(m, r"[A-Za-z0-9_+/-]+$", ""), one))
            .when(kind == "name", F.concat(title, F.array_join(F.transform(s, lambda w, i: F.when((i == F.size(s) - 1) & m.rlike(f"^{WOMAN}"), _reformed(w, TO_FEMALE, script(w))).otherwise(w)), " ")))
            .when(kind == "ip", one)
            .when(kind == "iban", _refill(m, one, "[A-Z0-9]"))
            .otherwise(_refill(m, one, "[0-9]")))


def assign(units: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, core, s): distinct surrogates for the distinct units (kind, core), none of which is itself a unit."""
    done, pending, attempt = None, stored(units), 0
    family = F.when(F.col("kind").startswith("phone"), "phone").otherwise(F.col("kind")).alias("family")
    real = stored(units.select(family, F.col("core").alias("s")).distinct())
    while True:
        drawn = pending.withColumn("s", surrogate(F.col("kind"), F.col("core"), attempt, key)).withColumn("family", family)
        ok = drawn.join(real, ["family", "s"], "left_anti")
        if done is not None:
            ok = ok.join(done.select(family, "s"), ["family", "s"], "left_anti")
        won = stored(ok.groupBy("family", "s").agg(F.min(F.struct("kind", "core")).alias("u")).select("u.kind", "u.core", "s"))
        done = won if done is None else done.unionByName(won)
        pending = stored(pending.join(won, ["kind", "core"], "left_anti"))
        if pending.isEmpty():
            return done
        attempt += 1


def replace_personal_data(docs: DataFrame, key: str = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_entities and clean_text (renamed where docs has such columns): one row per row of docs."""
    names = fresh(docs, "n_entities", "clean_text")
    rows = docs.select(F.struct("*").alias("row"), column(doc_id).alias("doc"), F.xxhash64(column(text)).alias("h"), column(text).alias("text"))
    found = rows.withColumn("m", F.coalesce(F.when(F.col("text").rlike(SIGN), F.regexp_extract_all("text", F.lit(ANY), 0)), F.array().cast("array<string>")))
    mentions = stored(found.filter(F.size("m") > 0).select("doc", "h", F.posexplode("m").alias("i", "m")).distinct().withColumn("u", units_of(F.col("m"))))
    used = mentions.select("doc", "h", "i", F.posexplode("u").alias("j", "u")).select("doc", "h", "i", "j", "u.kind", "u.core")
    units = stored(used.groupBy("kind", "core").agg(F.count("*").alias("n")))
    surrogates = stored(assign(units.select("kind", "core"), key).join(units, ["kind", "core"]))
    total = units.agg(F.sum("n")).first()[0] or 0
    placed = attach(used, surrogates, ["kind", "core"], "n", total)
    per_mention = placed.groupBy("doc", "h", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda x: x["s"]).alias("s"))
    made = (per_mention.alias("p").join(mentions.alias("m"), F.expr("p.h = m.h and p.i = m.i and p.doc <=> m.doc"))
            .select("m.doc", "m.h", "m.i", rendered(F.col("m.m"), F.col("p.s")).alias("r")))
    per_text = stored(made.groupBy("doc", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("r")))
    plain = found.filter(F.size("m") == 0).select("row.*", F.lit(0).cast("bigint").alias(names[0]), F.col("text").alias(names[1]))
    held = found.filter(F.size("m") > 0).withColumn("rest", F.split("text", ANY, -1))
    met = held.alias("a").join(per_text.alias("b"), F.expr("a.h = b.h and a.doc <=> b.doc"))
    clean = F.array_join(F.flatten(F.transform(F.col("a.rest"), lambda p, i: F.array(p, F.coalesce(F.get(F.col("b.r"), i), F.lit(""))))), "")
    return plain.unionByName(met.select("a.row.*", F.size("b.r").cast("bigint").alias(names[0]), clean.alias(names[1])))


@query("op2_surrogates")
def op2_surrogates(spark, sf_dir):
    return replace_personal_data(documents(spark, sf_dir)).select("doc_id", "n_entities", F.col("clean_text").alias("text"))
