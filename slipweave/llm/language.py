"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior per row:

* text: log-likelihoods of hashed letter trigrams under one multinomial model per language. The models are summed over all rows whose
  declared language is one of ``languages``. Trigrams of a text are far from independent, so a text counts as at most TEMPER of them;
* markup: the declared language, right with probability DECLARED_TRUST;
* address suffix: a country suffix of the host points to its language with probability SUFFIX_TRUST;
* host: a prior smoothed along host, registrable domain, suffix and the whole corpus. Each level is a grouped sum of the rows' text
  likelihoods and leans on the next one with PSEUDO rows; a row is left out of its own host's sum.

Which of the languages fits best says nothing of a text in none of them. So each text is also held against what its best model expects of its own texts: a model gains so many nats
per trigram over the guess that all trigrams are alike, and where the mean log-likelihood of a text falls short of the model's own by more than MAX_SHORTFALL times that gain,
the text is in another language. Texts with fewer than MIN_GRAMS trigrams are too short to tell.

A row is kept when its text has letters, the fused language is accepted and has a probability of at least MIN_CONFIDENCE.
Null and letterless texts and texts in another language have language 'und', confidence zero, and are not kept. A missing or unknown declaration, host or suffix is no evidence; rows
without a host share the corpus prior. Ties go to the language that is named first. Repeated rows are judged alike. An empty
table, or one without declared languages, has uniform text models.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slipweave.functions.text import let
from slipweave.llm.common import attach, buffer_of, column, documents, stored
from slipweave.llm.registry import query

LANGUAGES = ("en", "de", "fr", "es")
#: Hash buckets of trigrams, and the pseudo count of each.
BUCKETS, ALPHA = 1 << 14, 0.5
TEMPER = 100.0
DECLARED_TRUST, SUFFIX_TRUST = 0.8, 0.7
PSEUDO = 20.0
MIN_CONFIDENCE = 0.5
#: How far a text may fall short of its model, in parts of the model's gain, and trigrams from which on that is judged.
MAX_SHORTFALL, MIN_GRAMS = 1.35, 30
#: Country suffixes and their language: fixed values.
SUFFIXES = {"at": "de", "au": "en", "be": "fr", "ch": "de", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en",
            "mx": "es", "nz": "en", "pe": "es", "uk": "en", "us": "en"}
#: Bytes of text whose trigrams are made at a time.
PART = 1 << 20
#: Soft counts are summed as whole millionths, so sums do not depend on order.
UNIT = 1_000_000
#: ASCII letters in lower case; other ASCII is a blank; bytes of other characters stay.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the trigrams of folded bytes that hold a letter in the middle or at both ends, and their row numbers, in parts of bounded size."""
    for lo in range(0, len(data) - 2, PART):
        folded = FOLD[data[lo:lo + PART + 2]].astype(np.uint32)
        a, b, c = folded[:-2], folded[1:-1], folded[2:]
        bucket = ((a * np.uint32(2654435761) + b * np.uint32(40503) + c * np.uint32(2246822519)) >> np.uint32(7)) % np.uint32(BUCKETS)
        first, last = (int(x) for x in np.searchsorted(offsets, [lo, lo + len(folded)], side="right") - 1)
        ends = np.clip(offsets[first:last + 2], lo, lo + len(folded)) - lo
        row = np.repeat(np.arange(first, first + len(ends) - 1), np.diff(ends))
        good = (row[:-2] == row[2:]) & ((b != 32) | ((a != 32) & (c != 32)))
        yield bucket[good].astype(np.int64), row[:-2][good]


def trigram_counts(texts: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(lang, bucket, n) summed over all rows of texts (lang, text) with one of the languages."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        table = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            lang = np.array([languages.index(x) for x in batch.column(0).to_pylist()], dtype=np.int64)
            for bucket, row in trigrams(data, offsets):
                table += np.bincount(lang[row] * BUCKETS + bucket, minlength=table.size).reshape(table.shape)
        lang, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([languages[i] for i in lang], pa.string()), pa.array(bucket), pa.array(table[lang, bucket])], names=["lang", "bucket", "n"])
    known = texts.filter(F.col("lang").isin(*languages)).select("lang", "text")
    return known.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log-probabilities, languages by buckets: a table of fixed size."""
    table = np.full((len(languages), BUCKETS), ALPHA)
    for lang, bucket, n in counts.select("lang", "bucket", "n").collect():
        table[languages.index(lang), bucket] += n
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_likelihoods(texts: DataFrame, model: np.ndarray) -> DataFrame:
    """texts (id, declared, host, text) with ll, the tempered log-likelihoods, n_grams, and short, how far the mean falls short of the best model's in parts of its gain, instead of the text."""
    import pyarrow as pa

    expected = (np.exp(model) * model).sum(axis=1)
    gain = np.maximum(expected + np.log(BUCKETS), 1e-6)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            data, offsets = buffer_of(batch.column(3))
            rows = len(batch)
            n, sums = np.zeros(rows, np.int64), np.zeros((rows, len(model)))
            for bucket, row in trigrams(data, offsets):
                n += np.bincount(row, minlength=rows)
                for k, logp in enumerate(model):
                    sums[:, k] += np.bincount(row, weights=logp[bucket], minlength=rows)
            short = ((expected - sums / np.maximum(n, 1)[:, None]) / gain).min(axis=1)
            sums *= np.minimum(1.0, TEMPER / np.maximum(n, 1))[:, None]
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * len(model), len(model), dtype=np.int32)), pa.array(np.round(sums, 6).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ll, pa.array(n), pa.array(np.round(short, 6))], names=["id", "declared", "host", "ll", "n_grams", "short"])
    kinds = dict(texts.dtypes)
    return texts.mapInArrow(run, f"id {kinds['id']}, declared string, host string, ll array<double>, n_grams bigint, short double")


def _soft(ll: Column) -> Column:
    """Probabilities of an array of log values; the array is evaluated once."""
    def scaled(v: Column) -> Column:
        return F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return let(ll, lambda v: let(scaled(v), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda t: F.transform(e, lambda x: x / t))))


def _units(p: Column) -> Column:
    return F.transform(p, lambda x: F.round(x * UNIT).cast("bigint"))


def _sums(k: int, n: str = "n", of: str = "units") -> list[Column]:
    return [F.sum(n).alias("n"), F.array(*[F.sum(F.col(of)[i]) for i in range(k)]).alias("units")]


def _smooth(units: Column, n: Column, below: Column) -> Column:
    return F.zip_with(units, below, lambda u, p: (u / UNIT + PSEUDO * p) / (n + PSEUDO))


def registrable(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def host_priors(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """(host, n, units, below): the soft counts of each host and the smoothed distribution of its domain; and the corpus prior."""
    hosts = stored(rows.filter("host is not null and n_grams > 0").select("host", F.lit(1).alias("one"), _units(_soft(F.col("ll"))).alias("units"))
                   .groupBy("host").agg(*_sums(k, "one")).withColumn("domain", registrable(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    n_hosts = hosts.count()
    domains = stored(hosts.groupBy("domain", "suffix").agg(*_sums(k), F.count("*").alias("hosts")))
    suffixes = stored(domains.groupBy("suffix").agg(*_sums(k), F.count("*").alias("domains")))
    whole = suffixes.agg(*_sums(k)).first()
    total = whole["n"] or 0
    corpus = [((whole["units"][i] or 0) / UNIT + 1.0) / (total + k) for i in range(k)]
    top = F.array(*[F.lit(p) for p in corpus])
    of_suffix = stored(suffixes.select("suffix", "domains", _smooth(F.col("units"), F.col("n"), top).alias("p")))
    of_domain = stored(attach(domains, of_suffix, ["suffix"], "domains", n_hosts)
                       .select("domain", "hosts", _smooth(F.col("units"), F.col("n"), F.col("p")).alias("p")))
    return attach(hosts.drop("suffix"), of_domain, ["domain"], "hosts", n_hosts).select("host", "n", "units", F.col("p").alias("below")), corpus


def identify(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, accepted: tuple[str, ...] | None = None,
             min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """id, lang, confidence, text_lang, n_grams, kept for rows (id, text, declared, host): one row per row.

    declared is a language tag as in markup; host a host name or any other name of a source.
    """
    k = len(languages)
    clean = rows.select("id", F.lower(F.split(F.trim("declared"), "[-_]")[0]).alias("declared"), F.lower(F.trim("host")).alias("host"), F.col("text").cast("string").alias("text"))
    model = text_model(trigram_counts(clean.select(F.col("declared").alias("lang"), "text"), languages), languages)
    scored = stored(text_likelihoods(clean, model))
    priors, corpus = host_priors(scored, k)
    priors = stored(priors)
    total = scored.count()
    with_host = attach(scored.filter("host is not null"), priors, ["host"], "n", total)
    none = F.lit(None)
    alone = scored.filter("host is null").select("*", none.cast("bigint").alias("n"), none.cast("array<bigint>").alias("units"), none.cast("array<double>").alias("below"))
    met = with_host.unionByName(alone)
    own = F.when(F.col("n_grams") > 0, _units(_soft(F.col("ll")))).otherwise(F.array(*[F.lit(0).cast("bigint")] * k))
    rest = F.zip_with("units", own, lambda a, b: a - b)
    n_rest = F.col("n") - (F.col("n_grams") > 0).cast("int")
    prior = F.coalesce(_smooth(rest, n_rest, F.col("below")), F.array(*[F.lit(p) for p in corpus]))

    def pointing(language: Column, trust: float) -> Column:
        """Log-likelihoods of a sign that names a language; zero where it names none of them."""
        miss = (1 - trust) / max(k - 1, 1)
        values = [F.when(language.isin(*languages), F.when(language == x, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log(miss))))).otherwise(F.lit(0.0)) for x in languages]
        return F.array(*values)
    country = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), suffix_of(F.coalesce("host", F.lit(""))))
    fused = met.select("id", "ll", "n_grams", "short", F.transform(prior, lambda p: F.log(p)).alias("a"), pointing(F.coalesce("declared", F.lit("")), DECLARED_TRUST).alias("b"),
                       pointing(F.coalesce(country, F.lit("")), SUFFIX_TRUST).alias("c"))
    fused = fused.select("id", "ll", "n_grams", "short", _soft(F.transform(F.arrays_zip("ll", "a", "b", "c"), lambda s: s["ll"] + s["a"] + s["b"] + s["c"])).alias("p"))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda a: names[(F.array_position(a, F.array_max(a)) - 1).cast("int")]
    known = (F.col("n_grams") > 0) & ((F.col("n_grams") < MIN_GRAMS) | (F.col("short") <= MAX_SHORTFALL))
    out = fused.select("id", F.when(known, best(F.col("p"))).otherwise("und").alias("lang"), F.when(known, F.round(F.array_max("p"), 6)).otherwise(0.0).alias("confidence"),
                       F.when(known, best(F.col("ll"))).otherwise("und").alias("text_lang"), "n_grams")
    return out.withColumn("kept", F.col("lang").isin(*(accepted or languages)) & (F.col("confidence") >= min_confidence))


def keep_identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, doc_id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source",
                    min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of docs whose language is identified. Rows are met by doc_id and text, so repeated ids do not mix."""
    same = F.struct(column(doc_id).alias("doc"), F.xxhash64(column(text)).alias("h"), column(declared).alias("d"), column(host).alias("s"))
    judged = identify(docs.select(F.to_json(same, {"ignoreNullFields": "false"}).alias("id"), column(text).alias("text"), column(declared).alias("declared"), column(host).alias("host")),
                      languages, min_confidence=min_confidence)
    gone = judged.filter(~F.col("kept")).select("id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.to_json(same, {"ignoreNullFields": "false"}).alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")


def page_rows(pages: DataFrame) -> DataFrame:
    """(id, text, declared, host) of pages (page_id, url, html)."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1), F.lit(""))
    host = F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), declared.alias("declared"), host.alias("host"))


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    """Documents: their declared language, and their source in place of a host."""
    docs = documents(spark, sf_dir)
    return identify(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))).withColumnRenamed("id", "doc_id")


@query("lid_pages")
def lid_pages(spark, sf_dir):
    """Web pages: markup language, address suffix and host."""
    return identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("id", "page_id")
