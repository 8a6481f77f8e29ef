"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its share of the output divided by its share of the corpus. A document's number of
copies is a Poisson variate with that mean, found by inverting the distribution at a uniform number hashed from seed and doc_id;
so the mixture is reproducible and needs no order. Copies are exploded and dealt out by a hash of (doc_id, copy), sorted within
partitions: a global shuffle.

Sizes are UTF-8 bytes plus one per row, so empty texts count. A source is named in ``weights`` or shares ``other`` with all
unnamed ones in proportion to size; a null source is one of its own, and weights of sources that are absent fall to the rest. Rows
that share a doc_id draw the same count. A null doc_id draws as the empty string. An empty table gives an empty mixture.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave.llm.common import column, documents, fresh, stored
from slipweave.llm.registry import query

#: Target shares of the output for the production mixture; all other sources share OTHER.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.08, "src3": 0.06}
OTHER = 0.56
SEED = "mix-1"
#: A rate above this is drawn as a sum of Poisson variates, so no term underflows.
PART = 16
#: Terms of the inverted distribution; beyond it a mean of PART or less has less mass than one step of the uniform numbers.
TERMS = 96
#: Copies of the small rate table per source: a hot source meets the rates in so many groups where they are not broadcast.
SALTS = 64


def source_rates(docs: DataFrame, weights: dict[str, float], other: float, epochs: float = 1.0, text: str = "text",
                 source: str = "source") -> DataFrame:
    """source (never null: null has is_null), n_bytes, rate."""
    sized = docs.select(F.coalesce(column(source), F.lit("")).alias("source"), column(source).isNull().alias("is_null"),
                        (F.coalesce(F.octet_length(column(text)), F.lit(0)) + 1).cast("bigint").alias("b"))
    sizes = stored(sized.groupBy("source", "is_null").agg(F.sum("b").alias("n_bytes")))
    named = F.col("source").isin(*weights) & ~F.col("is_null")
    target = F.coalesce(*[F.when((F.col("source") == k) & ~F.col("is_null"), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    # one row, whatever the number of sources
    totals = sizes.agg(F.sum("n_bytes").alias("all"), F.sum(F.when(~named, F.col("n_bytes"))).alias("rest"), F.sum(target).alias("named")).first()
    rest, whole = totals["rest"] or 0, totals["all"] or 0
    weight_sum = (totals["named"] or 0.0) + (other if rest else 0.0)
    budget = whole * epochs / weight_sum if weight_sum else 0.0
    rate = F.when(named, target * F.lit(float(budget)) / F.col("n_bytes")).otherwise(F.lit(float(other * budget / rest) if rest else 0.0))
    return sizes.select("source", "is_null", "n_bytes", rate.alias("rate"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson(rate: Column, seed: str, key: Column) -> Column:
    """Inverts the Poisson distribution of mean ``rate`` at hashed uniform numbers."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    mean = rate / parts

    def one(i: Column) -> Column:
        u = uniform(F.lit(seed), key, i.cast("string"))
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"), u.alias("u"))

        def step(s, k):
            p = s["p"] * mean / k
            return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + (s["c"] <= s["u"]).cast("int")).alias("n"), s["u"].alias("u"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["n"])
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + one(i))


def mix_sources(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, epochs: float = 1.0, seed: str = SEED,
                doc_id: str = "doc_id", text: str = "text", source: str = "source", extra: bool = True) -> DataFrame:
    """docs repeated and shuffled; with ``extra`` also copy_no, n_copies and shuffle_key (renamed where docs has such columns)."""
    rates = source_rates(docs, weights, other, epochs, text, source)
    salted = stored(rates.select("source", "is_null", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "rate").coalesce(1))
    key = F.coalesce(column(doc_id).cast("string"), F.lit(""))
    flagged = docs.select(F.struct("*").alias("row"), key.alias("key"), F.coalesce(column(source), F.lit("")).alias("source"),
                          column(source).isNull().alias("is_null"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    drawn = flagged.join(salted, ["source", "is_null", "salt"]).select("row", "key", poisson(F.col("rate"), seed, F.col("key")).alias("n"))
    copies = drawn.filter("n > 0").select("row", "key", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + "-order"), "key", F.col("copy").cast("string"))), 1, 13), 16, 10).cast("bigint")
    dealt = copies.select("row", "copy", "n", order.alias("order")).repartition(F.col("order")).sortWithinPartitions("order")
    copy_no, n_copies, shuffle_key = fresh(docs, "copy_no", "n_copies", "shuffle_key")
    added = [F.col("copy").alias(copy_no), F.col("n").alias(n_copies), F.col("order").alias(shuffle_key)] if extra else []
    return dealt.select("row.*", *added)


def mixture_sql(docs: str, columns: str, weights: dict[str, float] = WEIGHTS, other: float = OTHER, seed: str = SEED) -> str:
    """The mixture of a table or subquery in DuckDB's SQL; ``columns`` are those of docs to return."""
    values = ", ".join(f"('{k}', {w})" for k, w in weights.items())
    return f"""
WITH d AS (SELECT * FROM {docs}),
w(source, w) AS (VALUES {values}),
sizes AS (SELECT coalesce(source, '') AS s, source IS NULL AS is_null, sum(strlen(coalesce(text, '')) + 1) AS b FROM d GROUP BY ALL),
t AS (SELECT sizes.*, w.w FROM sizes LEFT JOIN w ON sizes.s = w.source AND NOT is_null),
g AS (SELECT sum(b) AS whole, coalesce(sum(b) FILTER (w IS NULL), 0) AS rest, coalesce(sum(w), 0) AS named FROM t),
r AS (SELECT s, is_null, CASE WHEN w IS NOT NULL THEN w::DOUBLE * (whole / (named::DOUBLE + CASE WHEN rest > 0 THEN {other} ELSE 0 END)::DOUBLE) / b
             ELSE {other}::DOUBLE * (whole / (named::DOUBLE + {other})::DOUBLE) / rest END::DOUBLE AS rate FROM t, g),
p AS (SELECT s, is_null, greatest(ceil(rate / {PART}), 1)::BIGINT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS mean FROM r),
c AS (SELECT s, is_null, parts, list_transform(range(0, {TERMS}), lambda k: list_sum(list_transform(range(0, k + 1),
             lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1.0))))) AS cdf FROM p WHERE mean > 0),
n AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda x: x <=
             (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || i::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)))) AS n_copies
      FROM d JOIN c ON coalesce(d.source, '') = c.s AND (d.source IS NULL) = c.is_null),
e AS (SELECT *, unnest(range(1, n_copies::BIGINT + 1)) AS copy_no FROM n WHERE n_copies > 0)
SELECT {columns}, copy_no::INT AS copy_no, n_copies::INT AS n_copies,
       ('0x' || substr(md5('{seed}-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no::VARCHAR), 1, 13))::BIGINT AS shuffle_key FROM e"""


@query("op1_mix_sources", mixture_sql("documents", "doc_id, text, lang, source, n_chars"))
def op1_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir))
