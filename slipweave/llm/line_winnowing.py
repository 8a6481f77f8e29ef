"""Line dedup by winnowing over line hashes.

A run is RUN or more consecutive lines (lines without a word are passed over and never removed). Fingerprints of a text are the
least line hash of every RUN consecutive lines, the rightmost one of equals; so two texts that share a run share a fingerprint in it.
Fingerprints that occur once are dropped after a grouped count. Around the positions of the others, matches are extended both ways to every
window of RUN lines that holds the position; overlapping windows make up the longest match. A window is a later repeat when an equal one
stands earlier in (doc_id, text, position) order and does not overlap it. All lines of later repeats are deleted, the first run stays.

Lines are equal when equal without ASCII blanks at their ends. Null counts as one empty line. Rows that share doc_id and text are one
document: they are changed alike and do not count as repeats of each other. Texts with fewer than RUN lines are left alone.

With ``long_words`` the shortest run depends on its length: fewer than RUN consecutive lines are a run as well if they have that many words together, so
a passage on one or two lines goes too, also from texts with fewer than RUN lines. All such windows are counted; the same rule tells the later repeats.
op3_line_winnowing is without it, as its SQL says; op3_long_lines is with it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave.llm.common import attach, column, documents, fresh, sieve, stored
from slipweave.llm.registry import query

#: Lines of the shortest run, which is also the winnowing window.
RUN = 3
#: Words that make fewer lines than RUN a run.
LONG_WORDS = 50
BLANKS = r"[\x20\x09-\x0D]+"
EDGE_BLANKS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    full = F.coalesce(column(text), F.lit(""))
    return docs.select(column(doc_id).alias("doc"), F.xxhash64(full).alias("h"), F.split(full, "\n").alias("lines"))


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, v, u, at): two hashes of each line with a word, and the places of these lines in the text."""
    hashed = F.transform("lines", lambda x, i: F.struct(F.regexp_replace(x, EDGE_BLANKS, "").alias("x"), i.alias("at")))
    worded = F.transform(F.filter(hashed, lambda s: s["x"] != ""), lambda s: F.struct(F.xxhash64(s["x"]).alias("v"), F.xxhash64(F.lit(1), s["x"]).alias("u"), s["at"].alias("at")))
    return _keyed(docs, doc_id, text).select("doc", "h", worded.alias("w")).select("doc", "h", F.col("w.v").alias("v"), F.col("w.u").alias("u"), F.col("w.at").alias("at"))


def long_windows(docs: DataFrame, run: int, long_words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, s, x, y, at): the windows of ``run`` lines with a word that have at least ``long_words`` words."""
    lines = F.filter(F.transform("lines", lambda x, i: F.struct(F.regexp_replace(x, EDGE_BLANKS, "").alias("x"), i.alias("at"))), lambda s: s["x"] != "")
    counted = F.transform(lines, lambda s: F.struct(F.xxhash64(s["x"]).alias("v"), F.xxhash64(F.lit(1), s["x"]).alias("u"), s["at"].alias("at"), F.size(F.split(s["x"], BLANKS)).alias("n")))
    rows = _keyed(docs, doc_id, text).dropDuplicates(["doc", "h"]).select("doc", "h", counted.alias("w")).filter(F.size("w") >= run)
    at = F.sequence(F.lit(0), F.size("w") - run)
    enough = F.filter(at, lambda s: F.aggregate(F.slice("w", s + 1, run), F.lit(0).cast("bigint"), lambda a, w: a + w["n"]) >= long_words)
    cut = rows.select("doc", "h", "w", F.explode(enough).alias("s")).withColumn("c", F.slice("w", F.col("s") + 1, run))
    return cut.select("doc", "h", "s", F.xxhash64("c.v").alias("x"), F.xxhash64("c.u").alias("y"), F.col("c.at").alias("at"))


def winnowed(v: Column, run: int) -> Column:
    """Places of the fingerprints in an array of hashes with at least ``run`` elements."""
    marked = F.transform(v, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    least = F.transform(F.sequence(F.lit(1), F.size(v) - (run - 1)), lambda s: -F.array_min(F.slice(marked, s, run))["i"])
    return F.array_distinct(least)


def repeated_lines(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, gone): places of the lines of later repeats, for the texts that have any."""
    hashes = stored(line_hashes(docs, doc_id, text).filter(F.size("v") >= run))
    prints = stored(hashes.select("doc", "h", "v", F.explode(winnowed(F.col("v"), run)).alias("i")).select("doc", "h", "i", F.col("v")[F.col("i")].alias("x")))
    total = prints.count()
    shared = stored(prints.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1"))
    places = attach(prints, shared, ["x"], "n", total).filter("n is not null").groupBy("doc", "h").agg(F.collect_set("i").alias("places"))
    # each text's own windows around its shared fingerprints
    near = F.array_distinct(F.flatten(F.transform("p.places", lambda i: F.sequence(F.greatest(i - (run - 1), F.lit(0)), F.least(i, F.size("a.v") - run)))))
    windows = stored(hashes.dropDuplicates(["doc", "h"]).alias("a").join(places.alias("p"), F.expr("a.h = p.h and a.doc <=> p.doc"))
                     .select("a.doc", "a.h", "a.v", "a.u", "a.at", F.explode(near).alias("s"))
                     .select("doc", "h", "s", F.xxhash64(F.slice("v", F.col("s") + 1, run)).alias("x"), F.xxhash64(F.slice("u", F.col("s") + 1, run)).alias("y"), F.slice("at", F.col("s") + 1, run).alias("at")))
    return _later(windows, run).groupBy("doc", "h").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))


def _later(windows: DataFrame, run: int) -> DataFrame:
    """The stored windows that are later repeats; windows are equal when both their hashes are."""
    firsts = stored(windows.groupBy("x", "y").agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "s")).alias("first")).filter("n > 1"))
    met = attach(windows, firsts, ["x", "y"], "n", windows.count())
    later = met.filter(~F.col("doc").eqNullSafe(F.col("first.doc")) | (F.col("h") != F.col("first.h")) | (F.col("s") >= F.col("first.s") + run))
    return later.filter("n is not null").select("doc", "h", "at")


def repeated_passages(docs: DataFrame, run: int, long_words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """repeated_lines with the runs of fewer than ``run`` lines that have at least ``long_words`` words."""
    gone = repeated_lines(docs, run, doc_id, text)
    for lines in range(1, run):
        gone = gone.unionByName(_later(stored(long_windows(docs, lines, long_words, doc_id, text)), lines).withColumnRenamed("at", "gone"))
    return gone.groupBy("doc", "h").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def delete_repeats(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """docs with n_lines, n_removed and kept_text (renamed where docs has such columns): one row per row of docs.

    Texts that lose no line pass without a shuffle, but for the few that a Bloom filter of the others' keys lets through.
    """
    gone = stored(repeated_lines(docs, run, doc_id, text) if long_words is None else repeated_passages(docs, run, long_words, doc_id, text))
    names = fresh(docs, "n_lines", "n_removed", "kept_text")

    def result(rows: DataFrame, lost: Column, kept: Column) -> DataFrame:
        return rows.select("row", F.size("lines").cast("bigint").alias("a"), lost.cast("bigint").alias("b"), kept.alias("c")).select(
            "row.*", *[F.col(c).alias(n) for c, n in zip("abc", names, strict=True)])
    rows = docs.select(F.struct("*").alias("row"), column(doc_id).alias("doc"), F.xxhash64(F.coalesce(column(text), F.lit(""))).alias("h"))
    may, rest = sieve(rows, gone, ["doc", "h"], gone.count())
    # the same join at any size, so that what moves grows with the texts that are changed
    met = may.alias("r").join(gone.alias("g").hint("merge"), F.expr("r.h = g.h and r.doc <=> g.doc"), "left").select("row", "gone")
    full = F.coalesce(F.col("row").getField(text), F.lit("")).alias("full")
    met, rest = (df.select("*", full).withColumn("lines", F.split("full", "\n")) for df in (met, rest))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    kept = F.when(F.col("gone").isNull(), F.col("full")).otherwise(F.array_join(left, "\n"))
    return result(rest, F.lit(0), F.col("full")).unionByName(result(met, F.coalesce(F.size("gone"), F.lit(0)), kept))


@query("op3_line_winnowing", f"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
w AS (
  SELECT doc_id, pos, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS x FROM l
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
n AS (SELECT doc_id, pos, x, row_number() OVER d - 1 AS i, lead(pos, 1) OVER d AS pos1, lead(pos, 2) OVER d AS pos2,
             x || chr(10) || lead(x, 1) OVER d || chr(10) || lead(x, 2) OVER d AS run FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, first_value(doc_id) OVER o AS first_doc, first_value(i) OVER o AS first_i FROM n WHERE pos2 IS NOT NULL
      WINDOW o AS (PARTITION BY run ORDER BY doc_id, i)),
r AS (SELECT * FROM f WHERE doc_id <> first_doc OR i >= first_i + {RUN}),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos1, pos2]) AS pos FROM r)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id""")
def op3_line_winnowing(spark, sf_dir):
    return delete_repeats(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_long_lines")
def op3_long_lines(spark, sf_dir):
    out = delete_repeats(documents(spark, sf_dir), long_words=LONG_WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
