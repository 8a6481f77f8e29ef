"""The trie of conversation prefixes, rolled up by depth bands.

A conversation is a path of turns (role, text); each distinct sequence of first d turns is a node, the textless root has depth 0. A prefix is known by its
depth and two sums of 64-bit hashes of (place, role, MD5 of the text), which are running totals over blocks of turns: no conversation is gathered in one task.

Totals over subtrees come from bands of BAND depths. Each node lists its ancestors within its band, which the rows of any one conversation through it hold
(at most BAND of them), and is exploded to these only. That completes all bands by themselves. The roots of bands then form a trie of their own with a
BAND-th of the depth, whose nodes hold the totals of their bands; it is rolled up in the same way, and the completed totals of the band
roots are added to the ancestors of their parents in the band above. So a trie of depth D takes log(D) / log(BAND) rounds, and every round
explodes a row to at most BAND rows.

Turns are ordered by turn (null first), then role and text; null role or text counts as empty. Rows that repeat are turns of their own. Rows without conversation
belong to none and are left out; conversations that are left without turns are members of the root. An empty table has no node.
The numbers of the conversations that end in a node go into its digest in order: they are joined in pieces of up to ENDS numbers, and the pieces are streamed
through the hash, so a node where any share of all conversations ends takes constant memory.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from slipweave.llm.common import attach, column, sieve, stored
from slipweave.llm.registry import query
from slipweave.operators.ordered import running_total, with_ordinal

#: Depths of a band.
BAND = 8
#: Conversations of the contract share the head of the first one of a family of FAMILY numbers, up to HEAD - 1 turns.
FAMILY, HEAD = 20, 4
#: Width of the pieces of numbers that end in a node.
ENDS = 4096
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "p", "q"]


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, role, digest, words): the turns of every conversation, counted from 1, with a digest and the number of words in place of the text.

    Texts move only where several turns of a conversation have the same number, to put these in order.
    """
    rows = turns.filter(column(conv_id).isNotNull()).select(column(conv_id).alias("conv_id"), column(turn).alias("turn"),
                                                            F.coalesce(column(role), F.lit("")).alias("role"), F.coalesce(column(text), F.lit("")).alias("text"))
    told = ["conv_id", "turn", "role", F.md5("text").alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")]
    none = F.lit(None).cast("string").alias("tie")
    same = stored(rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1"))
    n_same = same.count()
    if not n_same:
        keyed = rows.select(*told, none)
    else:
        may, rest = sieve(rows, same, ["conv_id", "turn"], n_same)
        met = may.alias("m").join(same.alias("s").hint("merge"), F.expr("m.conv_id = s.conv_id and m.turn <=> s.turn"), "left").select("m.*", "n")
        keyed = rest.select(*told, none).unionByName(met.select(*told, F.when(F.col("n").isNotNull(), F.col("text")).alias("tie")))
    return with_ordinal(keyed, "turn", "at", ["conv_id"], then=["role", "tie"]).select("conv_id", "at", "role", "digest", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """The conversations with the first h turns of the first of their family in place of their own, h = crc32(conv_id) % head.

    Returns (conv_id, at, role, digest, words) and (conv_id, length) of all conversations, also of those without turns.
    """
    turns, told = stored(turns), ["role", "digest", "words"]
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % head
    convs = stored(own.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % family))
    of_first = convs.filter("conv_id = first").select("first", F.col("own").alias("n_first"))
    lent = F.least("h", F.coalesce("n_first", F.lit(0)))
    convs = stored(convs.join(of_first, "first", "left").select("conv_id", "first", "own", "h", lent.alias("lent")).withColumn(
        "length", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    # at most head - 1 turns a conversation, lent to at most ``family`` of them
    heads = turns.filter(F.col("at") < head).select(F.col("conv_id").alias("first"), "at", *told)
    borrowed = heads.join(convs.select("conv_id", "first", "lent"), "first").filter("at <= lent").select("conv_id", "at", *told)
    kept = attach(turns, convs.select("conv_id", "own", "h", "lent"), ["conv_id"], "own", turns.count()).filter("at > h")
    kept = kept.select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), *told)
    return borrowed.unionByName(kept), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, up_p, up_q, words, ends): one stored row per conversation and depth, the root included, and one that says where it ends."""
    # a row behind the last turn has the hashes of the whole conversation, so no join is needed to tell where it ends
    behind = lengths.select("conv_id", (F.col("length") + 1).alias("at"), *[F.lit(None).cast("string").alias(c) for c in ("role", "digest")], F.lit(0).cast("bigint").alias("words"))
    lane = lambda k: F.xxhash64(F.lit(k), "at", "role", "digest").cast("decimal(20,0)")
    rows = turns.unionByName(behind).select("conv_id", F.col("at").cast("bigint").alias("at"), F.col("digest").isNull().alias("over"), "words",
                                            *[F.when(F.col("digest").isNull(), F.lit(0)).otherwise(lane(k)).cast("decimal(20,0)").alias(f"l{k}") for k in (1, 2)])
    summed = running_total(rows, ["conv_id"], "at", {"s1": F.col("l1"), "s2": F.col("l2")})
    small = lambda c: (c % F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("bigint")
    own = summed.select("conv_id", F.col("at").alias("depth"), "over", "words", small(F.col("s1")).alias("p"), small(F.col("s2")).alias("q"),
                        small(F.col("s1") - F.col("l1")).alias("up_p"), small(F.col("s2") - F.col("l2")).alias("up_q"))
    placed = own.select("conv_id", (F.col("depth") - F.col("over").cast("int")).alias("depth"), "p", "q", "up_p", "up_q", "words", F.col("over").alias("ends"))
    root = [F.lit(v).cast("bigint").alias(c) for c, v in (("depth", 0), ("p", 0), ("q", 0), ("up_p", None), ("up_q", None), ("words", 0))]
    return stored(placed.unionByName(lengths.select("conv_id", *root, F.lit(False).alias("ends"))))


def _name(*cols: str) -> Column:
    return F.struct(*[F.col(c).alias(k) for c, k in zip(cols, KEY, strict=True)])


def _paths(rows: DataFrame, step: int, band: int) -> DataFrame:
    """(depth, p, q, path): the ancestors of the nodes within their bands, themselves last, where a band is ``band`` depths of every ``step``-th."""
    place = F.floor(F.col("depth") / F.lit(step * band))
    window = W.partitionBy("conv_id", place).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    held = rows.filter(F.col("depth") % step == 0).withColumn("path", F.collect_list(_name(*KEY)).over(window))
    return held.groupBy(*KEY).agg(F.first("path").alias("path"))


def subtree_totals(rows: DataFrame, nodes: DataFrame, deepest: int, names: list[str], band: int = BAND, step: int = 1) -> DataFrame:
    """(depth, p, q, totals): sums of the columns ``names`` of the stored nodes over their subtrees.

    ``rows`` (conv_id, depth, p, q) are the places of all conversations, ``nodes`` (depth, p, q, up, names) the nodes at multiples of ``step``, ``up`` the key of the parent among these.
    """
    paths = stored(_paths(rows, step, band))
    sums = [F.sum(n).alias(n) for n in names]
    spread = nodes.join(paths, KEY).select(F.explode("path").alias("to"), *names)
    inside = stored(spread.groupBy("to").agg(*sums).select("to.*", *names))
    if deepest < step * band:
        return inside
    # the trie of the band roots: the parent of a band root is the first of its parent's path
    roots = nodes.filter(F.col("depth") % (step * band) == 0).select(*KEY, "up").join(inside, KEY)
    above = paths.select(_name(*KEY).alias("up"), "path")
    roots = stored(roots.join(above, "up", "left").select(*KEY, "path", F.col("path")[0].alias("top"), *names))
    whole = subtree_totals(rows, roots.select(*KEY, F.col("top").alias("up"), *names), deepest, names, band, step * band)
    met = stored(whole.join(roots.select(*KEY, "path"), KEY).filter("path is not null"))
    further = met.select(F.explode("path").alias("to"), *names).groupBy("to").agg(*sums).select("to.*", *names)
    return stored(inside.unionByName(further).groupBy(*KEY).agg(*sums))


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, p, q, ends_sha256) from the rows (depth, p, q, conv_id) of conversations that end in a node."""
    import pyarrow as pa

    piece = ends.groupBy(*KEY, F.floor(F.col("conv_id") / ENDS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_set("conv_id")), ",").alias("ids"))

    def run(batches: Iterator) -> Iterator:
        last, digest = None, None

        def record(found):
            keys = list(zip(*[k for k, _ in found], strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array([d for _, d in found])], names=[*KEY, "ends_sha256"])
        for batch in batches:
            done = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield record(done)
        if last is not None:
            yield record([(last, digest.hexdigest())])
    return (piece.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
            .mapInArrow(run, "depth bigint, p bigint, q bigint, ends_sha256 string"))


def prefix_trie(turns: DataFrame, lengths: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, at, role, digest, words) count from 1 without gaps; ``lengths`` (conv_id, length) has all conversations.
    """
    rows = prefixes(turns, lengths)
    there = rows.filter("not ends")
    up = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")))
    nodes = stored(there.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.first(up).alias("up")))
    children = nodes.filter("up is not null").groupBy("up").agg(F.count("*").alias("n_children")).select("up.*", "n_children")
    named = nodes.select(F.struct(*KEY).alias("up"), F.col("conv_id").alias("parent_conv_id"))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves")
    known = stored(nodes.join(children, KEY, "left").join(named, "up", "left").select(
        *KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "up", saved, leaf))
    deepest = known.agg(F.max("depth")).first()[0] or 0
    totals = subtree_totals(there.select("conv_id", *KEY), known, deepest, ["n_leaves", "saved_tokens"], band)
    digests = _digests(rows.filter("ends").select(*KEY, "conv_id"))
    out = known.drop("n_leaves", "saved_tokens").join(totals, KEY).join(digests, KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


_BIT = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"


@query("op13_prefix_trie", f"""
WITH o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {FAMILY} AS first, count(*) AS own,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {_BIT}), 4294967295) % {HEAD} AS h
  FROM o GROUP BY conv_id),
n AS (SELECT c.*, least(h, coalesce(f.own, 0)) AS lent FROM c LEFT JOIN (SELECT conv_id AS id, own FROM c) f ON f.id = c.first),
t AS (SELECT n.conv_id, pos, role, text FROM n JOIN o ON o.conv_id = n.first AND pos <= n.lent UNION ALL SELECT n.conv_id, pos - h + lent, role, text FROM n JOIN o ON o.conv_id = n.conv_id AND pos > h),
l AS MATERIALIZED (SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS x FROM c LEFT JOIN t USING (conv_id) GROUP BY c.conv_id),
p AS MATERIALIZED (SELECT conv_id, d, len(x) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(x[d].t, '[^\\x20\\x09-\\x0D]+')) END AS words, sha256(CAST(to_json(x[:d]) AS VARCHAR)) AS k
  FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM l)),
g AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM p GROUP BY k, d),
e AS MATERIALIZED (SELECT g.k AS child, p.k AS parent FROM g JOIN p ON p.conv_id = g.conv_id AND p.d = g.d - 1),
z AS MATERIALIZED (SELECT parent AS k, count(*) AS n_children FROM e GROUP BY parent),
s AS (SELECT p.k, sum(CASE WHEN z.k IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((g.n - 1) * g.words) AS saved FROM g JOIN p ON p.conv_id = g.conv_id AND p.d <= g.d LEFT JOIN z ON z.k = g.k GROUP BY p.k)
SELECT g.conv_id, g.d AS depth, u.conv_id AS parent_conv_id, g.n AS n_convs, coalesce(z.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN s USING (k) LEFT JOIN z USING (k) LEFT JOIN e ON e.child = g.k LEFT JOIN g u ON u.k = e.parent""")
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(*rebuilt(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
