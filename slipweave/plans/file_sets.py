"""File index, name list, manifest and routing queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from slipweave import rules as R
from slipweave.functions.text import archive_name
from slipweave.operators import files as O
from slipweave.operators.ordered import with_ordinal
from slipweave.plans.registry import query
from slipweave.session import shared_dir
from slipweave.sources import feeds, scan
from slipweave.sources.tables import documents, table

FILES = """WITH f AS (SELECT pos, name, '/store/' || (pos % 10) || '/' || name AS path, length FROM (SELECT doc_id AS pos, n_chars AS length,
  CASE WHEN doc_id % 11 = 3 THEN upper(source || '_' || (doc_id % 700)) || '.JPG' ELSE source || '_' || (doc_id % 700) || '.jpg' END AS name FROM documents)),
q AS (SELECT name, min(pos) AS pos FROM (SELECT doc_id AS pos, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'lost_' || (doc_id % 300) || '.jpg'
  ELSE source || '_' || (doc_id % 350) || '.jpg' END AS name FROM documents) WHERE name <> '' GROUP BY name)
"""


def names(spark, sf_dir):
    return O.requested_names(feeds.name_list(spark, sf_dir))


@query("src_scan_files", "SELECT source, count(*) AS n_lines, sum(length(name) + 1) AS n_bytes FROM (SELECT source, source || '_' || doc_id || '.jpg' AS name FROM documents) GROUP BY source")
def src_scan_files(spark, sf_dir):
    """Name lists written as one folder of text files per source, found again by a scan of the folders."""
    path = shared_dir(spark)
    listed = table(spark, sf_dir, "documents").select("source", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("value"))
    listed.write.partitionBy("source").text(path)
    found = scan.scan_files(spark, path, ["txt"]).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "path", "length")
    sizes = found.groupBy("source").agg(F.sum("length").alias("n_bytes"))
    lines = scan.read_name_list(spark, path).groupBy("source").agg(F.count("*").alias("n_lines"))
    return sizes.join(lines, "source")


@query("src_file_hash", "SELECT doc_id, sha256(text) AS file_hash, 'SHA256:' || sha256(text) AS stamp FROM documents")
def src_file_hash(spark, sf_dir):
    h = F.sha2("text", 256)
    return documents(spark, sf_dir, "text").select("doc_id", h.alias("file_hash"), F.concat(F.lit("SHA256:"), h).alias("stamp"))


@query("src_text_batch", "SELECT doc_id, 'slip_' || row_number() OVER (ORDER BY doc_id) AS file_name, length(text) AS n FROM documents")
def src_text_batch(spark, sf_dir):
    # the numbering moves ids and lengths, not texts
    docs = with_ordinal(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id", "no")
    return docs.select("doc_id", F.concat(F.lit("slip_"), F.col("no").cast("string")).alias("file_name"), "n")


@query("src_name_list", FILES + "SELECT name, pos, row_number() OVER (ORDER BY pos) AS no FROM q")
def src_name_list(spark, sf_dir):
    return with_ordinal(names(spark, sf_dir), "pos", "no")


@query("join_copy_plan", FILES + "SELECT f.name, f.path, f.length FROM f JOIN q ON f.name = q.name")
def join_copy_plan(spark, sf_dir):
    return feeds.files(spark, sf_dir).join(names(spark, sf_dir).select("name"), "name").select("name", "path", "length")


@query("join_missing", FILES + "SELECT name FROM q WHERE name NOT IN (SELECT name FROM f)")
def join_missing(spark, sf_dir):
    return names(spark, sf_dir).select("name").join(feeds.files(spark, sf_dir).select("name"), "name", "left_anti")


@query("join_matched_semi", FILES + "SELECT pos, path FROM f WHERE name IN (SELECT name FROM q)")
def join_matched_semi(spark, sf_dir):
    return feeds.files(spark, sf_dir).join(names(spark, sf_dir).select("name"), "name", "left_semi").select("pos", "path")


@query("join_path_override", FILES + """, i AS (SELECT name, arg_min(path, pos) AS path FROM f GROUP BY name)
SELECT q.name, coalesce(i.path, '/stored/' || q.name) AS path FROM q LEFT JOIN i ON q.name = i.name""")
def join_path_override(spark, sf_dir):
    index = O.files_per_name(feeds.files(spark, sf_dir)).select("name", "first_path")
    return names(spark, sf_dir).join(index, "name", "left").select(
        "name", F.coalesce("first_path", F.concat(F.lit("/stored/"), F.col("name"))).alias("path"))


@query("win_collision_suffix", FILES + """, h AS (SELECT f.name, f.path, '/matched/' || (f.pos % 10) || '/' || f.name AS target, q.pos AS qp, f.pos AS fp
  FROM f JOIN q ON f.name = q.name), n AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY qp, fp) AS copy_no FROM h)
SELECT name, path, copy_no, CASE WHEN copy_no = 1 THEN target ELSE left(target, length(target) - 4) || '__copy' || copy_no || right(target, 4) END AS destination FROM n""")
def win_collision_suffix(spark, sf_dir):
    return O.copy_plan(names(spark, sf_dir), feeds.files(spark, sf_dir), "/matched")


@query("agg_copy_summary", FILES + """, c AS (SELECT name, count(*) AS n FROM f GROUP BY name)
SELECT count(*) AS requested_names, CAST(sum(n) AS BIGINT) AS copied_files, count_if(n IS NULL) AS missing_names, count_if(n > 1) AS duplicate_name_groups
FROM q LEFT JOIN c USING (name)""")
def agg_copy_summary(spark, sf_dir):
    return O.copy_summary(names(spark, sf_dir), feeds.files(spark, sf_dir))


@query("agg_duplicate_names", FILES + """, d AS (SELECT lower(trim(name)) AS name, path, count(*) AS c FROM f GROUP BY ALL),
n AS (SELECT *, sum(c) OVER (PARTITION BY name) AS n, count(*) OVER (PARTITION BY name) AS n_paths FROM d)
SELECT name, CAST(n AS BIGINT) AS n, n_paths, path FROM n WHERE n > 1""")
def agg_duplicate_names(spark, sf_dir):
    """Names used more than once, case ignored, with every path: one row per name and path, so no list grows with a name."""
    return O.duplicate_names(feeds.files(spark, sf_dir))


def parts(spark, sf_dir):
    src = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.concat(F.col("url"), F.lit(".png")).alias("name"))
    art = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.when(
        F.col("item_id") % 7 == 0, "รายงาน").otherwise(F.concat(F.lit(" Report "), F.col("item_id").cast("string"), F.lit(".pdf"))).alias("name"))
    return src, art


PARTS_SQL = r"""WITH p AS (SELECT 'source' AS role, page_id AS pos, url || '.png' AS name FROM pages UNION ALL
  SELECT 'artifact', item_id, CASE WHEN item_id % 7 = 0 THEN 'รายงาน' ELSE ' Report ' || item_id || '.pdf' END FROM benchmark),
s AS (SELECT role, pos, row_number() OVER (PARTITION BY role ORDER BY pos) AS n, regexp_replace(regexp_replace(regexp_replace(trim(translate(name, '/\', '  ')),
  '\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS safe FROM p)
"""


@query("src_manifest", PARTS_SQL + "SELECT role, pos, CASE WHEN safe = '' THEN 'file-' || n ELSE safe END AS file_name FROM s")
def src_manifest(spark, sf_dir):
    return O.manifest(*parts(spark, sf_dir))


@query("set_union_artifacts", "SELECT page_id AS pos, url || '.png' AS name FROM pages UNION ALL SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'รายงาน' ELSE ' Report ' || item_id || '.pdf' END FROM benchmark")
def set_union_artifacts(spark, sf_dir):
    a, b = parts(spark, sf_dir)
    return a.unionByName(b)


@query("set_missing_except", FILES + "SELECT name FROM q EXCEPT SELECT name FROM f")
def set_missing_except(spark, sf_dir):
    return names(spark, sf_dir).select("name").exceptAll(feeds.files(spark, sf_dir).select("name").distinct())


@query("set_available_intersect", FILES + "SELECT name FROM q INTERSECT SELECT name FROM f")
def set_available_intersect(spark, sf_dir):
    return names(spark, sf_dir).select("name").intersect(feeds.files(spark, sf_dir).select("name"))


PACKAGES = """
WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '_' || doc_id WHEN 1 THEN source || ' ' || doc_id WHEN 2 THEN '-' || source WHEN 3 THEN 'a..' || doc_id || 'b'
    WHEN 4 THEN '' ELSE 'ab' END AS a, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short note' ELSE 'Evidence of case ' || (doc_id + 10000) END AS d FROM documents),
v AS (SELECT doc_id, a, list_filter([CASE WHEN a = '' THEN 'required' END, CASE WHEN a <> '' AND length(a) NOT BETWEEN 3 AND 80 THEN 'length' END,
    CASE WHEN a <> '' AND NOT regexp_full_match(a, '[A-Za-z0-9._-]{3,80}') THEN 'charset' END, CASE WHEN contains(a, '..') THEN 'dots' END,
    CASE WHEN left(a, 1) IN ('-','_','.') OR right(a, 1) IN ('-','_','.') THEN 'edges' END, CASE WHEN d IS NULL THEN 'disclaimer_required' END,
    CASE WHEN length(d) < 20 THEN 'disclaimer_short' END], lambda x: x IS NOT NULL) AS l FROM p)
"""
MESSAGES = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ARCHIVE_RULES.items()) + " END"


def packages(spark, sf_dir):
    """doc_id, archive, violations."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    k, num = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    archive = (F.when(k == 0, F.concat("source", F.lit("_"), num)).when(k == 1, F.concat("source", F.lit(" "), num))
               .when(k == 2, F.concat(F.lit("-"), F.col("source"))).when(k == 3, F.concat(F.lit("a.."), num, F.lit("b")))
               .when(k == 4, F.lit("  ")).otherwise(F.lit("ab")))
    note = (F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 4 == 1, "short note")
            .otherwise(F.concat(F.lit("Evidence of case "), (F.col("doc_id") + 10000).cast("string"))))
    return docs.select("doc_id", archive.alias("archive"), O.package_violations(archive, note).alias("violations"))


@query("val_rule_report", PACKAGES + f"""SELECT rule, n, share, coalesce({MESSAGES}, '') AS message FROM (SELECT rule, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM v) AS share
  FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['valid'] ELSE l END) AS rule FROM v) GROUP BY rule)""")
def val_rule_report(spark, sf_dir):
    return O.rule_report(packages(spark, sf_dir).select("violations")).select("rule", "n", "share", "message")


@query("val_package_rows", PACKAGES + f"SELECT doc_id, len(l) = 0 AS valid, array_to_string(l, '|') AS rules, {MESSAGES} AS message FROM (SELECT *, l[1] AS rule FROM v)")
def val_package_rows(spark, sf_dir):
    """Every package with the rules it breaks."""
    return O.package_rows(packages(spark, sf_dir)).select("doc_id", "valid", "rules", "message")


@query("prj_archive_name", r"SELECT doc_id, regexp_replace('Case ' || source || chr(9) || lang || '  No ' || doc_id, '\s+', '_', 'g') AS archive FROM documents")
def prj_archive_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    title = F.concat(F.lit("  Case "), "source", F.lit("\t"), "lang", F.lit("  No "), F.col("doc_id").cast("string"), F.lit(" "))
    return docs.select("doc_id", archive_name(title).alias("archive"))


@query("srt_path_ci", FILES + "SELECT path, lower(path) AS sort_key FROM f")
def srt_path_ci(spark, sf_dir):
    return feeds.files(spark, sf_dir).select("path", F.lower("path").alias("sort_key")).orderBy("sort_key", "path")


@query("srt_natural", FILES + """, d AS (SELECT name, CAST(CAST(regexp_extract(lower(name), '^src([0-9]+)_', 1) AS BIGINT) AS VARCHAR) AS a,
  CAST(CAST(regexp_extract(name, '_([0-9]+)[.]', 1) AS BIGINT) AS VARCHAR) AS b FROM f)
SELECT name, 'src' || length(CAST(length(a) AS VARCHAR)) || length(a) || a || '_' || length(CAST(length(b) AS VARCHAR)) || length(b) || b || '.jpg' AS sort_key FROM d""")
def srt_natural(spark, sf_dir):
    return feeds.files(spark, sf_dir).select("name", O.natural_key(F.col("name")).alias("sort_key")).orderBy("sort_key", "name")


@query("lim_max_files", FILES + "SELECT path, pos FROM f ORDER BY lower(path), pos LIMIT 50")
def lim_max_files(spark, sf_dir):
    """The smoke-run feature: only the first n files in scan order."""
    return feeds.files(spark, sf_dir).select("path", "pos").orderBy(F.lower("path"), "pos").limit(50)


@query("join_topic_route", """
WITH g AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'vibe|coding|leaderboard|arena') THEN ['coding_clip', 'leaderboard']
  WHEN regexp_matches(t, 'ocr|สลิป|slip|อ่าน|ธนาคาร') THEN ['ocr_overview', 'slip_manual', 'bank_guide']
  WHEN regexp_matches(t, 'paginator|chat|แชต|แบ่งหน้า|line') THEN ['branding', 'user_guide']
  WHEN regexp_matches(t, 'sfx|winrar|rar|package|แพ็ก') THEN ['archive_builder', 'user_guide'] ELSE ['case_evidence', 'case_overview', 'user_guide'] END AS s
  FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations))
SELECT conv_id, turn, unnest(s) AS source FROM g""")
def join_topic_route(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(O.route_topics(F.col("text"))).alias("source"))


@query("win_batch_cap", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS batch FROM documents")
def win_batch_cap(spark, sf_dir):
    """Batches of at most 500 files instead of refusing more."""
    docs = with_ordinal(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "no")
    return docs.select("doc_id", F.expr(f"(no - 1) div {R.BATCH_CAP}").alias("batch"))
