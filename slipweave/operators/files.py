"""File lists, copy plans, manifests and name rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave import rules as R
from slipweave.functions.text import strip
from slipweave.operators.ordered import with_ordinal


def requested_names(name_lines: DataFrame) -> DataFrame:
    """name, pos: trimmed, non-empty, distinct names at their first position."""
    return (name_lines.select("pos", strip(F.col("line")).alias("name")).filter("name <> ''")
            .groupBy("name").agg(F.min("pos").alias("pos")))


def copy_plan(names: DataFrame, files: DataFrame, dest: str) -> DataFrame:
    """All paths of every requested name with their destination; the nth file for one destination
    (case ignored) gets a ``__copyN`` suffix."""
    hits = files.select("name", "path", F.col("pos").alias("file_pos")).join(names.select("name", F.col("pos").alias("name_pos")), "name")
    relative = F.concat(F.lit(dest), F.regexp_replace("path", "^/[^/]+", ""))
    rows = hits.select("name", "path", relative.alias("target"), F.lower(relative).alias("_key"), "name_pos", "file_pos")
    numbered = with_ordinal(rows, "name_pos", "copy_no", ["_key"], then=["file_pos"])
    return numbered.select("name", "path", F.when(F.col("copy_no") == 1, F.col("target")).otherwise(
        F.concat(F.regexp_replace("target", r"\.[^./]*$", ""), F.lit("__copy"), F.col("copy_no").cast("string"),
                 F.regexp_extract("target", r"(\.[^./]*)$", 1))).alias("destination"), "copy_no")


def files_per_name(files: DataFrame) -> DataFrame:
    return files.groupBy("name").agg(F.count("*").alias("n"), F.min_by("path", "pos").alias("first_path"))


def copy_summary(names: DataFrame, files: DataFrame) -> DataFrame:
    """requested, copied, missing and names with several files, from one joined count table."""
    joined = names.join(files_per_name(files).select("name", "n"), "name", "left")
    return joined.agg(F.count("*").alias("requested_names"), F.coalesce(F.sum("n"), F.lit(0)).alias("copied_files"),
                      F.count_if(F.col("n").isNull()).alias("missing_names"), F.count_if(F.col("n") > 1).alias("duplicate_name_groups"))


def safe_name(name: Column) -> Column:
    """Path separators become blanks, blanks underscores, other characters go, edge dots and underscores too."""
    joined = F.regexp_replace(F.trim(F.translate(name, "/\\", "  ")), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(joined, "[^A-Za-z0-9_.-]", ""), "^[._]+|[._]+$", "")


def manifest(sources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Sources and artifacts in one list with safe names; ``pos`` orders within a role."""
    both = sources.withColumn("role", F.lit("source")).unionByName(artifacts.withColumn("role", F.lit("artifact")))
    ranked = with_ordinal(both, "pos", "_n", ["role"])
    named = F.coalesce(F.nullif(safe_name(F.col("name")), F.lit("")), F.concat(F.lit("file-"), F.col("_n").cast("string")))
    return ranked.select("role", "pos", named.alias("file_name"))


def package_violations(archive: Column, disclaimer: Column) -> Column:
    """Rule keys a package breaks."""
    name, note = F.trim(archive), F.trim(F.coalesce(disclaimer, F.lit("")))
    some = name != ""
    checks = [("required", ~some), ("length", some & ~F.length(name).between(3, 80)),
              ("charset", some & ~name.rlike(r"^[A-Za-z0-9._-]{3,80}$")), ("dots", some & name.rlike(r"\.{2,}")),
              ("edges", some & name.rlike(r"^[-_.]|[-_.]$")), ("disclaimer_required", note == ""),
              ("disclaimer_short", (note != "") & (F.length(note) < 20))]
    return F.filter(F.array(*[F.when(cond, F.lit(key)) for key, cond in checks]), lambda x: x.isNotNull())


def rule_report(packages: DataFrame) -> DataFrame:
    """rule, message, n, share: how often each rule is broken, of all packages; ``valid`` counts the packages without any."""
    keys = F.expr("explode(if(size(violations) = 0, array('valid'), violations))")
    messages = F.create_map(*[F.lit(x) for kv in R.ARCHIVE_RULES.items() for x in kv])
    total = packages.agg(F.count("*")).first()[0]
    return (packages.select(keys.alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
            .select("rule", "n", (F.col("n").cast("double") / F.lit(float(max(total, 1)))).alias("share"), F.coalesce(F.try_element_at(messages, F.col("rule")), F.lit("")).alias("message")))


def package_rows(packages: DataFrame) -> DataFrame:
    """The packages with ``valid``, the rules they break and what is said about the first of these."""
    messages = F.create_map(*[F.lit(x) for kv in R.ARCHIVE_RULES.items() for x in kv])
    return packages.select("*", (F.size("violations") == 0).alias("valid"), F.array_join("violations", "|").alias("rules"),
                           F.try_element_at(messages, F.get("violations", F.lit(0))).alias("message")).drop("violations")


def duplicate_names(files: DataFrame) -> DataFrame:
    """name, n, n_paths, path of names that occur more than once, case and outer blanks ignored."""
    per_path = files.groupBy(F.lower(F.trim("name")).alias("name"), "path").agg(F.count("*").alias("c"))
    counts = per_path.groupBy("name").agg(F.sum("c").alias("n"), F.count("*").alias("n_paths")).filter("n > 1")
    return per_path.join(counts, "name").select("name", "n", "n_paths", "path")


def natural_key(name: Column) -> Column:
    """Sort key: case ignored, digit runs of any length compared as numbers. A run becomes its digits without leading zeros, after
    their number and the number of digits of that number."""
    def part(x):
        digits = F.regexp_replace(x, "^0+(?=[0-9])", "")
        size = F.length(digits).cast("string")
        return F.when(x.rlike("^[0-9]"), F.concat(F.length(size).cast("string"), size, digits)).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part), "")


def route_topics(text: Column, routes: list[tuple[list[str], list[str]]] = R.TOPIC_ROUTES, default: list[str] = R.TOPIC_DEFAULT) -> Column:
    """Source keys of the first keyword group the text mentions, else the default group. ``routes`` are the caller's (keywords, keys)."""
    low = F.lower(text)
    out = F.lit(None).cast("array<string>")
    for words, sources in reversed(routes):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.array(*[F.lit(s) for s in sources])).otherwise(out)
    return F.coalesce(out, F.array(*[F.lit(s) for s in default]))
