"""File sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slipweave import rules as R
from slipweave.functions import text as T


def scan_files(spark: SparkSession, root: str, extensions: list[str] | None = None, with_content: bool = False) -> DataFrame:
    """path, name, ext, length of all files below a folder with a listed extension, by lower-cased path.

    Content is read only when asked for, as ``file_hash``.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    columns = ["path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), ext.alias("ext"), "length"]
    if with_content:
        columns.append(F.sha2("content", 256).alias("file_hash"))
    return found.filter(ext.isin(extensions or R.IMAGE_EXTENSIONS)).select(*columns).orderBy(F.lower("path"))


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text lists as ``line``, with the partition columns of the folder; trimmed and without empty ones."""
    found = spark.read.text(path)
    cleaned = F.trim(F.regexp_replace("value", r"^\ufeff", ""))
    return found.withColumn("line", cleaned).filter("line <> ''").drop("value")


def audit_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Audit documents, one per file or, without ``multi_line``, one per line: file, row, payload and results as VARIANT, and ``problem`` of those that can't be read.

    Results are the list ``results`` of the payload, or one object there, or the payload itself where that is a list. Bad documents are rows like all others, with
    NOT_JSON, NOT_AN_OBJECT or RESULTS_NOT_A_LIST, so one of them does not stop the rest.
    """
    given = spark.read.text(path, wholetext=multi_line).filter(F.trim("value") != "")
    read = given.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), F.try_parse_json("value").alias("payload"))
    kind = lambda c: F.coalesce(F.regexp_extract(F.schema_of_variant(c), "^[A-Z]+", 0), F.lit("VOID"))
    inner = F.try_variant_get("payload", "$.results", "variant")
    found = read.select("*", kind(F.col("payload")).alias("_outer"), inner.alias("_inner"), kind(inner).alias("_kind"))
    results = (F.when(F.col("_outer") == "ARRAY", F.try_variant_get("payload", "$", "array<variant>")).when(F.col("_kind") == "ARRAY", F.try_variant_get("payload", "$.results", "array<variant>"))
               .when(F.col("_kind") == "OBJECT", F.array("_inner")))
    problem = (F.when(F.col("payload").isNull(), "NOT_JSON").when(~F.col("_outer").isin("ARRAY", "OBJECT"), "NOT_AN_OBJECT")
               .when((F.col("_outer") == "OBJECT") & ~F.col("_kind").isin("ARRAY", "OBJECT", "VOID"), "RESULTS_NOT_A_LIST"))
    return found.select("file", "row", "payload", results.alias("results"), problem.alias("problem"))


def audit_summaries(documents: DataFrame) -> DataFrame:
    """file, row, problem, scanned_files and document_no as the document states them, results and how many of them are no objects."""
    plain = lambda r: ~F.coalesce(F.schema_of_variant(r), F.lit("VOID")).startswith("OBJECT")
    stated = [F.when(F.col("problem").isNull(), F.try_variant_get("payload", f"$.summary.{n}", "bigint")).alias(n) for n in ("scanned_files", "document_no")]
    return documents.select("file", "row", "problem", *stated, F.coalesce(F.size("results"), F.lit(0)).alias("results"),
                            F.coalesce(F.size(F.filter("results", plain)), F.lit(0)).alias("skipped"))


def read_audit(spark: SparkSession, path: str, multi_line: bool = True, images: DataFrame | None = None) -> DataFrame:
    """The result objects of audit documents, whatever their shapes, as one row each with the fields of RESULT_PATHS and is_slip.

    The index is (file, document number, document, position in it), which orders the results of any number of files of any size. A date loses its time; that of a displayed date stands in where no
    time is given (a timestamp's does not); amounts may be texts with separators and currency; a missing currency is the default one. ``images`` (name, path) overrides paths: a result takes the
    least path of its file name, if there is one.
    """
    documents = audit_documents(spark, path, multi_line)
    rows = documents.select("file", F.coalesce(F.try_variant_get("payload", "$.summary.document_no", "bigint"), F.lit(0)).alias("document"), "row", F.posexplode("results").alias("pos", "r"))
    rows = rows.filter(F.coalesce(F.schema_of_variant("r"), F.lit("VOID")).startswith("OBJECT"))

    def text(field: str) -> Column:
        return F.coalesce(*[F.when(F.trim(v) != "", v) for v in (F.try_variant_get("r", f"$.{p}", "string") for p in R.RESULT_PATHS[field])])
    read = rows.select(F.struct("file", "document", "row", "pos").alias("index"), "pos", F.try_variant_get("r", "$.is_slip", "boolean").alias("is_slip"),
                       *[text(f).alias(f) for f in R.RESULT_PATHS])
    moment = F.nullif(F.col("transaction_date"), F.lit("UNKNOWN"))
    clock = F.when(~moment.rlike("[0-9]T[0-9]"), F.nullif(T.clock_part(moment), F.lit("-")))
    day = F.nullif(F.split_part(F.split_part(T.calendar_part(F.coalesce(moment, F.lit("-"))), F.lit("T"), F.lit(1)), F.lit(" "), F.lit(1)), F.lit("-"))
    number = F.nullif(F.regexp_extract(F.replace("amount", F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?", 0), F.lit(""))
    name = F.coalesce("file_name", F.nullif(F.regexp_extract("file_path", r"([^/]+)$", 1), F.lit("")), F.concat(F.lit("record-"), (F.col("pos") + 1).cast("string")))
    out = read.withColumns({"transaction_date": day, "transaction_time": F.coalesce("transaction_time", clock), "amount": number.try_cast("double"),
                            "currency": F.coalesce("currency", F.lit(R.DEFAULT_CURRENCY)), "file_name": name}).drop("pos")
    if images is None:
        return out
    places = images.groupBy(F.col("name").alias("file_name")).agg(F.min("path").alias("_path"))
    return out.join(places, "file_name", "left").withColumn("file_path", F.coalesce("_path", "file_path")).drop("_path")
