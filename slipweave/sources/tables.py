"""Input tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipweave.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``documents`` with at least one partition per core; ``columns`` prune the scan."""
    df = table(spark, sf_dir, "documents")
    return spread(df.select("doc_id", *columns), "doc_id")
