"""Structured Streaming jobs: folder ingestion, temporal de-duplication, rerun-safe writing."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def watch_folder(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; each file is read once per checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes everything present and stops; rerunning with the same checkpoint adds only what is new."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drop_repeats(stream: DataFrame, id_column: str, time_column: str, window: str) -> DataFrame:
    """The same id within the window is dropped; state expires with the watermark."""
    return stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, window).dropDuplicatesWithinWatermark([id_column])


def append_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Every batch overwrites its own folder, so a repeated batch after a failure adds nothing twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _written(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What the batches before this one have written."""
    try:
        return spark.read.schema(f"{schema}, batch_id BIGINT").parquet(path).filter(F.col("batch_id") < before).drop("batch_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keep_late(stream: DataFrame, id_column: str, time_column: str, order_column: str, window: str, path: str, checkpoint: str) -> None:
    """Rows without repeats in ``path``/kept, late ones in ``path``/late, both by batch; runs over what is present and stops.

    The watermark of a batch is ``window`` below the greatest time of the batches before it. Rows below it are late: they are kept aside and touch nothing
    else. Of the others, the first of each id stays (by time, then ``order_column``), unless a row of that id stayed before whose time is not yet ``window`` below
    the watermark; after that the id counts as new. Every batch overwrites its own folders and reads only those of earlier batches, so a batch that is repeated after
    a failure changes nothing; of the rows that stayed before, only those within reach of the watermark are read.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.col(time_column)
        top = _written(spark, f"{path}/tops", "top TIMESTAMP", batch_id).agg(F.max("top")).first()[0]
        mark = F.lit(None).cast("timestamp") if top is None else F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {window}")
        late = F.coalesce(at < mark, F.lit(False))
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        held = _written(spark, f"{path}/kept", schema, batch_id).filter(F.coalesce(at + F.expr(f"INTERVAL {window}") > mark, F.lit(True))).select(id_column).distinct()
        fresh = batch.filter(~late).join(held, id_column, "left_anti")
        first = fresh.groupBy(id_column).agg(F.min_by(F.struct(*stream.columns), F.struct(time_column, order_column)).alias("r")).select("r.*")
        first.write.mode("overwrite").parquet(f"{path}/kept/batch_id={batch_id}")
        batch.agg(F.max(at).alias("top")).write.mode("overwrite").parquet(f"{path}/tops/batch_id={batch_id}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
