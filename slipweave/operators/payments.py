"""Payment QR payloads (tag-length-value) and their reconciliation with the parsed amount."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipweave.functions.text import satang


def tlv_fields(payload: Column) -> Column:
    """array<struct(id, len, value)>: tags walked from the left, stopping at a length that is no number."""
    empty = F.array().cast("array<struct<id:string,len:int,value:string>>")
    start = F.struct(F.lit(1).alias("at"), empty.alias("fields"), F.lit(False).alias("done"))
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.length(payload) / 4).cast("int"), F.lit(1)))

    def step(acc, _):
        size = F.regexp_extract(F.substring(payload, acc["at"] + 2, F.lit(2)), r"^\s*\d+", 0).try_cast("int")
        stop = acc["done"] | (acc["at"] > F.length(payload)) | size.isNull()
        field = F.struct(F.substring(payload, acc["at"], F.lit(2)).alias("id"), size.alias("len"),
                         F.substring(payload, acc["at"] + 4, size).alias("value"))
        return F.when(stop, F.struct(acc["at"].alias("at"), acc["fields"].alias("fields"), F.lit(True).alias("done"))).otherwise(
            F.struct((acc["at"] + 4 + size).alias("at"), F.concat(acc["fields"], F.array(field)).alias("fields"), F.lit(False).alias("done")))
    return F.when(F.length(payload) >= 10, F.aggregate(steps, start, step)["fields"]).otherwise(empty)


def tlv_amount(payload: Column) -> Column:
    """Value of the last tag 54."""
    return F.get(F.reverse(F.filter(tlv_fields(payload), lambda f: f["id"] == "54")), F.lit(0))["value"]


def qr_payload(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "000201[0-9a-zA-Z]+", 0), F.lit(""))


def reconcile(df: DataFrame, amount: str, payload: str) -> DataFrame:
    """The QR amount replaces the read amount on every file; disagreements are flagged."""
    from_qr = tlv_amount(F.col(payload)).try_cast("double")
    return df.withColumn("qr_amount", from_qr).withColumn("final_amount", F.coalesce("qr_amount", amount)).withColumn(
        "disagrees", F.coalesce(satang(F.col("qr_amount")) != satang(F.col(amount)), F.lit(False)))
