"""Receipts as a stream: the extraction is stateless, and re-shot receipts are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed
from ..functions import text as t
from ..operators.extract import with_fields


def extracted(receipts: DataFrame, text: str = "text", brands: list[str] | None = None) -> DataFrame:
    return with_fields(receipts.withColumn("_t", t.repaired(F.col(text))), "_t", brands or fixed.BRANDS).drop("_t")


def without_repeats(receipts: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """One of the receipts with the same number, date, time and total that come within the delay."""
    keys = ["registration_number", "date", "time", "total"]
    return receipts.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def totals(receipts: DataFrame, time: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    d = receipts.withWatermark(time, delay).groupBy(F.window(time, window), "store_brand")
    return d.agg(F.count("*").alias("receipts"), F.sum("total").alias("total"))


def start(receipts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return receipts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
