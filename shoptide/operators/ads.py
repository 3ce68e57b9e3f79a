"""Paid amount by trademark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trademark_amount(wide: DataFrame, stat_time: Column | None = None) -> DataFrame:
    """Exact sum of one batch by trademark, stamped with the batch's wall-clock time unless given."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if stat_time is None else stat_time
    sums = wide.groupBy("tm_id", "tm_name").agg(F.sum("final_detail_amount").alias("amount"))
    return sums.select(stamp.alias("stat_time"), "tm_id", "tm_name", "amount")


def trademark_amount_windows(wide: DataFrame, time: str, width: str = "5 seconds") -> DataFrame:
    """The same sums per event-time window; also runs on a stream with a watermark on ``time``."""
    sums = wide.groupBy(F.window(time, width), "tm_id", "tm_name").agg(F.sum("final_detail_amount").alias("amount"))
    return sums.select(F.col("window.start").alias("window_start"), "tm_id", "tm_name", "amount")
