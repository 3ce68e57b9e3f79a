"""Daily active devices: the first start of each device and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptide.functions.entities import json_columns
from shoptide.functions.times import local_time
from shoptide.schemas import STARTUP_LOG, ddl, names


def parse_startup(messages: DataFrame, zone: str = "UTC", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flattens ``common``, takes the top-level ``ts`` and derives date and hour in ``zone``."""
    common = ddl([c for c in STARTUP_LOG if c[0] != "ts"])
    logs = json_columns(messages, f"`common` struct<{_fields(common)}>, `ts` bigint", keep).select(*keep, "common.*", "ts")
    when = local_time(F.col("ts"), zone).cast("string")
    return logs.withColumns({"log_date": F.substring(when, 1, 10), "log_hour": F.substring(when, 12, 2)})


def first_start(logs: DataFrame) -> DataFrame:
    """Earliest record per day and device. The rank filter also runs before the shuffle, so hot devices stay small."""
    by_day = Window.partitionBy("log_date", "mid").orderBy("ts", *[c for c in names(STARTUP_LOG) if c not in ("mid", "ts")])
    return logs.withColumn("_rank", F.row_number().over(by_day)).where("_rank = 1").drop("_rank")


def first_start_stream(logs: DataFrame, arrived: str = "timestamp", horizon: str = "2 days", salts: int = 4) -> DataFrame:
    """First record to arrive per day and device; state is kept for ``horizon`` of arrival time, which must exceed a day.

    Time goes by the arrival of messages, never by the clocks of devices: one that is wrong must not push out the others' records.

    A first pass works on ``salts`` parts of each device's records, so that a hot device does not go to one task whole.
    """
    timed = logs.withWatermark(arrived, horizon).withColumn("_part", F.pmod(F.hash("ts"), F.lit(salts)))
    few = timed.dropDuplicatesWithinWatermark(["log_date", "mid", "_part"])
    return few.dropDuplicatesWithinWatermark(["log_date", "mid"]).drop(arrived, "_part")


def _fields(columns: str) -> str:
    return columns.replace("` ", "`: ")
