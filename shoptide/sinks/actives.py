"""Active devices by day as bitmaps: one bit per device, merged over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from shoptide.sinks.tables import BatchTables
from shoptide.streaming.runner import held

SPANS = {"day": lambda start: F.date_add(start, 1), "week": lambda start: F.date_add(start, 7), "month": lambda start: F.add_months(start, 1)}
PLACE = ["shard", "part"]


class ActiveDevices:
    """Which devices were active on which day, and how many over any span of days, without their ids.

    A device gets a number once, dense within its shard, a hash of its id; its bit stands in the bitmap of (day, shard, part), where a part is 32,768
    numbers, 4 KiB. Give as many ``shards`` as keep the devices of one at some hundred thousand: new devices are numbered by shard.
    A batch reads and replaces the numbers of its devices and the bitmaps of its days only. Numbers, sizes and bitmaps of a batch become
    visible together, and a replayed batch sees what was there before it.

    Starts without a day or device don't count; a start that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, shards: int = 16, folders: int = 8):
        self.shards = shards
        self.tables = BatchTables(
            spark, root,
            {"numbers": "`mid` string, `shard` int, `number` bigint", "sizes": "`shard` int, `used` bigint",
             "days": "`log_date` string, `shard` int, `part` bigint, `bits` binary"},
            {"numbers": ["mid"], "sizes": ["shard"], "days": ["log_date", *PLACE]},
            folders={"numbers": (["mid"], folders), "days": (["log_date"], folders)})

    def add(self, starts: DataFrame, batch_id: int) -> None:
        """Notes the starts ``(log_date, mid)`` of a batch."""
        with held(starts.select("log_date", "mid").dropna().distinct()) as starts, held(starts.select("mid").distinct()) as came:
            known = self.tables.current("numbers", batch_id, came)
            with held(self._numbered(came.join(known, "mid", "left_anti"), batch_id)) as new:
                bits = (starts.join(known.unionByName(new), "mid").groupBy("log_date", "shard", F.bitmap_bucket_number("number").alias("part"))
                        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))
                with held(bits) as bits:
                    before = self.tables.current("days", batch_id, bits.select("log_date", *PLACE))
                    merged = before.unionByName(bits).groupBy("log_date", *PLACE).agg(F.bitmap_or_agg("bits").alias("bits"))
                    self.tables.commit(batch_id, {"numbers": new, "days": merged, "sizes": new.groupBy("shard").agg(F.max("number").alias("used"))})

    def counts(self, span: str) -> DataFrame:
        """``start, devices, returned`` of every span (a day, week or month) with starts: its devices, and those of them that were active in the span before as well."""
        later = SPANS[span]
        days = self.tables.current("days")
        spans = (days.groupBy(F.date_trunc(span, F.col("log_date").cast("timestamp")).cast("date").alias("start"), *PLACE)
                 .agg(F.bitmap_or_agg("bits").alias("bits")))
        pairs = spans.withColumn("own", F.lit(1)).unionByName(spans.withColumns({"start": later(F.col("start")), "own": F.lit(0)}))
        both = pairs.groupBy("start", *PLACE).agg(F.bitmap_and_agg("bits").alias("both"), F.count("*").alias("n"), F.max("own").alias("own"),
                                                  F.bitmap_or_agg(F.when(F.col("own") == 1, F.col("bits"))).alias("bits"))
        here = both.where("own = 1")
        return here.groupBy("start").agg(F.sum(F.bitmap_count("bits")).alias("devices"),
                                         F.sum(F.when(F.col("n") == 2, F.bitmap_count("both")).otherwise(0)).alias("returned"))

    def active(self, starts: DataFrame) -> DataFrame:
        """The rows of ``starts (log_date, mid)`` whose device was active on that day."""
        with held(starts.select("log_date", "mid").dropna().distinct()) as wanted:
            numbers = self.tables.current("numbers", wanted=wanted.select("mid"))
            placed = wanted.join(numbers, "mid").withColumn("part", F.bitmap_bucket_number("number"))
            found = placed.join(self.tables.current("days", wanted=wanted.select("log_date")), ["log_date", *PLACE])
            return found.where(_bit(F.col("bits"), F.bitmap_bit_position("number"))).select("log_date", "mid")

    def _numbered(self, new: DataFrame, batch_id: int) -> DataFrame:
        """Numbers from 1 for devices that have none, after those their shard has given out."""
        placed = new.select("mid", F.pmod(F.xxhash64("mid"), F.lit(self.shards)).cast("int").alias("shard"))
        place = F.row_number().over(Window.partitionBy("shard").orderBy("mid"))
        sizes = self.tables.current("sizes", batch_id)
        return (placed.withColumn("place", place).join(sizes, "shard", "left")
                .select("mid", "shard", (F.coalesce("used", F.lit(0)) + F.col("place")).cast("bigint").alias("number")))


def _bit(bits: Column, position: Column) -> Column:
    byte = F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (position % 8).cast("int")) == 1
