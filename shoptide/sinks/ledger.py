"""Offset ledger: how far each consumer group has read each topic partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.sinks.tables import KeyedTable

LEDGER = "`group_id` string, `topic` string, `partition_id` int, `partition_offset` bigint"


def ledger_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, root, ["group_id", "topic", "partition_id"], LEDGER)


def offset_ranges(messages: DataFrame, group: str) -> DataFrame:
    """Next offset to read of every topic partition in a batch, for one or many topics."""
    ends = messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("partition_offset"))
    return ends.select(F.lit(group).alias("group_id"), "topic", F.col("partition").cast("int").alias("partition_id"),
                       "partition_offset")


def save_offsets(ledger: KeyedTable, messages: DataFrame, group: str, batch_id: int) -> bool:
    return ledger.upsert(offset_ranges(messages, group), batch_id)


def read_offsets(ledger: KeyedTable, group: str, topics: list[str]) -> DataFrame:
    return ledger.read().where((F.col("group_id") == group) & F.col("topic").isin(topics))


def to_topic_maps(offsets: DataFrame) -> DataFrame:
    """One ``{"partition": "offset"}`` JSON map per group and topic; a topic has few partitions."""
    entry = F.struct(F.col("partition_id").cast("string").alias("key"), F.col("partition_offset").cast("string").alias("value"))
    maps = offsets.groupBy("group_id", "topic").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("_m"))
    return maps.select("group_id", "topic", F.to_json("_m").alias("offsets"))


def from_topic_maps(maps: DataFrame) -> DataFrame:
    rows = maps.select("group_id", "topic", F.explode(F.from_json("offsets", "map<string,string>")))
    return rows.select("group_id", "topic", F.col("key").cast("int").alias("partition_id"),
                       F.col("value").cast("bigint").alias("partition_offset"))
