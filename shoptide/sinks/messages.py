"""Message sinks: Kafka, or the Parquet folders that ``sources.messages`` reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.schemas import MESSAGE
from shoptide.sinks import files
from shoptide.sinks.tables import STORED, claim
from shoptide.streaming.runner import settings

#: Files that a task has open at once, and the size of a row group, which each of them may have in memory.
OPEN_FILES, ROW_GROUP = 8, 32 << 20


def write_batch(messages: DataFrame, batch_id: int, job: str, kind: str = "kafka", path: str | None = None,
                servers: str | None = None) -> None:
    """Sends rows with ``topic`` and ``value`` (``key`` and ``timestamp`` optional), each to its own topic.

    Kafka delivery is at least once; facts carry their id as key, and readers drop what they have seen. The file twin leaves a
    finished batch alone when it is replayed.
    """
    if kind == "kafka":
        sent = [F.col(c).cast("string").alias(c) for c in ("key", "value", "topic") if c in messages.columns]
        messages.select(*sent).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
            "kafka.enable.idempotence", "true").save()
        return
    if kind != "files":
        raise ValueError(f"unknown sink kind {kind!r}")
    claim(messages.sparkSession, f"{path}/{job}")
    folder = f"{path}/{job}/batch={batch_id:012d}"
    if files.exists(messages.sparkSession, f"{folder}/_SUCCESS"):
        return
    _write(_stored_columns(messages, batch_id), folder, "topic", mode="overwrite")


def stage_waves(messages: DataFrame, path: str, name: str) -> None:
    """Writes messages once, cut by their ``wave`` number; no reader sees a wave before :func:`publish_wave`."""
    _write(_stored_columns(messages, 0, "wave"), f"{path}/_staged/{name}", "wave", "topic")


def publish_wave(spark: SparkSession, path: str, name: str, wave: int) -> None:
    staged = f"{path}/_staged/{name}/wave={wave}"
    if files.exists(spark, staged):
        files.rename(spark, staged, f"{path}/{name}/batch={wave:012d}")


def drop_wave(spark: SparkSession, path: str, name: str, wave: int) -> None:
    """Removes a wave's messages, as a broker does with old ones: for those that every reader has behind it."""
    files.remove(spark, f"{path}/{name}/batch={wave:012d}")


def _write(rows: DataFrame, folder: str, *by: str, mode: str = "errorifexists") -> None:
    """Rows that go to no more than ``OPEN_FILES`` folders are not sorted by them first, which at size would put all messages of a task on disk once more."""
    with settings(rows.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        rows.write.mode(mode).option("compression", STORED).option("parquet.block.size", str(ROW_GROUP)).partitionBy(*by).parquet(folder)


def _stored_columns(messages: DataFrame, batch_id: int, *keep: str) -> DataFrame:
    """Fills the source columns a broker would set: offsets grow with the batch within a partition."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    made = {
        "key": F.lit(None),
        "partition": F.spark_partition_id(),
        "offset": F.lit(batch_id << 33) + row,
        "timestamp": F.current_timestamp(),
        "timestampType": F.lit(0),
    }
    return messages.select(*[(F.col(name) if name in messages.columns else made[name]).cast(kind).alias(name)
                             for name, kind, _ in MESSAGE], *keep)
