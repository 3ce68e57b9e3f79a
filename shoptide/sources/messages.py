"""Message streams: Kafka, or folders of Parquet files with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.schemas import MESSAGE, ddl, names
from shoptide.sinks import files


def kafka_options(servers: str, topics: list[str], starting: str | None = None, per_trigger: int | None = None) -> dict[str, str]:
    """Options of the Kafka source; without stored offsets a new query starts at the earliest message."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(sorted(topics)),
        "startingOffsets": starting or "earliest",
        "failOnDataLoss": "true",
    }
    if per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def read_stream(spark: SparkSession, topics: list[str], kind: str = "kafka", path: str | None = None,
                servers: str | None = None, starting: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """Several topics in one stream, each row with its ``topic``."""
    if kind == "kafka":
        stream = spark.readStream.format("kafka").options(**kafka_options(servers, topics, starting, per_trigger)).load()
        return stream.select(F.col("key").cast("string"), F.col("value").cast("string"), *names(MESSAGE)[2:])
    if kind != "files":
        raise ValueError(f"unknown source kind {kind!r}")
    stream = None
    for topic in sorted(topics):
        one = _topic_files(spark, path, topic, per_trigger)
        stream = one if stream is None else stream.unionByName(one)
    return stream


def read_topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """All messages of a topic written by the file sink, as a batch table."""
    rows = spark.read.schema(_stored()).option("recursiveFileLookup", "true").parquet(f"{path}/*/batch=*/topic={topic}")
    return rows.withColumn("topic", F.lit(topic)).select(*names(MESSAGE))


def _topic_files(spark: SparkSession, path: str, topic: str, per_trigger: int | None) -> DataFrame:
    files.make_folder(spark, path)
    reader = spark.readStream.schema(_stored()).option("recursiveFileLookup", "true")
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(per_trigger))
    rows = reader.parquet(f"{path}/*/batch=*/topic={topic}")
    return rows.withColumn("topic", F.lit(topic)).select(*names(MESSAGE))


def _stored() -> str:
    return ddl([c for c in MESSAGE if c[0] != "topic"])
