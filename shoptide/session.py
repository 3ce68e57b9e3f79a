"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Wide rows make long generated methods; beyond this size the JVM would interpret them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Adaptive execution splits skewed join partitions and turns joins with a really small side into broadcasts.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# For streams with large state: it stays off the heap, in a bounded part of an executor's memory and on its disk.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Beside a heap that may be full; unset it is 500 MB.
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Else each put reads the key first, only to count rows for the progress report.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def configure(builder: SparkSession.Builder, large_state: bool = False) -> SparkSession.Builder:
    for name, value in {**SETTINGS, **(STATE_SETTINGS if large_state else {})}.items():
        builder = builder.config(name, value)
    return builder
