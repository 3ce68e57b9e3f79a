"""Running a pipeline: source, per-batch work, trigger, checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shoptide.session import STATE_SETTINGS


@dataclass(frozen=True)
class Pipeline:
    """A consumer group with its trigger interval, its stream, and what happens to each batch.

    ``large_state``: what the state holds grows with all that came, not with a window of time, so it stands in RocksDB beside the heap, which takes more time.
    """

    group: str
    interval: str
    source: Callable[[], DataFrame]
    each_batch: Callable[[DataFrame, int], None]
    output: str = "append"
    large_state: bool = False

    def start(self, spark: SparkSession, checkpoints: str, once: bool = False, state_partitions: int | None = None) -> StreamingQuery:
        """Starts the query; ``once`` takes everything available and ends.

        The number of state partitions, and whether the state is a large one, are fixed by a query's first start, so size it for the cluster then.
        """
        state = {} if state_partitions is None else {"spark.sql.shuffle.partitions": str(state_partitions)}
        if self.large_state:
            state |= {name: value for name, value in STATE_SETTINGS.items() if spark.conf.get(name, None) is None}
        with settings(spark, state):
            writer = (self.source().writeStream.queryName(self.group).outputMode(self.output).foreachBatch(self.each_batch)
                      .option("checkpointLocation", f"{checkpoints}/{self.group}"))
            trigger = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.interval)
            return trigger.start()

    def drain(self, spark: SparkSession, checkpoints: str, state_partitions: int | None = None) -> None:
        self.start(spark, checkpoints, once=True, state_partitions=state_partitions).awaitTermination()
        free_shuffles(spark)

    def feed(self, spark: SparkSession, checkpoints: str, parts: Iterable[Callable[[], None]], state_partitions: int | None = None) -> None:
        """As a drain after each of ``parts``, calls that make messages available, but in one run, so that the state stays loaded between them.

        A part's topics may come in two batches, so this is for jobs whose results don't depend on that.
        """
        query = None
        try:
            for publish in parts:
                publish()
                query = query or replace(self, interval="0 seconds").start(spark, checkpoints, state_partitions=state_partitions)
                query.processAllAvailable()
                free_shuffles(spark)
        finally:
            if query is not None:
                query.stop()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is done: it does once the driver has dropped their frames, and a driver with free memory would keep all of a job's."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def held(batch: DataFrame) -> Iterator[DataFrame]:
    """The batch kept for several uses, so that sources and state are read once."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()
