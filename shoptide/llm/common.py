"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.sinks import files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(taken: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that are no columns of ``taken``, in either case."""
    used, found = {c.lower() for c in taken.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def saved(df: DataFrame, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read back, so that no lost executor makes Spark redo what came before."""
    spark, folder = df.sparkSession, files.shared_folder(df.sparkSession)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose values in ``column`` (text, bytes or lists) have about ``size`` bytes, so that memory is bounded by one row."""
    for batch in batches:
        values = batch.column(column)
        kind = values.type
        width = kind.value_type.bit_width // 8 if pa.types.is_list(kind) else 1
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32)
        ends = (offsets[values.offset:values.offset + len(values) + 1].astype(np.int64) - offsets[values.offset]) * width if len(values) else [0]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges (a, b)``: the smallest node reachable from it.

    Every round gives each node the smallest node in its neighbourhood, replaces the ends of all edges by it, and drops
    edges that became loops; a star is done after one round, and a path of n nodes after about log n. Minima combine
    before the shuffle, and joins meet one row per node, so a hub with a third of all edges is not gathered in one task.
    """
    spark = edges.sparkSession
    here, there = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left, folder = saved(edges.where("a <> b").select(here, there).distinct())
    found, old = None, []
    while True:
        both = left.union(left.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
        near, near_at = saved(near)
        if found is None:
            found, found_at = near, near_at
        else:
            later = near.select(F.col("node").alias("component"), F.col("component").alias("smaller"))
            joined = found.join(later, "component", "left").select("node", F.coalesce("smaller", "component").alias("component"))
            old += [found_at, near_at]
            found, found_at = saved(joined)
        ends = (left.join(near.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
                .join(near.select(F.col("node").alias("b"), F.col("component").alias("y")), "b"))
        left, next_at = saved(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        old.append(folder)
        folder = next_at
        if left.isEmpty():
            break
        for path in old:
            files.remove(spark, path)
        old = []
    for path in [*old, folder]:
        if path != found_at:
            files.remove(spark, path)
    return found
