"""What the two operators on vectors share: valid vectors, unit rows, groups of rows streamed from sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    numbers = vector.cast("array<double>")
    good = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(numbers, lambda x: x != 0), F.lit(False))


def with_key(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``dim`` and two hashes, ``h1`` and ``h2``, that equal vectors share."""
    return rows.select("*", F.size(vector).alias("dim"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(1), vector).alias("h2"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors.astype(np.float64)
    if not len(vectors):
        return vectors
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length with their vectors as a matrix."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        part = batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))
        yield part, matrix(part.column(column))


def lists(values: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def grouped(rows: DataFrame, keys: list[str], function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over the rows of each ``keys``, which are integers and not null.

    Rows come together by a shuffle and stream from sorted partitions, so that thousands of small groups cost little and only one is held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = last is None or last != tuple(c[0] for c in columns)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            last = tuple(c[-1] for c in columns)
            if not len(starts):
                pending.append(batch)
                continue
            if starts[0] > 0:
                pending.append(batch.slice(0, starts[0]))
            if pending:
                yield from function(pa.Table.from_batches(pending).combine_chunks())
            for a, b in zip(starts[:-1], starts[1:]):
                yield from function(pa.Table.from_batches([batch.slice(a, b - a)]))
            pending = [batch.slice(starts[-1])]
        if pending:
            yield from function(pa.Table.from_batches(pending).combine_chunks())

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def values(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def vectors_of(table: pa.Table, name: str) -> np.ndarray:
    column = table[name].combine_chunks()
    return units(matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column))
