"""Hard-negative mining by a secondary-sort shuffle (operator 11).

A row's score is its integer inner product with the anchor, after each component x became floor(scale * x). The best rows of the anchor's
own label are its positives; a negative of a positive is a row of another label whose score is between a share of the positive's and the positive's.

1. Anchors and rows meet in blocks, as matrices. A block gives the best rows of the anchor's label it has, and of these the best of all blocks are the positives.
2. The blocks are gone through again, now with the scores of the positives: for each positive a block gives the first negatives it has in the positive's window.
   What leaves a block is bounded by the numbers asked for, however many rows are alike.
3. Each pair's score is packed into one key (anchor, descending score, positives first, id). Pairs are dealt by anchor and sorted by key within their
   partitions (the DataFrame form of ``repartitionAndSortWithinPartitions``). An iterator reads the sorted stream: a positive opens a window, a
   negative is given out to every open window that still wants one and reaches down to it. It holds the windows of one anchor and nothing else.

Nothing is collected or broadcast; only the numbers of rows and anchors are, to have blocks of about ``block`` rows of each.

Rows with a null id or label, a null vector, or null or non-finite components take no part. Rows repeated in id, label and vector count once, before they are shuffled; rows
that share an id and differ are rows of their own, and none of them is a candidate of an anchor of this id. Vectors of another length than the
anchor's are no candidates; vectors without components score 0 with each other. A product scale * x beyond doubles counts as the largest double, and a score outside 64 bits as
the nearest number inside.
Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptide.llm.common import saved
from shoptide.llm.vectors import grouped, values
from shoptide.sinks import files

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
POSITIVE, NEGATIVE = 0, 1
#: Anchor, tag, score and id of eight bytes each, and one that puts positives before negatives of the same score.
KEY_BYTES, ANCHOR_BYTES = 33, 16
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    good = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; where doubles could not hold them, by whole numbers of any size."""
    limit = np.sqrt(2.0 ** 52 / max(a.shape[1], 1))
    large_a, large_b = (np.flatnonzero(np.abs(x).max(axis=1, initial=0.0) > limit) for x in (a, b))
    small_a, small_b = a.copy(), b.copy()
    small_a[large_a], small_b[large_b] = 0.0, 0.0
    found = (small_a @ small_b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    exact = lambda x, y: np.clip(whole(x).dot(whole(y).T), LEAST, MOST).astype(np.int64)
    if len(large_a):
        found[large_a] = exact(a[large_a], b)
    if len(large_b):
        found[:, large_b] = exact(a, b[large_b])
    return found


def best(score: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` highest scores under the mask of each row, ties to the smaller column."""
    width = score.shape[1]
    if width > k:
        limit = np.partition(np.where(mask, score, LEAST), width - k, axis=1)[:, width - k]
        mask = mask & (score >= limit[:, None])
    i, j = np.nonzero(mask)
    order = np.lexsort((j, ~score[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def packed(anchor: np.ndarray, tag: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.BinaryArray:
    """Keys whose order as bytes is that of anchor, descending score, kind, id."""
    out = np.empty((len(anchor), KEY_BYTES), dtype=np.uint8)
    big = lambda x: (x.astype(np.int64) ^ LEAST).astype(">i8").view(np.uint8).reshape(-1, 8)
    out[:, :8], out[:, 8:16], out[:, 16:24], out[:, 24], out[:, 25:] = big(anchor), big(tag), big(~score), kind, big(ids)
    offsets = np.arange(len(anchor) + 1, dtype=np.int32) * KEY_BYTES
    return pa.BinaryArray.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(keys: pa.BinaryArray) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Anchor, tag, score, kind and id of each key."""
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset:keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].reshape(-1, KEY_BYTES)
    number = lambda k: np.ascontiguousarray(data[:, k:k + 8]).view(">i8").ravel().astype(np.int64) ^ LEAST
    return number(0).tolist(), number(8).tolist(), (~number(16)).tolist(), data[:, 24].tolist(), number(25).tolist()


def _rows(df: DataFrame) -> DataFrame:
    """Usable rows once each, with a tag that tells apart rows of one id."""
    vector = F.col("embedding")
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(vector)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size(vector).alias("dim"),
        F.xxhash64("label", vector).alias("tag"), "embedding")
    return rows.dropDuplicates(["vec_id", "label", "dim", "tag"])


def _blocks(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every anchor and every row once in each pair of blocks it belongs to."""
    own = lambda n: F.pmod(F.xxhash64("vec_id", "tag"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["dim", "row_block", "anchor_block", "is_anchor", "vec_id", "label", "tag", "embedding", "windows"]
    a = rows.withColumns({"row_block": own(row_blocks), "is_anchor": F.lit(False), "windows": F.lit(None).cast("array<bigint>")}).withColumn(
        "anchor_block", every(anchor_blocks))
    b = anchors.withColumns({"anchor_block": own(anchor_blocks), "is_anchor": F.lit(True)}).withColumn("row_block", every(row_blocks))
    return a.select(*columns).unionByName(b.select(*columns))


class _Block:
    """The anchors and rows of a pair of blocks, rows in order of their ids."""

    def __init__(self, table: pa.Table, scale: float):
        is_anchor = values(table, "is_anchor").astype(bool)
        ids, tags = values(table, "vec_id"), values(table, "tag")
        labels = np.unique(np.asarray(table["label"].to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        flat = table["embedding"].combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        vectors = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), values(table, "dim")[0])
        with np.errstate(over="ignore"):
            vectors = np.nan_to_num(np.floor(vectors * scale))
        asked, rows = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        self.anchor, self.tag, self.anchor_label, self.anchor_vector = ids[asked], tags[asked], labels[asked], vectors[asked]
        self.id, self.label, self.vector = ids[rows], labels[rows], vectors[rows]
        self.windows = [table["windows"][int(k)].as_py() or [] for k in asked] if "windows" in table.column_names else []

    def tiles(self, size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Places of some anchors, their scores with all rows, which rows have their label, and which another id."""
        for a in range(0, len(self.anchor) if len(self.id) else 0, size):
            here = np.arange(a, min(a + size, len(self.anchor)))
            yield (here, scores(self.anchor_vector[here], self.vector), self.anchor_label[here][:, None] == self.label,
                   self.anchor[here][:, None] != self.id)


def _positives(both: DataFrame, k: int, scale: float) -> DataFrame:
    """``anchor_id, tag, dim, id, score`` of the ``k`` best rows of each anchor's label."""
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = _Block(table, scale)
        dim = values(table, "dim")[0]
        for here, score, same, other in block.tiles():
            i, j = best(score, same & other, k)
            yield pa.RecordBatch.from_arrays([pa.array(block.anchor[here][i]), pa.array(block.tag[here][i]), pa.array(np.full(len(i), dim, np.int32)),
                                              pa.array(block.id[j]), pa.array(score[i, j])], names=["anchor_id", "tag", "dim", "id", "score"])

    found = grouped(both, ["dim", "row_block", "anchor_block"], run, "anchor_id long, tag long, dim int, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "tag", "dim").orderBy(F.desc("score"), "id"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _negative_keys(both: DataFrame, k: int, low: int, high: int, scale: float) -> DataFrame:
    """Keys of the first ``k`` negatives in each window, block by block."""
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = _Block(table, scale)
        for here, score, same, _ in block.tiles():
            tops = np.full((len(here), max(map(len, block.windows), default=0)), -1, dtype=np.int64)
            for place, row in enumerate(here):
                tops[place, :len(block.windows[row])] = block.windows[row]
            found = []
            for w in range(tops.shape[1]):
                top = tops[:, w].tolist()  # a negative positive score has an empty window
                floor = np.array([-(-low * t // high) for t in top], dtype=np.int64)
                inside = ~same & (score <= tops[:, w][:, None]) & (score >= floor[:, None]) & (tops[:, w] >= 0)[:, None]
                found.append(np.stack(best(score, inside, k)))
            i, j = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([packed(block.anchor[here][i], block.tag[here][i], score[i, j], NEGATIVE, block.id[j])], names=["key"])

    return grouped(both, ["dim", "row_block", "anchor_block"], run, "key binary")


def _positive_keys(positives: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, tag, ids, score = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("anchor_id", "tag", "id", "score"))
            yield pa.RecordBatch.from_arrays([packed(anchor, tag, score, POSITIVE, ids)], names=["key"])

    return positives.mapInArrow(run, "key binary")


def windows_opened(keys: Iterator[tuple[int, int, int, int, int]], k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """From sorted keys (anchor, tag, score, kind, id): (anchor, positive, rank, negative, positive's score, negative's score)."""
    now, opened = None, []
    for anchor, tag, score, kind, number in keys:
        if (anchor, tag) != now:
            now, opened = (anchor, tag), []
        if kind == POSITIVE:
            opened.append([number, score, 0])
            continue
        for window in opened:
            positive, top, given = window
            if given < k and low * top <= high * score:
                window[2] = given + 1
                yield anchor, positive, given + 1, number, top, score


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
         block: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``anchors``, out of ``rows (vec_id, embedding, label)``.

    A negative n of a positive p has ``low * p <= high * n <= high * p`` as scores.
    """
    spark = rows.sparkSession
    (rows, rows_at), (asked, asked_at) = saved(_rows(rows)), saved(_rows(anchors))
    row_blocks, anchor_blocks = (max(1, -(-x.count() // block)) for x in (rows, asked))
    first, first_at = saved(_positives(_blocks(rows, asked.withColumn("windows", F.lit(None).cast("array<bigint>")), row_blocks, anchor_blocks), positives, scale))
    tops = first.groupBy(F.col("anchor_id").alias("vec_id"), "tag", "dim").agg(F.collect_list("score").alias("windows"))
    opened = asked.join(tops, ["vec_id", "tag", "dim"])
    keys = _positive_keys(first).union(_negative_keys(_blocks(rows, opened, row_blocks, anchor_blocks), negatives, low, high, scale))
    dealt = keys.repartition(F.substring("key", 1, ANCHOR_BYTES)).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (key for batch in batches if batch.num_rows for key in zip(*unpacked(batch.column(0))))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [field.split()[0] for field in MINED.split(", ")]
        waiting = []
        for found in windows_opened(stream, negatives, low, high):
            waiting.append(found)
            if len(waiting) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), kinds)], names=names)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), kinds)], names=names)

    mined, mined_at = saved(dealt.mapInArrow(run, MINED))
    for path in (rows_at, asked_at, first_at):
        files.remove(spark, path)
    return mined
