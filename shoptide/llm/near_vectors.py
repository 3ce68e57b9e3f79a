"""Near-duplicate vectors by iterative quantisation (operator 5).

A rotation is learned on a bounded sample so that the signs of the rotated, centred vectors are balanced bits close to the vectors themselves:
principal axes first, then rounds of fixing the signs and solving for the best rotation. 64 bits are read as an 8 by 8 square; its
rows and its columns are the keys of 16 Hamming tables. Two vectors meet in a table if they agree in its eight bits, so a pair
at the threshold, some four bits apart, is missed only if every row and every column has a difference. Pairs that meet are ranked by
their cosine on the original vectors, and each counts in the first table where it meets.

Equal vectors are one class with a number of members. Classes of a bucket are cut into blocks; pairs of blocks are compared
as matrices. What leaves a task is, per class, the number of links and one edge to the smallest class it reaches there: no list of pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows with null label or vec_id, link with nothing (their component is
themselves). Vectors of different lengths do not link. Repeated rows are links of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptide.llm.common import components, saved
from shoptide.llm.vectors import by_dimension, grouped, lists, units, valid, values, vectors_of, with_key
from shoptide.sinks import files

TABLES = 16


def learn(sample: np.ndarray, rounds: int = 30, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centre and rotation, as often as it takes to have 64 bits."""
    centre = sample.mean(axis=0)
    shifted = sample - centre
    dim = sample.shape[1]
    found, bits = [], 0
    while bits < 64:
        width = min(64 - bits, dim)
        _, axes = np.linalg.eigh(shifted.T @ shifted)
        axes = axes[:, ::-1][:, :width]
        rotation, _ = np.linalg.qr(np.random.default_rng([seed, bits]).normal(size=(width, width)))
        flat = shifted @ axes
        for _ in range(rounds):
            signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ flat)
            rotation = (u @ v).T
        found.append((centre, axes @ rotation))
        bits += width
    return found


def table_keys(vectors: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One byte for each of the 16 tables."""
    bits = np.concatenate([(vectors - centre) @ rotation >= 0 for centre, rotation in rotations], axis=1).reshape(-1, 8, 8)
    square = np.concatenate([bits, bits.transpose(0, 2, 1)], axis=1)
    return np.packbits(square, axis=2).reshape(-1, TABLES)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number each of 0..n-1 reaches by the links i-j."""
    reach = np.arange(n)
    while True:
        low = np.minimum(reach[i], reach[j])
        new = reach.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == reach).all():
            return reach
        reach = new


def near_duplicates(rows: DataFrame, threshold: float = 0.98, sample: int = 20_000, block: int = 1024, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows (vec_id, embedding, label)``."""
    spark = rows.sparkSession
    key = ["label", "dim", "h1", "h2"]
    plain = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    usable = valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = with_key(plain.where(usable), "embedding")
    classes = keyed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes, _ = saved(classes)
    few = classes.orderBy(F.xxhash64("rep", F.lit(seed))).limit(sample).select("embedding")
    by_size: dict[int, list] = {}
    for row in few.toLocalIterator():
        by_size.setdefault(len(row["embedding"]), []).append(row["embedding"])
    rotations = {size: learn(units(np.array(found)), seed=seed) for size, found in by_size.items()}
    sent = spark.sparkContext.broadcast(rotations)

    at = classes.columns.index("embedding")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors in by_dimension(batch, at):
                unit = units(vectors)
                # A length the sample has none of gets the rotation of what is here to turn: any rotation gives valid keys.
                known = sent.value.get(unit.shape[1]) or learn(np.eye(unit.shape[1]), rounds=0, seed=seed)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(table_keys(unit, known).astype(np.int32))],
                                                 names=[*part.schema.names, "keys"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", keys array<int>"
    coded, coded_at = saved(classes.mapInArrow(code, schema))
    group = ["group", "table", "key"]
    entries = coded.select(F.xxhash64("label", "dim").alias("group"), F.posexplode("keys").alias("table", "key"), "label", "dim", "rep", "n", "keys",
                           "embedding")
    sizes = entries.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(
        *group, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # A class goes to each pair of blocks that its own is one of; (b, b) is the block with itself.
    met = entries.join(sizes, group).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*group, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "label", "dim", "rep", "n",
                     "keys", "embedding")

    def link(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = values(table, "low")[0], values(table, "high")[0]
        mine = values(table, "mine")
        if len(mine) < 2:
            return
        own = values(table, "table")[0]
        order = np.argsort(values(table, "rep"), kind="stable")
        rep, n, mine = values(table, "rep")[order], values(table, "n")[order], mine[order]
        kinds = np.stack([values(table, "label")[order], values(table, "dim")[order]], axis=1)
        if (kinds != kinds[0]).any():  # two labels whose hashes are equal
            for kind in np.unique(kinds, axis=0):
                yield from link(table.take(pa.array(order[(kinds == kind).all(axis=1)])))
            return
        keys = np.array(table["keys"].combine_chunks().flatten()).reshape(len(order), TABLES)[order].astype(np.uint8)
        unit = vectors_of(table, "embedding")[order]
        first, second = (np.arange(len(order)),) * 2 if low == high else (np.flatnonzero(mine == low), np.flatnonzero(mine == high))
        links = np.zeros(len(order), dtype=np.int64)
        reach = np.arange(len(order))
        for a in range(0, len(first), 256):
            here = first[a:a + 256]
            i, j = np.nonzero(unit[here] @ unit[second].T >= threshold)
            i, j = here[i], second[j]
            once = i < j if low == high else np.ones(len(i), dtype=bool)
            i, j = i[once], j[once]
            new = ~(keys[i, :own] == keys[j, :own]).any(axis=1)
            i, j = i[new], j[new]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            both = np.concatenate([i, np.arange(len(order))]), np.concatenate([j, reach])
            reach = _forest(len(order), *both)
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[reach[some]])], names=["rep", "links", "low_rep"])

    found = grouped(met, [*group, "low", "high"], link, "rep long, links long, low_rep long")
    found, _ = saved(found)
    files.remove(spark, coded_at)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("low_rep").alias("b")).distinct())
    results = (classes.select(*key, "rep", "n").join(counts, "rep", "left")
               .join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
               .select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    all_rows = with_key(plain.withColumn("embedding", F.when(usable, F.col("embedding"))), "embedding").select("vec_id", *key)
    return all_rows.join(results, key, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
