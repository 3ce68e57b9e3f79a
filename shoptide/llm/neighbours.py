"""Approximate nearest neighbours by cross-polytope hashing (operator 4).

A hash applies three rounds of random signs and a fast Hadamard transform (a pseudo-rotation) to a unit vector and takes the nearest of the signed axes. Every vector
stands in one bucket of each table; a query looks into the buckets of its nearest ``probes`` axes. All candidates of a bucket are
ranked by their exact cosine on the original vectors.

A query that finds fewer than it asks for in its buckets is compared with all vectors of its length in blocks, so an answer is short only where the table is.

Equal vectors are hashed and ranked once and stand for the smallest ids of their class, more than which no answer can need. Buckets are counted first and
cut into blocks, as are the queries that come to them, so that no task holds more than a block of either; what leaves
a block is at most a few rows per query. Nothing is collected or broadcast.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null vec_id, take no part. Vectors of other lengths are no
candidates. Ties go to the smaller vec_id. A repeated vec_id counts as another candidate only if its vector differs; an
empty table gives no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptide.llm.common import saved
from shoptide.llm.vectors import by_dimension, grouped, lists, units, valid, values, vectors_of, with_key
from shoptide.sinks import files


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two, keeping lengths."""
    n, size = rows.shape
    step = 1
    while step < size:
        rows = rows.reshape(n, -1, 2, step)
        rows = np.concatenate([rows[:, :, :1] + rows[:, :, 1:], rows[:, :, :1] - rows[:, :, 1:]], axis=2).reshape(n, size)
        step *= 2
    return rows / np.sqrt(size)


def axes(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """The nearest ``probes`` signed axes of each unit vector in each table: rows x tables x probes."""
    n, dim = vectors.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    found = np.empty((n, tables, min(probes, 2 * size)), dtype=np.int32)
    for t in range(tables):
        turned = padded
        for r in range(3):
            turned = hadamard(turned * np.random.default_rng([seed, t, r, size]).choice([-1.0, 1.0], size))
        both = np.concatenate([turned, -turned], axis=1)
        found[:, t] = np.argsort(-both, axis=1, kind="stable")[:, :found.shape[2]]
    return found


def _hashed(rows: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """``rows (h1, h2, dim, embedding)`` once for each table and probed bucket."""
    at = rows.columns.index("embedding")
    n = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors in by_dimension(batch, at):
                found = axes(units(vectors), tables, probes, seed)
                code = found + np.arange(tables, dtype=np.int32)[None, :, None] * (1 << 24)
                yield pa.RecordBatch.from_arrays([*part.columns, lists(code.reshape(len(code), -1))], names=[*part.schema.names, "codes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", codes array<int>"
    return rows.mapInArrow(run, schema).select(*rows.columns[:n], F.explode("codes").alias("bucket"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, tables: int = 8, probes: int = 12, seed: int = 4, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found in ``rows (vec_id, embedding)`` for each row of ``queries``, itself left out."""
    key = ["dim", "h1", "h2"]
    usable, asked = (with_key(x.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"), "embedding") for x in (rows, queries))
    smallest = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
    few = usable.dropDuplicates([*key, "vec_id"]).withColumn("_place", smallest).where(F.col("_place") <= k + 1)
    classes = few.groupBy(*key).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first"),
                                    F.first("embedding").alias("embedding"))
    classes, classes_at = saved(classes)
    heads = asked.groupBy(*key).agg(F.first("embedding").alias("embedding"))
    bases = _hashed(classes.select(*key, "first", "embedding"), tables, 1, seed)
    looks = _hashed(heads, tables, probes, seed)
    found, found_at = saved(_best(classes, bases, looks, k, block))
    others = F.slice(F.array_sort(F.filter("found", lambda f: f["id"] != F.col("vec_id"))), 1, k)
    answers, answers_at = saved(asked.select("vec_id", *key).join(found, key, "left").select("vec_id", *key, F.coalesce(others, F.array()).alias("others")))
    short = answers.where(F.size("others") < k).select("vec_id", *key)
    everything = F.lit(-1).alias("bucket")
    again = _best(classes, classes.select(*key, "first", "embedding", everything), heads.join(short.select(*key).distinct(), key, "left_semi").select(
        *key, "embedding", everything), k, block)
    whole = answers.where(F.size("others") >= k).select("vec_id", "others").unionByName(short.join(again, key).select("vec_id", others.alias("others")))
    result, _ = saved(whole.select(F.col("vec_id").alias("query_id"), F.posexplode("others").alias("_at", "_f")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_f.id").alias("vec_id"), (-F.col("_f.s")).alias("score")))
    for path in (classes_at, found_at, answers_at):
        files.remove(rows.sparkSession, path)
    return result


def _best(classes: DataFrame, bases: DataFrame, looks: DataFrame, k: int, block: int) -> DataFrame:
    """``dim, h1, h2, found``: for each vector of ``looks`` the members of the best classes of ``bases`` that share a bucket with it."""
    key, by = ["dim", "h1", "h2"], ["dim", "bucket"]
    sizes = bases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_base")).join(looks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_look")), by)
    sizes, _ = saved(sizes.select(*by, F.ceil(F.col("n_base") / block).cast("int").alias("base_blocks"),
                                  F.ceil(F.col("n_look") / block).cast("int").alias("look_blocks")))
    own = lambda n: F.array(F.pmod("h1", F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = lambda x, base, look, head, first: x.join(sizes, by).select(
        *by, F.explode(base).alias("base_block"), look.alias("_looks"), F.lit(head).alias("head"), first.alias("first"), "h1", "h2",
        "embedding").select("dim", "bucket", "base_block", F.explode("_looks").alias("look_block"), "head", "first", "h1", "h2", "embedding")
    both = placed(bases, own("base_blocks"), every("look_blocks"), 0, F.col("first")).unionByName(
        placed(looks, every("base_blocks"), own("look_blocks"), 1, F.lit(0).cast("bigint")))
    keep = k + 1

    def rank(group: pa.Table) -> Iterator[pa.RecordBatch]:
        head = values(group, "head") == 1
        if head.all() or not head.any():
            return
        vectors = vectors_of(group, "embedding")
        h1, h2, first = values(group, "h1"), values(group, "h2"), values(group, "first")[~head]
        order = np.argsort(first, kind="stable")
        base = vectors[~head][order]
        b1, b2 = h1[~head][order], h2[~head][order]
        asked_at = np.flatnonzero(head)
        for a in range(0, len(asked_at), 512):
            here = asked_at[a:a + 512]
            scores = vectors[here] @ base.T
            if scores.shape[1] > keep:
                limit = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                i, j = np.nonzero(scores >= limit[:, None] - 1e-12)
            else:
                i, j = (x.ravel() for x in np.indices(scores.shape))
            # Row by row, so that equal vectors have equal scores wherever they stand; j is the order of first ids.
            score = np.einsum("ij,ij->i", vectors[here][i], base[j])
            by_score = np.lexsort((j, -score, i))
            i, j, score = i[by_score], j[by_score], score[by_score]
            best = np.arange(len(i)) - np.searchsorted(i, i) < keep
            i, j, score = i[best], j[best], score[best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), values(group, "dim")[0], dtype=np.int32)), pa.array(h1[here][i]), pa.array(h2[here][i]),
                 pa.array(b1[j]), pa.array(b2[j]), pa.array(score)], names=["dim", "h1", "h2", "b1", "b2", "score"])

    found = grouped(both, ["dim", "bucket", "base_block", "look_block"], rank, "dim int, h1 long, h2 long, b1 long, b2 long, score double")
    found = found.groupBy("dim", "h1", "h2", "b1", "b2").agg(F.max("score").alias("score"))
    members = classes.select("dim", F.col("h1").alias("b1"), F.col("h2").alias("b2"), "ids", "first")
    listed = found.join(members, ["dim", "b1", "b2"])
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "first"))
    return listed.withColumn("_place", best).where(F.col("_place") <= keep).groupBy(*key).agg(
        F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"))))).alias("found"))
