"""Mixing sources to target weights by capped water-filling (operator 7).

Each source has a weight and may be repeated ``max_epochs`` times at most. The words to share go out by weight; a source that
would get more than its cap is clamped to it and what it leaves is shared among the others, until no source is above its cap. With the
sources in order of ``cap / weight`` that is a prefix of clamped sources, found by running sums instead of a loop.

A source's target is met by taking all its documents ``floor(target / size)`` times and some of them once more. Those come in the
order of a seeded hash, up to the document whose middle passes what is left, so the words taken are within half of one
document of the target. The order is found by counts of hash buckets: no source is sorted or gathered in one task.

Nulls: a text that is null has size 0, a null source is a source of its own (the last), a row without doc_id is drawn by its text.
Rows that repeat are rows of their own. A source without words has target 0. An empty table gives no rows. Columns of the input
beyond the four that are read are kept by ``repeated`` and do not disturb ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptide.llm.common import fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded hash as hexadecimal text, of the text where there is no id: else all such rows would stand in one hash bucket."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), text), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes (source, source_size)`` with ``target``; weights go to the sources by code point, null last, and repeat."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))))
    ranked = sizes.select("source", "source_size", weight.alias("weight"), rank.alias("rank"),
                          (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("clamped_before"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    )
    clamped = (F.col("budget") - F.col("clamped_before")) * F.col("weight") > F.col("cap") * F.col("weight_left")
    marked = sums.select("*", clamped.alias("clamped")).select(
        "*",
        F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything).alias("clamped_sum"),
        F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).over(everything).alias("free_weight"),
    )
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(
        (F.col("budget") - F.col("clamped_sum")) * F.col("weight") / F.col("free_weight"))
    return marked.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def _times(sized: DataFrame, weights, share, max_epochs) -> DataFrame:
    """``sized (source, size, drawn, ...)`` with ``source_size``, ``target`` and how often each row is taken, ``times``."""
    bucket = F.substring("drawn", 1, 4)
    buckets = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    goals = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    goals = goals.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.expr("nullif(source_size, 0)")), F.lit(0)).cast("bigint").alias("whole"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(F.col("source").alias("_from"), F.col("bucket").alias("_bucket"),
                            F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)).alias("start"))
    starts = starts.join(goals, F.col("_from").eqNullSafe(F.col("_source"))).drop("_source")
    joined = sized.withColumn("bucket", bucket).join(
        starts, F.col("source").eqNullSafe(F.col("_from")) & (F.col("bucket") == F.col("_bucket"))).drop("_from", "_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    left = F.col("target") - F.col("whole") * F.col("source_size")
    extra = F.when((F.col("size") > 0) & (middle <= left), 1).otherwise(0)
    return joined.withColumn("times", (F.col("whole") + extra).cast("bigint")).drop("bucket", "start", "whole")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs (doc_id, text, source)``."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("drawn"))
    times = _times(sized, weights, share, max_epochs)
    return times.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0,
             seed: int = 7) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    The times are joined back by draw, document, size and source, so texts are not sorted; rows alike in all four are taken alike.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("drawn"))
    doc, came, words, by, often, copy = fresh(docs, "doc", "came", "words", "by", "often", "copy")
    times = _times(sized, weights, share, max_epochs).groupBy(
        F.col("doc_id").alias(doc), F.col("source").alias(came), F.col("size").alias(words), F.col("drawn").alias(by)).agg(F.max("times").alias(often))
    kept = docs.join(times.where(F.col(often) > 0), docs["doc_id"].eqNullSafe(F.col(doc)) & docs["source"].eqNullSafe(F.col(came))
                     & (draw(docs["doc_id"], docs["text"], seed) == F.col(by)) & (word_count(docs["text"]) == F.col(words)))
    return kept.select("*", F.explode(F.sequence(F.lit(1), F.col(often))).alias(copy)).select(*docs.columns)
