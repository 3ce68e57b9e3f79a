"""Ids that have come before: an exact table, read only for ids that a Bloom filter lets through."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.sinks.tables import BatchTables
from shoptide.streaming.runner import held

PART_BITS = 32_768  # of one of Spark's bitmaps
IDS_PER_PART = PART_BITS // 10
HASHES = 7


class SeenIds:
    """Tells ids that came in earlier batches from new ones.

    The filter consists of bitmaps of 4 KiB; an id has its seven bits in one of them, so it meets one row of the filter. Ten bits an id pass
    about one new id in a hundred. When a generation of bitmaps is full, a new one of at least twice the size begins, so that holds at any number of ids, and
    there are only as many generations as doublings. What passes is looked up in the folders of these ids; a batch of new ids reads almost none.

    Ids and filter of a batch become visible together, and a replayed batch sees what was there before it. Null ids are never seen.
    """

    def __init__(self, spark: SparkSession, root: str, first: int = 1_000_000, folders: int = 8):
        self.spark, self.first = spark, first
        self.tables = BatchTables(
            spark, root,
            {"ids": "`id` bigint", "filter": "`generation` int, `part` bigint, `bits` binary", "generations": "`generation` int, `room` bigint, `used` bigint"},
            {"ids": ["id"], "filter": ["generation", "part"], "generations": ["generation"]},
            folders={"ids": (["id"], folders), "filter": (["generation", "part"], folders)})

    def seen(self, ids: DataFrame, batch_id: int | None = None) -> DataFrame:
        """The distinct ids of ``ids (id)`` that were noted, before ``batch_id`` if that is given."""
        with held(self.possible(ids, batch_id)) as passed:
            return self._noted(passed, batch_id)

    @contextmanager
    def unseen(self, rows: DataFrame, key: str, batch_id: int) -> Iterator[DataFrame]:
        """Of the ``rows`` one for each id, in the column ``key``, that was not noted before the batch.

        They and the ids that passed the filter are held, so that the look-up is made once for all that is done with them; ``rows`` should be held, too.
        """
        once = rows.dropDuplicates([key])
        if not self._generations(batch_id):
            with held(once) as new:
                yield new
            return
        with held(self.possible(rows.select(F.col(key).alias("id")), batch_id)) as passed:
            with held(once.join(self._noted(passed, batch_id).withColumnRenamed("id", key), key, "left_anti")) as new:
                yield new

    def possible(self, ids: DataFrame, batch_id: int | None = None) -> DataFrame:
        """The distinct ids that pass the filter: all that were noted, and few others."""
        generations = self._generations(batch_id)
        if not generations:
            return ids.select("id").limit(0)
        known = F.array(*[F.struct(F.lit(g).alias("generation"), F.lit(_parts(room)).alias("parts")) for g, room, _ in generations])
        asked = ids.select("id").dropna().select("id", F.explode(known).alias("g")).select("id", "g.generation", _part("g.generation", "g.parts").alias("part"))
        with held(asked.select("generation", "part").distinct()) as places:
            bits = self.tables.current("filter", batch_id, places)
        hit = None
        for position in _positions():
            byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
            one = F.getbit(byte, position.bitwiseAND(F.lit(7)).cast("int")) == 1
            hit = one if hit is None else hit & one
        # The bitmaps of a task's parts are few, and its ids need not be sorted to meet them.
        return asked.join(bits.hint("shuffle_hash"), ["generation", "part"]).where(hit).select("id").distinct()

    def note(self, ids: DataFrame, batch_id: int) -> None:
        """Notes ``ids (id)``, which should be those that :meth:`seen` left."""
        with held(ids.select("id").dropna().distinct()) as new:
            n = new.count()
            generations = self._generations(batch_id)
            generation, room, used = generations[-1] if generations else (0, max(self.first, n), 0)
            if used + n > room:
                generation, room, used = generation + 1, max(2 * room, n), 0
            of = F.lit(generation).alias("generation")
            placed = new.select("id", of, F.lit(_parts(room)).alias("parts")).select(
                _part("generation", "parts").alias("part"), *[position.alias(f"p{k}") for k, position in enumerate(_positions())])
            # The ids of a part meet before their bits are set: a bitmap of each part from each task would be far more than the ids.
            sets = placed.repartition("part").groupBy("part").agg(F.array(*[F.bitmap_construct_agg(f"p{k}") for k in range(HASHES)]).alias("sets"))
            bits = sets.select(of, "part", F.explode("sets").alias("bits"))
            if used:
                bits = self.tables.current("filter", batch_id, placed.select(of, "part").distinct()).unionByName(bits)
            merged = bits.groupBy("generation", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
            size = self.spark.createDataFrame([(generation, room, used + n)], "generation int, room bigint, used bigint")
            self.tables.commit(batch_id, {"ids": new, "filter": merged, "generations": size})

    def _noted(self, passed: DataFrame, batch_id: int | None) -> DataFrame:
        """Ids are written once, or again by a batch that says the same, so the versions of one need no ranking."""
        return self.tables.matching("ids", batch_id, passed).select("id").distinct()

    def _generations(self, before: int | None) -> list[tuple[int, int, int]]:
        return sorted(tuple(row) for row in self.tables.current("generations", before).collect())


def _parts(room: int) -> int:
    return -(-room // IDS_PER_PART)


def _part(generation: str, parts: str) -> Column:
    return F.pmod(F.xxhash64("id", F.col(generation)), F.col(parts)).cast("bigint")


def _positions() -> list[Column]:
    """The bits of an id in its part."""
    return [F.pmod(F.xxhash64("id", F.lit(-1 - k)), F.lit(PART_BITS)).cast("bigint") for k in range(HASHES)]
