"""Bitmaps of active devices and the filter before the table of ids, against sets."""

from pyspark.sql import functions as F

from shoptide.sinks.actives import ActiveDevices
from shoptide.sinks.seen import SeenIds


def ids_of(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "id bigint")


def test_only_ids_of_earlier_batches_are_seen(spark, folder):
    known = SeenIds(spark, folder, first=100)
    assert known.seen(ids_of(spark, [1, 2])).count() == 0
    known.note(ids_of(spark, [1, 2, 2, None]), 0)
    known.note(spark.range(1000, 6000), 1)
    known.note(spark.range(10_000, 10_050), 2)
    assert [r.id for r in known.seen(ids_of(spark, [1, 2, 3, None, 5999, 6000, 10_049, 1])).orderBy("id").collect()] == [1, 2, 5999, 10_049]
    assert {r.id for r in known.seen(ids_of(spark, [1, 1000]), 1).collect()} == {1}
    # A replay changes nothing.
    known.note(ids_of(spark, [77]), 1)
    assert known.seen(ids_of(spark, [77])).count() == 0
    generations = known._generations(None)
    assert len(generations) == 3 and all(used <= room for _, room, used in generations)


def test_new_ids_read_no_file_of_old_ones(spark, folder):
    known = SeenIds(spark, folder, folders=4)
    known.note(spark.range(20_000), 0)
    new = spark.range(1_000_000, 1_000_050)
    assert known.possible(new).count() <= 3
    assert known.possible(spark.range(100)).count() == 100
    passed = known.possible(spark.range(1_000_000, 1_020_000)).count()
    assert passed < 20_000 * 0.03
    none = new.join(known.possible(new), "id", "left_anti").limit(0).cache()
    assert known.tables.current("ids", wanted=none).inputFiles() == []


def starts_of(spark, rows):
    return spark.createDataFrame(rows, "log_date string, mid string")


def test_bitmaps_equal_sets(spark, folder):
    actives = ActiveDevices(spark, folder, shards=3, folders=2)
    first = [("2021-01-03", "a"), ("2021-01-03", "b"), ("2021-01-03", "b"), (None, "a"), ("2021-01-03", None)]
    second = [("2021-01-04", "a"), ("2021-01-04", "c"), ("2021-01-03", "d"), ("2021-02-01", "a")]
    actives.add(starts_of(spark, first), 0)
    actives.add(starts_of(spark, second), 1)
    actives.add(starts_of(spark, second), 1)
    actives.add(starts_of(spark, first), 2)
    found = {span: {(str(r.start), r.devices, r.returned) for r in actives.counts(span).collect()} for span in ("day", "week", "month")}
    assert found["day"] == {("2021-01-03", 3, 0), ("2021-01-04", 2, 1), ("2021-02-01", 1, 0)}
    assert found["week"] == {("2020-12-28", 3, 0), ("2021-01-04", 2, 1), ("2021-02-01", 1, 0)}
    assert found["month"] == {("2021-01-01", 4, 0), ("2021-02-01", 1, 1)}
    asked = starts_of(spark, [("2021-01-03", "d"), ("2021-01-04", "d"), ("2021-01-04", "c"), ("2021-01-05", "a"), ("2021-01-03", "x"), (None, "a")])
    assert {tuple(r) for r in actives.active(asked).collect()} == {("2021-01-03", "d"), ("2021-01-04", "c")}


def test_a_shard_of_many_parts(spark, folder):
    actives = ActiveDevices(spark, folder, shards=1)
    many = spark.range(70_000).select(F.lit("2021-01-03").alias("log_date"), F.concat(F.lit("m"), "id").alias("mid"))
    actives.add(many, 0)
    actives.add(many.where("mid LIKE '%7'").withColumn("log_date", F.lit("2021-01-04")), 1)
    assert actives.tables.current("days").count() == 6
    assert {(r.devices, r.returned) for r in actives.counts("day").collect()} == {(70_000, 0), (7000, 7000)}


def test_no_starts(spark, folder):
    actives = ActiveDevices(spark, folder)
    actives.add(starts_of(spark, []), 0)
    assert actives.counts("day").count() == 0 and actives.active(starts_of(spark, [("2021-01-03", "a")])).count() == 0


def test_rows_of_unseen_ids_are_looked_up_once(spark, folder):
    known = SeenIds(spark, folder, first=100)
    rows = lambda numbers: spark.createDataFrame([(n, f"r{n}") for n in numbers], "row bigint, text string")
    with known.unseen(rows([1, 2, 2]), "row", 0) as new:
        assert sorted(map(tuple, new.select("row", "text").collect())) == [(1, "r1"), (2, "r2")]
        known.note(new.select(F.col("row").alias("id")), 0)
    known.note(spark.range(1000, 1300), 1)
    with known.unseen(rows([2, 3, 3, 1299, 1300]), "row", 2) as new:
        assert new.storageLevel.useMemory
        assert "LeftAnti" not in new.groupBy("text").count()._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
        assert sorted(map(tuple, new.select("row", "text").collect())) == [(3, "r3"), (1300, "r1300")]
    with known.unseen(rows([1, 1000]), "row", 1) as new:  # a replay sees what was there before
        assert [r.row for r in new.collect()] == [1000]


def test_bits_are_set_where_the_ids_of_a_part_are(spark, folder, monkeypatch):
    known, plans = SeenIds(spark, folder, first=100), []
    commit = known.tables.commit

    def seen_plan(batch_id, frames, *more):
        plans.append(frames["filter"]._jdf.queryExecution().sparkPlan().toString())
        return commit(batch_id, frames, *more)

    monkeypatch.setattr(known.tables, "commit", seen_plan)
    known.note(spark.range(50), 0)
    known.note(spark.range(20, 90), 1)
    for plan in plans:
        assert plan.index("bitmap_construct_agg") < plan.index("REPARTITION_BY_COL") and "Generate explode" not in plan[plan.index("REPARTITION_BY_COL"):]
    assert known.possible(spark.range(90)).count() == 90 == known.seen(spark.range(200)).count()
