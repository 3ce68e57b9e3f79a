"""Rows in Morton order: files that are narrow in each column, and codes against a plain version."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shoptide.sinks.clustering import CODE, clustered, quantiles, with_code
from shoptide.sinks.tables import BatchTables
from shoptide.streaming import jobs
from shoptide.streaming.jobs import Warehouse

BY = {"time": "at", "province": "province"}


def row_groups(folder, column):
    """Least and greatest value of a column in each row group, by its statistics."""
    found = []
    for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            stats = next(c.statistics for c in map(meta.row_group(g).column, range(meta.num_columns)) if c.path_in_schema == column)
            found.append((stats.min, stats.max))
    return found


def test_codes_equal_interleaved_places(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice([None, draw.randrange(1000)]), draw.choice([None, 1, 1, 1, 2, draw.randrange(30)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, at bigint, province bigint")
    number, cuts = quantiles(df, BY, 3)
    assert number == 500 and all(len(c) == 7 for c in cuts.values())

    def plain(at, province):
        t, p = (sum(c <= v for c in cuts[n]) if v is not None else 0 for n, v in (("time", at), ("province", province)))
        return int("".join(a + b for a, b in zip(f"{t:03b}", f"{p:03b}")), 2)

    assert {r.id: r[CODE] for r in with_code(df, BY, cuts, 3).collect()} == {i: plain(at, p) for i, at, p in rows}


def test_reads_by_either_column_skip_most_row_groups(spark, folder):
    # A third of the rows is of one province.
    df = spark.range(120_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("at"), F.when(F.col("id") % 3 == 0, 7).otherwise(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400))).cast("bigint").alias("province"))
    tables = BatchTables(spark, folder, {"wide": "`id` bigint, `at` bigint, `province` bigint"})
    tables.commit(0, {"wide": clustered(df, BY, ["id"], rows_per_file=800)})
    back = tables.read("wide")
    assert back.drop("batch_id").exceptAll(df).isEmpty() and back.count() == 120_000
    times, provinces = row_groups(f"{folder}/data", "at"), row_groups(f"{folder}/data", "province")
    assert len(times) >= 140
    for low in (0, 333_000, 700_000, 990_000):
        assert sum(a <= low + 1000 and b >= low for a, b in times) <= 0.2 * len(times)
    for wanted in (0, 100, 250, 399):
        assert sum(a <= wanted <= b for a, b in provinces) <= 0.2 * len(provinces)
    plan = back.where("province = 100")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(province,100)" in plan


def test_equal_rows_go_over_many_files_and_none_is_fine(spark, folder):
    same = spark.range(4000).select("id", F.lit(None).cast("bigint").alias("at"), F.lit(3).cast("bigint").alias("province"))
    sizes = [len(p) for p in clustered(same, BY, ["id"], rows_per_file=500).rdd.glom().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000
    assert clustered(same.limit(0), BY, ["id"]).count() == 0


def test_archive_holds_a_batch_once_and_puts_unreadable_messages_aside(spark, folder):
    w = Warehouse(spark, f"{folder}/tables", kind="files", path=f"{folder}/messages")
    job = jobs.wide_archive(w, rows_per_file=50)
    rows = [('{"order_detail_id":%d,"order_id":%d,"province_id":%d,"create_time":"2021-01-%02d 10:00:00"}' % (i, i // 3, i % 25, i % 28 + 1),) for i in range(200)]
    rows += [('{"order_detail_id":200,"create_time":"some day"}',), ("no row",), (None,)]
    batch = spark.createDataFrame(rows, "value string")
    for batch_id in (0, 0, 1):
        job.each_batch(batch, batch_id)
    found = w.archive.read("wide")
    assert found.groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 201), (1, 201)]
    assert found.where("batch_id = 0").select("order_detail_id").distinct().count() == 201
    assert found.where("create_time = 'some day'").count() == 2
    assert w.quarantine("wide_archive").read("messages").where("batch_id = 0").count() == 2
