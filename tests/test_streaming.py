"""The jobs on folders of messages: whole way, lateness, replay."""

import json
from collections import Counter
from contextlib import contextmanager
from datetime import date
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from shoptide.functions.entities import parse_strict
from shoptide.schemas import ORDER_DETAIL, ORDER_INFO, ORDER_WIDE
from shoptide.plans import streams
from shoptide.sinks import files
from shoptide.sinks.messages import publish_wave, stage_waves, write_batch
from shoptide.sinks.tables import KeyedTable
from shoptide.sources.messages import read_topic
from shoptide.streaming import jobs
from shoptide.streaming.runner import Pipeline

T0 = 1_609_459_200


@pytest.fixture
def warehouse(spark, folder):
    return jobs.Warehouse(spark, f"{folder}/tables", kind="files", path=f"{folder}/messages", as_of=date(2021, 1, 1))


def put(w, topic, batch, *bodies, at=T0):
    rows = [(topic, b if isinstance(b, str) else json.dumps(b, ensure_ascii=False)) for b in bodies]
    df = w.spark.createDataFrame(rows, "topic string, value string").withColumn("timestamp", F.timestamp_seconds(F.lit(at)))
    write_batch(df, batch, f"in_{topic}", "files", w.path)


def drain(w, job):
    job.drain(w.spark, f"{w.root}/checkpoints", state_partitions=2)


def cdc(table, *data, op="insert"):
    return {"table": table, "type": op, "data": list(data)}


def order(number, user, final, original, created="2021-01-01 10:00:00", province="1"):
    return {"id": str(number), "province_id": province, "order_status": "1001", "user_id": str(user),
            "final_total_amount": final, "benefit_reduce_amount": "0", "original_total_amount": original, "feight_fee": "0",
            "expire_time": created, "create_time": created}


def detail(number, order_id, price, num=1, sku="1"):
    return {"id": str(number), "order_id": str(order_id), "sku_id": sku, "order_price": price, "sku_num": str(num),
            "sku_name": "own", "create_time": "2021-01-01 10:00:00"}


def test_whole_way(warehouse):
    w = warehouse
    put(w, "cdc_a", 0,
        cdc("BASE_TRADEMARK", {"tm_id": "20", "tm_name": "brand"}),
        cdc("base_category3", {"id": "30", "name": "c3", "category2_id": "0"}),
        cdc("spu_info", {"id": "10", "spu_name": "spu"}),
        cdc("sku_info", {"id": "1", "spu_id": "10", "price": "5", "sku_name": "s", "tm_id": "20", "category3_id": "30", "create_time": "t"},
            {"id": "2", "spu_id": "99", "price": "5", "sku_name": "s", "tm_id": "20", "category3_id": "30", "create_time": "t"}),
        cdc("base_province", {"id": "1", "name": "p", "area_code": "a", "iso_code": "i"}),
        cdc("user_info", {"id": "7", "user_level": "1", "birthday": "1990-01-01", "gender": "F"}),
        cdc("order_info", order(1, 7, "89.00", "99.00"), order(2, 7, "10.00", "10.00", "2021-01-01 09:00:00")),
        cdc("order_info", order(3, 7, "1", "1"), op="update"),
        cdc("order_detail", detail(11, 1, "33.00"), detail(12, 1, "33.00"), detail(13, 1, "33.00"), detail(21, 2, "10.00"), detail(22, 2, "5.00", sku="2")))
    put(w, "cdc_b", 0, {"table": "order_info", "type": "insert", "data": order(4, 8, "1", "1")}, "not json")
    routers = [jobs.route_arrays(w, "cdc_a"), jobs.route_objects(w, "cdc_b")]
    later = [jobs.sync_dimensions(w), jobs.detail_facts(w), jobs.order_facts(w), jobs.wide_orders(w), jobs.trademark_amounts(w)]
    for job in routers + later:
        drain(w, job)

    orders = parse_strict(read_topic(w.spark, w.path, "dwd_order_info"), ORDER_INFO).collect()
    assert {o.id: (o.is_first_order, o.province_name, o.user_gender, o.create_hour) for o in orders} == {
        1: (False, "p", "女", "10"), 2: (True, "p", "女", "09")}
    assert [tuple(r) for r in w.user_status.read().select("user_id").collect()] == [("7",)]
    wide = parse_strict(read_topic(w.spark, w.path, "dws_order_wide"), ORDER_WIDE).collect()
    assert {r.order_detail_id: (float(r.final_detail_amount), r.tm_name, r.sku_name) for r in wide} == {
        11: (29.67, "brand", "own"), 12: (29.67, "brand", "own"), 13: (29.66, "brand", "own"), 21: (10.0, "brand", "own")}
    amounts = w.results.current("tm_amount").collect()
    assert [(r.tm_id, r.tm_name, float(r.amount)) for r in amounts] == [(20, "brand", 99.0)]
    assert [tuple(r) for r in w.results.current("ads_read").collect()] == [("ads_order_wide", 0)]
    assert [r["value"] for r in w.quarantine("ods_object").read("messages").collect()] == ["not json"]

    # A later batch: the user is known now, though this order was created before the others.
    put(w, "cdc_a", 1, cdc("order_info", order(5, 7, "6.00", "6.00", "2020-12-31 08:00:00")), cdc("order_detail", detail(51, 5, "6.00")))
    for job in routers[:1] + later:
        drain(w, job)
    orders = parse_strict(read_topic(w.spark, w.path, "dwd_order_info"), ORDER_INFO).collect()
    assert {o.id: o.is_first_order for o in orders} == {1: False, 2: True, 5: False}
    assert sorted(float(r.amount) for r in w.results.current("tm_amount").collect()) == [6.0, 99.0]


def test_what_waits_too_long_comes_out_as_expired(warehouse):
    w = warehouse
    job = jobs.wide_orders_in_time(w, lateness="0 seconds")
    batches = [
        ([(1, 0)], [(21, 2, 0), (91, 9, 0)]),
        ([(2, 600), (4, 600)], [(11, 1, 600), (12, 1, 1790)]),
        ([(3, 1800)], [(13, 1, 1860), (31, 3, 1800)]),
        ([(8, 90_000)], [(81, 8, 90_000)]),
    ]
    for number, (orders, details) in enumerate(batches):
        for key, at in orders:
            put(w, "dwd_order_info", number * 10 + key, {"id": key, "user_id": 70 + key}, at=T0 + at)
        for key, owner, at in details:
            put(w, "dwd_order_detail", number * 100 + key, {"id": key, "order_id": owner, "sku_id": key * 2}, at=T0 + at)
        drain(w, job)
    wide = parse_strict(read_topic(w.spark, w.path, "dws_order_wide_in_time"), ORDER_WIDE)
    seen = sorted((r.order_id, r.order_detail_id, r.user_id, r.sku_id) for r in wide.collect())
    assert seen == [(1, 11, 71, 22), (1, 12, 71, 24), (2, 21, 72, 42), (3, 31, 73, 62), (8, 81, 78, 162)]
    expired = w.expired("dws_order_wide_in_time")
    assert [r.order_id for r in expired.read("orders").collect()] == [4]
    assert sorted((r.order_id, r.order_detail_id) for r in expired.read("details").collect()) == [(1, 13), (9, 91)]


def shares(w):
    rows = parse_strict(read_topic(w.spark, w.path, "dws_order_wide"), ORDER_WIDE).collect()
    return sorted((r.order_detail_id, float(r.final_detail_amount)) for r in rows)


def info(number, final, original):
    return {"id": number, "user_id": 7, "final_total_amount": final, "original_total_amount": original}


def line(number, owner, price=33):
    return {"id": number, "order_id": owner, "order_price": price, "sku_num": 1}


def test_details_sent_again_change_nothing(warehouse):
    w = warehouse
    job = jobs.wide_orders(w)
    put(w, "dwd_order_info", 0, info(1, 89, 99))
    put(w, "dwd_order_detail", 0, line(11, 1), line(12, 1))
    drain(w, job)
    put(w, "dwd_order_detail", 1, line(12, 1), line(13, 1), line(13, 1))
    put(w, "dwd_order_info", 1, info(1, 89, 99))
    drain(w, job)
    put(w, "dwd_order_detail", 2, line(11, 1), line(13, 1))
    drain(w, job)
    assert shares(w) == [(11, 29.67), (12, 29.67), (13, 29.66)]
    keys = read_topic(w.spark, w.path, "dws_order_wide").collect()
    assert sorted(r.key for r in keys) == ["11", "12", "13"]


def test_the_newest_version_of_a_detail_counts(warehouse):
    w = warehouse
    messages = [("dwd_order_info", json.dumps(info(1, 60, 60)), 0), ("dwd_order_detail", json.dumps(line(11, 1, 20)), 1),
                ("dwd_order_detail", json.dumps(line(11, 1, 30)), 3), ("dwd_order_detail", json.dumps(line(11, 1, 10)), 2),
                ("dwd_order_detail", json.dumps(line(21, 2, 7)), 4)]
    rows = w.spark.createDataFrame(messages, "topic string, value string, offset long").withColumn("timestamp", F.timestamp_seconds(F.lit(T0)))
    each_batch = jobs.wide_orders(w).each_batch
    each_batch(rows, 0)
    assert shares(w) == [(11, 30.0)]
    later = w.spark.createDataFrame([("dwd_order_info", json.dumps(info(2, 9, 9)), 5), ("dwd_order_detail", json.dumps(line(21, 2, 9)), 6)],
                                    "topic string, value string, offset long").withColumn("timestamp", F.timestamp_seconds(F.lit(T0)))
    each_batch(later, 1)  # a version that waited gives way to one that comes with the order
    assert shares(w) == [(11, 30.0), (21, 9.0)]


def test_either_side_waits_however_long(warehouse):
    w = warehouse
    job = jobs.wide_orders(w)
    put(w, "dwd_order_detail", 0, line(21, 2, 10), at=T0)
    drain(w, job)
    assert [(r.id, r.order_id) for r in jobs.unmatched_details(w).collect()] == [(21, 2)]
    put(w, "dwd_order_info", 0, info(1, 5, 10), at=T0 + 10 * 86400)
    drain(w, job)
    put(w, "dwd_order_info", 1, info(2, 10, 10), at=T0 + 20 * 86400)
    drain(w, job)
    put(w, "dwd_order_detail", 1, line(12, 1, 10), at=T0 - 30 * 86400)
    drain(w, job)
    assert shares(w) == [(12, 5.0), (21, 10.0)] and jobs.unmatched_details(w).count() == 0


def test_a_batch_that_runs_again_sends_the_same(warehouse):
    w = warehouse
    each_batch = jobs.wide_orders(w).each_batch
    messages = w.spark.createDataFrame(
        [("dwd_order_info", json.dumps(info(1, 89, 99)), 0), *[("dwd_order_detail", json.dumps(line(i, 1)), i) for i in (11, 12, 13)]],
        "topic string, value string, offset long").withColumn("timestamp", F.timestamp_seconds(F.lit(T0)))
    for batch, rows in ((0, messages.where("offset < 13")), (0, messages.where("offset < 13")), (1, messages.where("offset = 13")), (1, messages.where("offset = 13"))):
        each_batch(rows, batch)
    assert shares(w) == [(11, 29.67), (12, 29.67), (13, 29.66)]


def test_unreadable_messages_are_put_aside_by_every_layer(warehouse):
    w = warehouse
    put(w, "ods_base_province", 0, "{broken", {"id": "1", "name": "p", "area_code": "a", "iso_code": "i"})
    for topic in jobs.DIMENSIONS:
        if topic != "ods_base_province":
            put(w, topic, 0, {"id": "1", "tm_id": "1", "spu_id": "1", "category3_id": "1"})
    put(w, "ods_order_info", 0, "nothing", order(1, 1, "1", "1"))
    put(w, "ods_order_detail", 0, "[]", detail(11, 1, "1"))
    put(w, "dws_order_wide", 0, "{}", {"order_detail_id": 11, "tm_id": 1, "tm_name": "b", "final_detail_amount": 2})
    for job in (jobs.sync_dimensions(w), jobs.order_facts(w), jobs.detail_facts(w), jobs.wide_orders(w), jobs.trademark_amounts(w)):
        drain(w, job)
    aside = {g: [r["value"] for r in w.quarantine(g).read("messages").collect()] for g in ("dim_sync", "dwd_order_info", "dwd_order_detail", "ads_order_wide")}
    assert aside == {"dim_sync": ["{broken"], "dwd_order_info": ["nothing"], "dwd_order_detail": ["[]"], "ads_order_wide": ["{}"]}
    assert [r["id"] for r in w.provinces.read().collect()] == ["1"]
    assert w.users.read().first()["age_group"] is None  # no birthday


def test_a_wrong_clock_does_not_push_out_other_devices(warehouse):
    w = warehouse
    job = jobs.daily_actives(w, "start")
    start = lambda mid, at: {"common": {"mid": mid, "uid": "1"}, "ts": at * 1000}
    put(w, "start", 0, start("a", T0 + 400 * 86400), start("d", T0), at=T0)
    drain(w, job)
    put(w, "start", 1, start("b", T0 + 60), start("c", T0 + 90), start("d", T0 + 86400), start("d", T0 + 2), at=T0 + 60)
    drain(w, job)
    docs = {d.doc_id: json.loads(d.source)["log_date"] for d in w.index.read().collect()}
    assert set(docs) == {"a", "b", "c", "d"} and docs["d"] == "2021-01-02"


def test_daily_actives(warehouse):
    w = warehouse
    job = jobs.daily_actives(w, "start")
    for batch, mids in enumerate((["a", "b", "a"], ["b", "c"])):
        put(w, "start", batch, *[{"common": {"mid": m, "uid": str(batch)}, "ts": (T0 + batch) * 1000} for m in mids])
        drain(w, job)
    docs = w.index.read().collect()
    assert {d.doc_id: json.loads(d.source)["uid"] for d in docs} == {"a": "0", "b": "0", "c": "1"}


def test_newest_dimension_row_stays(warehouse):
    w = warehouse
    job = jobs.sync_dimensions(w)
    for batch, names in enumerate((["old", "newer"], ["newest"])):
        for step, name in enumerate(names):
            put(w, "ods_base_province", batch * 10 + step, {"id": "1", "name": name, "area_code": "a", "iso_code": "i"}, at=T0 + batch * 100 + step)
        for other in ("ods_user_info", "ods_sku_info", "ods_spu_info", "ods_base_category3", "ods_base_trademark"):
            put(w, other, batch, {"id": "1", "birthday": "1990-01-01", "tm_id": "1", "spu_id": "1", "category3_id": "1"})
        drain(w, job)
        assert [r["name"] for r in w.provinces.read().collect()] == [names[-1]]
    assert w.skus.read().count() == 1


def test_rows_of_closed_windows_are_kept_apart(warehouse):
    w = warehouse
    job = jobs.trademark_windows(w, width="10 seconds", lateness="20 seconds")
    wide = lambda number, tm, amount, at: {"order_detail_id": number, "tm_id": tm, "tm_name": f"tm{tm}", "final_detail_amount": amount, "create_time": at}
    put(w, "dws_order_wide", 0, wide(1, 1, 1, "2021-01-01 00:00:01"), wide(2, 1, 2, "2021-01-01 00:00:09"), wide(3, 2, 4, "2021-01-01 00:01:00"), "broken", wide(9, 1, 1, "no time"))
    drain(w, job)
    put(w, "dws_order_wide", 1, wide(4, 1, 8, "2021-01-01 00:00:05"), wide(5, 2, 16, "2021-01-01 00:00:58"), wide(6, 2, 32, "2021-01-01 00:00:45"), wide(7, 2, 64, "2021-01-01 00:00:41"))
    drain(w, job)
    sums = sorted((str(r.window_start)[14:], r.tm_id, float(r.amount)) for r in w.windows.read().collect())
    assert sums == [("00:00", 1, 3.0), ("00:40", 2, 96.0), ("00:50", 2, 16.0), ("01:00", 2, 4.0)]
    late = w.late("ads_trademark_windows").read("rows").collect()
    assert [json.loads(r.value)["order_detail_id"] for r in late] == [4]
    assert w.quarantine("ads_trademark_windows").read("messages").count() == 2
    put(w, "dws_order_wide", 2, wide(8, 2, 1, "2021-01-01 00:01:01"))
    drain(w, job)
    assert ("01:00", 2, 5.0) in [(str(r.window_start)[14:], r.tm_id, float(r.amount)) for r in w.windows.read().collect()]


def test_waiting_in_state_is_what_has_not_met(warehouse):
    w = warehouse
    job = jobs.wide_orders_in_time(w)
    put(w, "dwd_order_info", 0, {"id": 1}, {"id": 2})
    put(w, "dwd_order_detail", 0, {"id": 11, "order_id": 1}, {"id": 31, "order_id": 3})
    drain(w, job)
    waiting = lambda: {tuple(r) for r in jobs.waiting_in_state(w, f"{w.root}/checkpoints", job.group).collect()}
    assert waiting() == {("order", 2, None), ("detail", 3, 31)}
    put(w, "dwd_order_info", 1, {"id": 3})
    put(w, "dwd_order_detail", 1, {"id": 12, "order_id": 1})
    drain(w, job)
    assert waiting() == {("order", 2, None)}


def test_crowded_waves_of_a_join_in_time_are_cut_further(spark):
    seconds = [0, 90_000, *range(1000, 1040)]
    arrivals = spark.createDataFrame([(i, T0 + at) for i, at in enumerate(seconds)], "id bigint, at bigint").select("id", F.timestamp_seconds("at").alias("timestamp"))
    cut, waves = streams._time_cuts(arrivals, 10)
    numbered = arrivals.select("id", "timestamp", cut.alias("wave")).orderBy("timestamp").collect()
    sizes = Counter(row.wave for row in numbered)
    assert max(sizes.values()) <= 11 and max(sizes) == waves - 1
    assert [row.wave for row in numbered] == sorted(row.wave for row in numbered)
    assert streams._time_cuts(arrivals, 1000)[1] == streams.WAVES == streams._time_cuts(arrivals.limit(0))[1] + 2


def test_parts_fed_to_one_run_are_joined_across_parts(warehouse):
    w = warehouse
    job = jobs.wide_orders_in_time(w, lateness="0 seconds")
    parts = [lambda: (put(w, "dwd_order_info", 1, {"id": 1, "user_id": 7}, {"id": 2, "user_id": 8}), put(w, "dwd_order_detail", 1, {"id": 11, "order_id": 1})),
             lambda: (put(w, "dwd_order_detail", 2, {"id": 12, "order_id": 1}, at=T0 + 60), put(w, "dwd_order_info", 2, {"id": 3, "user_id": 9}, at=T0 + 60)),
             lambda: (put(w, "dwd_order_info", 3, {"id": 4, "user_id": 9}, at=T0 + 90_000), put(w, "dwd_order_detail", 3, {"id": 41, "order_id": 4}, at=T0 + 90_000))]
    job.feed(w.spark, f"{w.root}/checkpoints", parts, 2)
    wide = parse_strict(read_topic(w.spark, w.path, "dws_order_wide_in_time"), ORDER_WIDE)
    assert sorted((r.order_id, r.order_detail_id, r.user_id) for r in wide.collect()) == [(1, 11, 7), (1, 12, 7), (4, 41, 9)]
    assert sorted(r.order_id for r in w.expired("dws_order_wide_in_time").read("orders").collect()) == [2, 3]


def test_state_that_grows_with_all_that_came_is_beside_the_heap(warehouse):
    w = warehouse
    job = jobs.wide_orders_in_time(w, retain="4000 days", early="4000 days", lateness="4000 days", large_state=True)
    put(w, "dwd_order_info", 0, {"id": 1, "user_id": 7}, {"id": 2, "user_id": 8})
    put(w, "dwd_order_detail", 0, {"id": 11, "order_id": 1}, {"id": 91, "order_id": 9})
    drain(w, job)
    put(w, "dws_order_wide", 0, {"order_detail_id": 1, "tm_id": 1, "tm_name": "a", "final_detail_amount": "1.00", "create_time": "2021-01-01 10:00:00"})
    drain(w, jobs.trademark_windows(w))
    for group in (job.group, "ads_trademark_windows"):
        assert "RocksDBStateStoreProvider" in files.get_text(w.spark, f"{w.root}/checkpoints/{group}/offsets/0")
    waiting = jobs.waiting_in_state(w, f"{w.root}/checkpoints", job.group).collect()
    assert sorted((r.kind, r.order_id, r.order_detail_id) for r in waiting) == [("detail", 9, 91), ("order", 2, None)]
    assert [float(r.amount) for r in w.windows.read().collect()] == [1.0]


def test_messages_and_rows_are_stored_small(warehouse):
    w = warehouse
    put(w, "dwd_order_info", 0, {"id": 1, "user_id": 7})
    put(w, "dwd_order_detail", 0, {"id": 11, "order_id": 1})
    drain(w, jobs.wide_orders(w))
    written = [*Path(w.path).rglob("*.parquet"), *Path(w.root).rglob("*.parquet")]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in written if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}


def test_only_envelopes_that_go_somewhere_are_held(warehouse, monkeypatch):
    w, sizes, held = warehouse, [], jobs.held

    @contextmanager
    def counted(batch):
        with held(batch) as kept:
            sizes.append(kept.count())
            yield kept

    monkeypatch.setattr(jobs, "held", counted)
    put(w, "cdc", 0, cdc("order_info", order(1, 7, "1.00", "1.00")), cdc("order_info", order(2, 7, "1.00", "1.00"), op="update"),
        cdc("cart_info", order(3, 7, "1.00", "1.00")), cdc("order_detail", detail(11, 1, "1.00"), op="delete"), "no json")
    drain(w, jobs.route_arrays(w, "cdc"))
    assert sizes == [2]
    assert read_topic(w.spark, w.path, "ods_order_info").count() == 1
    assert [r["value"] for r in w.quarantine("ods_array").read("messages").collect()] == ["no json"]


def test_messages_of_few_topics_are_not_sorted(spark, folder, monkeypatch):
    limits, parquet = [], DataFrameWriter.parquet

    def noted(self, *args, **kwargs):
        limits.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return parquet(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(0, 400, 1, 1).select(F.concat(F.lit("t"), F.col("id") % 20).alias("topic"), F.col("id").cast("string").alias("value"), (F.col("id") % 2).alias("wave"))
    stage_waves(rows, folder, "in")
    publish_wave(spark, folder, "in", 0)
    write_batch(rows.where("wave = 1"), 1, "in", "files", folder)
    assert limits == ["8", "8"] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    # More topics than files may be open.
    assert all(read_topic(spark, folder, f"t{n}").count() == 20 for n in range(20))


def test_a_join_in_time_looks_up_only_what_came_before_its_batch(warehouse, monkeypatch):
    w, wanted, lookup = warehouse, [], KeyedTable.lookup
    monkeypatch.setattr(KeyedTable, "lookup", lambda self, ids, before=None: (wanted.extend(sorted(r[0] for r in ids.collect())), lookup(self, ids, before))[1])
    job = jobs.wide_orders_in_time(w, lateness="0 seconds")
    first = lambda: (put(w, "dwd_order_info", 1, {"id": 1, "user_id": 7}, {"id": 2, "user_id": 8}), put(w, "dwd_order_detail", 1, {"id": 11, "order_id": 1}, {"id": 21, "order_id": 2}))
    second = lambda: (put(w, "dwd_order_info", 2, {"id": 3, "user_id": 9}, {"id": 2, "user_id": 18}, at=T0 + 60),
                      put(w, "dwd_order_detail", 2, {"id": 12, "order_id": 1, "sku_num": 5}, {"id": 22, "order_id": 2}, {"id": 31, "order_id": 3}, at=T0 + 60))
    for part in (first, second):
        part()
        drain(w, job)
    assert wanted == [1, 21]  # the order of detail 12, and the detail of order 2, which came anew; all others came with their batch
    wide = parse_strict(read_topic(w.spark, w.path, "dws_order_wide_in_time"), ORDER_WIDE).collect()
    rows = sorted((r.order_id, r.order_detail_id, r.user_id, r.sku_num) for r in wide)
    assert [r for r in rows if r[0] != 2] == [(1, 11, 7, 0), (1, 12, 7, 5), (3, 31, 9, 0)]
    assert {r for r in rows if r[1] == 22} == {(2, 22, 18, 0)}


def test_batches_that_only_move_the_watermark_write_no_empty_rows(warehouse):
    w = warehouse
    job = jobs.wide_orders_in_time(w, lateness="0 seconds")
    put(w, "dwd_order_info", 1, {"id": 1})
    put(w, "dwd_order_detail", 1, {"id": 91, "order_id": 9})
    drain(w, job)
    put(w, "dwd_order_info", 2, {"id": 2}, at=T0 + 90_000)
    put(w, "dwd_order_detail", 2, {"id": 21, "order_id": 2}, at=T0 + 90_000)
    drain(w, job)
    expired = w.expired(job.group)
    assert [r.order_id for r in expired.read("orders").collect()] == [1] and [r.order_detail_id for r in expired.read("details").collect()] == [91]
    assert len(files.children(w.spark, f"{w.root}/orders_in_time/commits")) == len(files.children(w.spark, f"{w.root}/details_in_time/commits")) == 2


def test_messages_of_waves_gone_by_take_no_disk(warehouse):
    w = warehouse
    rows = lambda text: w.spark.createDataFrame([json.dumps(r) for r in text], "string").select(F.col("value"), F.get_json_object("value", "$.id").cast("int").alias("wave"))
    orders = rows([{"id": 1, "original_total_amount": "2.00", "final_total_amount": "2.00"}])
    lines = rows([{"id": i, "order_id": i, "order_price": "2.00", "sku_num": 1} for i in range(3)])
    now = F.current_timestamp()
    inputs = [(orders.withColumn("timestamp", now), "dwd_order_info", F.col("wave")), (lines.withColumn("timestamp", now), "dwd_order_detail", F.col("wave"))]
    streams._run_in_waves(w, inputs, jobs.wide_orders(w), keep=False)
    assert not list(Path(w.path, "in").rglob("*.parquet")) and not list(Path(w.path, "_staged").rglob("*.parquet"))
    assert sorted(r.id for r in jobs.unmatched_details(w).collect()) == [0, 2]
    assert [r.order_detail_id for r in parse_strict(read_topic(w.spark, w.path, "dws_order_wide"), ORDER_WIDE).collect()] == [1]


def test_state_beside_the_heap_has_a_small_bound(spark, folder):
    names, found = ["boundedMemoryUsage", "maxMemoryUsageMB", "trackTotalNumberOfRows"], {}

    def source():
        found.update({name: spark.conf.get(f"spark.sql.streaming.stateStore.rocksdb.{name}", None) for name in names})
        return spark.readStream.format("rate").load()

    Pipeline("bound", "1 second", source, lambda batch, batch_id: None, large_state=True).start(spark, folder).stop()
    assert found == {"boundedMemoryUsage": "true", "maxMemoryUsageMB": "200", "trackTotalNumberOfRows": "false"}


def test_a_join_of_ids_reads_only_ids(spark, monkeypatch):
    class Seen(Exception):
        pass

    def join(orders, details):
        raise Seen(orders.columns, details.columns)

    monkeypatch.setattr(streams.dws, "wide_outer_stream", join)
    with pytest.raises(Seen) as seen:
        streams.order_wide_stream(spark, "/root/testdata/sf0.001")
    assert seen.value.args == (["timestamp", "id"], ["timestamp", "id", "order_id"])
