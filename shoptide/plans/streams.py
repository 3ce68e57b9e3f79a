"""Registered streaming queries: the given tables arrive in waves and each wave is a run of the stream."""

from __future__ import annotations

from datetime import timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.functions.entities import parse_strict
from shoptide.operators import dim, dwd, dws
from shoptide.plans.queries import (AS_OF, _money_as_double, _without_every_13th, detail_envelopes, enriched_sku, with_no_dimensions, with_no_sku)
from shoptide.schemas import ORDER_DETAIL, ORDER_INFO, ORDER_WIDE, only
from shoptide.session import SETTINGS
from shoptide.sinks import files
from shoptide.sinks.messages import drop_wave, publish_wave, stage_waves
from shoptide.sources.messages import read_topic
from shoptide.sources.tables import ShopTables
from shoptide.streaming import jobs
from shoptide.streaming.jobs import Warehouse
from shoptide.streaming.runner import Pipeline, settings

CODE_LIMIT = "spark.sql.codegen.hugeMethodLimit"
DETAIL_ID_RANGE = 1 << 60
WAVES = 3
#: Orders that come between two batches of a join in time, so that its state, which is in memory, has a bounded size.
ORDERS_PER_BATCH = 500_000


def cdc_route_stream(spark: SparkSession, folder: str) -> DataFrame:
    w = _routed(spark, folder)
    wanted = only(ORDER_DETAIL, "id", "order_id", "sku_num", "order_price")
    routed = read_topic(spark, w.path, "ods_order_detail")
    lines = routed.select("topic", F.from_json("value", ", ".join(f"{n} string" for n, _, _ in wanted)).alias("v"))
    return lines.select("topic", *[F.col(f"v.{c}").cast("bigint").alias(c) for c in ("id", "order_id", "sku_num")],
                        F.col("v.order_price").cast("double").alias("price"))


def cdc_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """What the routing job could not read."""
    return _routed(spark, folder).quarantine("ods_array").read("messages").select("value")


def dim_sync_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension rows in waves, a row's older version after a newer one; SKUs come last, with every 13th trademark missing."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    old = F.struct(F.lit("2021-01-01").cast("timestamp").alias("timestamp"), F.lit(1).alias("wave"), F.lit("old ").alias("was"))
    new = F.struct(F.lit("2021-01-02").cast("timestamp").alias("timestamp"), F.lit(1).alias("wave"), F.lit("").alias("was"))
    spus = shop.spu_info().select("*", F.explode(F.array(new, old)).alias("_v")).select(
        "id", F.concat("_v.was", "spu_name").alias("spu_name"), "_v.timestamp", "_v.wave")
    once = lambda rows, wave: rows.withColumns({"timestamp": F.lit("2021-01-01").cast("timestamp"), "wave": F.lit(wave)})
    trademarks = _without_every_13th(shop.base_trademark()).withColumnRenamed("id", "tm_id")
    wave = F.col("wave")
    _run_in_waves(w, [(once(shop.user_info(), 0), "ods_user_info", wave), (once(shop.province_info(), 0), "ods_base_province", wave),
                      (once(shop.base_category3(), 0), "ods_base_category3", wave), (once(trademarks, 0), "ods_base_trademark", wave),
                      (spus, "ods_spu_info", wave), (once(shop.sku_info(), 2), "ods_sku_info", wave)], jobs.sync_dimensions(w))
    return w.skus.read()


def order_enriched_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in waves by id; who has ordered in one wave is known in the next, whatever the times of the orders."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    w.provinces.upsert(_without_every_13th(shop.province_info()), 0)
    w.users.upsert(dim.derive_user(_without_every_13th(shop.user_info()), AS_OF), 0)
    rows = shop.order_heads().drop("create_date", "create_hour").withColumn("timestamp", F.to_timestamp("create_time"))
    _run_in_waves(w, [(rows, "ods_order_info", F.pmod("id", F.lit(WAVES)))], jobs.order_facts(w))
    wanted = only(ORDER_INFO, "id", "user_id", "province_id", "create_date", "create_hour", "is_first_order", "province_name", "user_age_group", "user_gender")
    return parse_strict(read_topic(spark, w.path, "dwd_order_info"), wanted)


def order_wide_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stream-stream join; waves are cut by arrival, so some details come a wave after their order. The state has ids and times, the columns are joined to the pairs."""
    shop = ShopTables(spark, folder)
    w = _joined_stream(shop, shop.detail_messages(60), dws.wide_outer_stream, only(ORDER_INFO, "id"), only(ORDER_DETAIL, "id", "order_id"))
    found = parse_strict(read_topic(spark, w.path, "wide"), [(c, "bigint", None) for c in ("order_id", "owner_id", "order_detail_id")])
    pairs, _, _ = dws.outer_kinds(found)
    orders = parse_strict(read_topic(spark, w.path, "order"), only(ORDER_INFO, "id", "user_id")).withColumnRenamed("id", "order_id")
    details = parse_strict(read_topic(spark, w.path, "detail"), only(ORDER_DETAIL, "id", "sku_id", "sku_num")).withColumnRenamed("id", "order_detail_id")
    return pairs.join(orders, "order_id").join(details, "order_detail_id").select("order_id", "order_detail_id", "user_id", "sku_id", "sku_num")


def order_wide_outer_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All orders and details as pairs or as expired ones: every 13th order and every 11th order's details never come, every 5th order's come an hour apart."""
    shop = ShopTables(spark, folder)
    order = F.col("order_id")
    details = shop.detail_messages(60).where(order % 11 != 0)
    details = details.withColumn("timestamp", F.when(order % 5 == 0, F.col("timestamp") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("timestamp")))
    w, group = _in_time(shop, details, "id % 13 <> 0")
    none = F.lit(None).cast("bigint").alias("order_detail_id")
    pairs = parse_strict(read_topic(spark, w.path, "dws_order_wide_in_time"), only(ORDER_WIDE, "order_id", "order_detail_id"))
    found = (pairs.select(F.lit("pair").alias("kind"), "order_id", "order_detail_id")
             .unionByName(w.expired(group).read("orders").select(F.lit("order").alias("kind"), "order_id", none))
             .unionByName(w.expired(group).read("details").select(F.lit("detail").alias("kind"), "order_id", "order_detail_id")))
    return found.where("order_id >= 0")


def order_wide_windowed_stream(spark: SparkSession, folder: str) -> DataFrame:
    shop = ShopTables(spark, folder)
    w = _joined_stream(shop, shop.detail_messages(5, -5), dws.wide_join_windowed_stream)
    return parse_strict(read_topic(spark, w.path, "wide"), only(ORDER_WIDE, "order_id", "order_detail_id", "user_id", "sku_id", "sku_num"))


def order_wide_share_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Join and allocation over waves: orders come in any wave, details by id, and every 5th detail is sent again in the last wave."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    third = F.call_function("div", F.col("id"), F.lit(DETAIL_ID_RANGE // WAVES + 1))
    _wide_orders(w, shop.order_info(), _twice(shop.order_detail(), third))
    wanted = only(ORDER_WIDE, "order_id", "order_detail_id", "final_total_amount", "original_total_amount", "sku_price",
                  "sku_num", "final_detail_amount")
    return _money_as_double(parse_strict(read_topic(spark, w.path, "dws_order_wide"), wanted))


def unmatched_details(spark: SparkSession, folder: str) -> DataFrame:
    """Details that still wait, where every 13th order has not come."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    _wide_orders(w, shop.order_info().where("id % 13 <> 0"), shop.order_detail().withColumn("wave", F.pmod("id", F.lit(WAVES)).cast("int")))
    return jobs.unmatched_details(w).select("id", "order_id", "sku_id", "sku_num", F.col("order_price").cast("double").alias("order_price"))


def trademark_amount_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Wide rows in waves, with a time for each two batches: a later batch replaces the sums of the same time and trademark."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    details = shop.order_detail().withColumn("tm", F.col("sku_id") % 25)
    wave = F.pmod("order_id", F.lit(WAVES))
    wave = F.when((wave == 1) & (F.col("tm") % 2 == 1), 2).otherwise(wave).cast("int")
    wide = details.select(F.col("id").alias("order_detail_id"), F.col("tm").alias("tm_id"), F.concat(F.lit("tm-"), "tm").alias("tm_name"),
                          (F.col("order_price") * F.col("sku_num")).cast("decimal(16,2)").alias("final_detail_amount"),
                          F.current_timestamp().alias("timestamp"), wave.alias("wave"))
    job = jobs.trademark_amounts(w, stamp=lambda batch_id: F.lit(f"2021-01-01 00:00:0{batch_id // 2}"))
    _run_in_waves(w, [(wide, "dws_order_wide", F.col("wave"))], job)
    return _money_as_double(w.results.current("tm_amount"))


def trademark_amount_once_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of each wave, where every 5th wide row of an earlier wave is sent again in the last one and is not summed again."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    details = shop.order_detail().withColumn("tm", F.col("sku_id") % 25)
    wide = details.select(F.col("id").alias("order_detail_id"), "id", F.col("tm").alias("tm_id"), F.concat(F.lit("tm-"), "tm").alias("tm_name"),
                          (F.col("order_price") * F.col("sku_num")).cast("decimal(16,2)").alias("final_detail_amount"), F.current_timestamp().alias("timestamp"))
    job = jobs.trademark_amounts(w, stamp=lambda batch_id: F.lit(f"2021-01-01 00:00:0{batch_id}"), once=True)
    wide = _twice(wide, F.pmod("id", F.lit(WAVES)).cast("bigint")).drop("id")
    _run_in_waves(w, [(wide, "dws_order_wide", F.col("wave"))], job)
    return _money_as_double(w.results.current("tm_amount"))


def trademark_amount_windows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sums by window of the orders' time: waves follow that time, but every 7th order comes a wave later, among rows up to years younger."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    details = dwd.enrich_detail(shop.order_detail(), enriched_sku(shop))
    shares = dws.order_shares(with_no_dimensions(shop.order_info()), details, shop.order_detail())
    year = F.substring("create_time", 1, 4).cast("int")
    wave = F.when(year < 1994, 0).when(year < 1997, 1).otherwise(2) + F.when(F.col("order_id") % 7 == 0, 1).otherwise(0)
    wide = shares.select("order_detail_id", "order_id", "tm_id", "tm_name", "final_detail_amount", "create_time", F.current_timestamp().alias("timestamp"),
                         F.least(wave, F.lit(WAVES - 1)).alias("wave"))
    _run_in_waves(w, [(wide, "dws_order_wide", F.col("wave"))], jobs.trademark_windows(w, lateness="3000 days"))
    return _money_as_double(w.windows.read().withColumn("window_start", F.col("window_start").cast("string")))


def wide_rows_clustered(spark: SparkSession, folder: str) -> DataFrame:
    """Wide rows appended in waves by order, each in Morton order of time and province, and read back."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    orders = shop.order_heads().select(F.col("id").alias("order_id"), "province_id", "create_time")
    details = shop.order_detail().select(F.col("id").alias("order_detail_id"), "order_id", "sku_id", "sku_num")
    wide = details.join(orders, "order_id").withColumns({"timestamp": F.current_timestamp(), "wave": F.pmod("order_id", F.lit(WAVES))})
    _run_in_waves(w, [(wide, "dws_order_wide", F.col("wave"))], jobs.wide_archive(w))
    return w.archive.read("wide").select("order_detail_id", "order_id", "province_id", "create_time", "sku_id", "sku_num")


def dau_first_start_stream(spark: SparkSession, folder: str) -> DataFrame:
    """First starts per day and device, over starts in waves by user."""
    w = _started(spark, folder)
    kept = read_topic(spark, w.path, "dau").select(F.from_json("value", "log_date string, mid string").alias("v"))
    return kept.select("v.log_date", "v.mid")


def dau_index_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the processing day after all waves: of each device the last day it started on."""
    w = _warehouse(spark)
    _run_in_waves(w, [(_starts(spark, folder), "start", F.col("wave"))], jobs.daily_actives(w, "start"))
    docs = w.index.read()
    return docs.select("doc_id", F.get_json_object("source", "$.log_date").alias("log_date"))


def dau_bitmap_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Active devices by day and by week from bitmaps, and how many of them were active the day or week before; starts in waves by user, every 4th sent again."""
    w = _warehouse(spark)
    starts = ShopTables(spark, folder).startup_log()
    mid = F.get_json_object("value", "$.common.mid")
    wave = F.pmod(F.xxhash64(mid, F.get_json_object("value", "$.ts")), F.lit(WAVES)).cast("int")
    waves = F.when(F.pmod(F.xxhash64("value"), F.lit(4)) == 0, F.array(wave, F.lit(WAVES - 1))).otherwise(F.array(wave))
    timed = starts.select("value", F.current_timestamp().alias("timestamp"), F.explode(waves).alias("wave"))
    _run_in_waves(w, [(timed, "start", F.col("wave"))], jobs.active_bitmaps(w, "start"))
    day, week = (w.actives.counts(span).withColumn("span", F.lit(span)) for span in ("day", "week"))
    return day.unionByName(week).select("span", F.col("start").cast("string").alias("start"), "devices", "returned")


def waiting_in_state(spark: SparkSession, folder: str) -> DataFrame:
    """What the join in time holds alone in its state after two of three waves; a detail comes with a third of the numbers of its order, its order with another."""
    shop, w = ShopTables(spark, folder), _warehouse(spark)
    job = jobs.wide_orders_in_time(w, retain="4000 days", early="4000 days", lateness="4000 days", large_state=True)
    third = F.pmod(F.floor(F.col("order_id") / WAVES), F.lit(WAVES))
    _run_in_waves(w, [(with_no_dimensions(shop.order_messages()), "dwd_order_info", F.pmod("id", F.lit(WAVES))),
                      (with_no_sku(shop.detail_messages(60)), "dwd_order_detail", third)], job, WAVES - 1)
    return jobs.waiting_in_state(w, f"{w.root}/checkpoints", job.group)


def _routed(spark: SparkSession, folder: str) -> Warehouse:
    w = _warehouse(spark)
    lines = detail_envelopes(ShopTables(spark, folder))
    timed = lines.select("value", F.current_timestamp().alias("timestamp"), F.pmod(F.xxhash64("value"), F.lit(WAVES)).cast("int").alias("wave"))
    _run_in_waves(w, [(timed, "changes", F.col("wave"))], jobs.route_arrays(w, "changes"))
    return w


def _wide_orders(w: Warehouse, orders: DataFrame, details: DataFrame) -> None:
    now = F.current_timestamp()
    infos = with_no_dimensions(orders).withColumns({"timestamp": now, "wave": F.pmod("id", F.lit(WAVES)).cast("int")})
    lines = with_no_sku(details).withColumn("timestamp", now)
    _run_in_waves(w, [(infos, "dwd_order_info", F.col("wave")), (lines, "dwd_order_detail", F.col("wave"))], jobs.wide_orders(w), keep=False)


def _twice(details: DataFrame, wave: Column) -> DataFrame:
    """Every 5th row comes once more in the last wave."""
    waves = F.when(F.col("id") % 5 == 0, F.array(wave, F.lit(WAVES - 1).cast("bigint"))).otherwise(F.array(wave))
    return details.withColumn("wave", F.explode(waves))


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    starts = ShopTables(spark, folder).startup_log()
    when = F.timestamp_millis(F.get_json_object("value", "$.ts").cast("bigint"))
    return starts.select("value", when.alias("timestamp"), F.least(F.lit(WAVES - 1), F.call_function("div", F.dayofmonth(when) - 1, F.lit(10))).alias("wave"))


def _started(spark: SparkSession, folder: str) -> Warehouse:
    w = _warehouse(spark)
    job = jobs.daily_actives(w, "start")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        w.send(batch.select(F.lit("dau").alias("topic"), F.to_json(F.struct("*")).alias("value")), batch_id, "dau")

    _run_in_waves(w, [(_starts(spark, folder), "start", F.col("wave"))], Pipeline("dau", "3 seconds", job.source, each_batch))
    return w


def _in_time(shop: ShopTables, details: DataFrame, come: str) -> tuple[Warehouse, str]:
    """The join in time over waves of equal time; an order and a detail long after all others let the watermark pass these."""
    w = _warehouse(shop.spark)
    job = jobs.wide_orders_in_time(w)
    orders, details = with_no_dimensions(shop.order_messages().where(come)), with_no_sku(details)
    arrivals = _arrivals(shop).where(come)
    cut, waves = _time_cuts(arrivals)
    last = arrivals.agg(F.max("timestamp").alias("timestamp")).where("timestamp IS NOT NULL").select((F.col("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("timestamp"))
    inputs = [(orders, "dwd_order_info", cut), (details, "dwd_order_detail", cut),
              (last.select(F.lit(-1).cast("bigint").alias("id"), "timestamp"), "dwd_order_info", F.lit(waves)),
              (last.select(F.lit(-1).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("order_id"), "timestamp"), "dwd_order_detail", F.lit(waves))]
    _run_in_waves(w, inputs, job, waves + 1, empty_batches=True, one_run=waves > WAVES)
    return w, job.group


def _arrivals(shop: ShopTables) -> DataFrame:
    """Ids and arrival times of the orders of ``order_messages``, without their amounts."""
    return shop.order_heads().select("id", F.to_timestamp("create_time").alias("timestamp"))


def _time_cuts(arrivals: DataFrame, most: int = ORDERS_PER_BATCH) -> tuple[Column, int]:
    """The number of a message's wave, and how many there are: equal shares of the time the orders are from, whatever it is, and where a share has more
    than ``most`` orders, parts of it with about as many. The watermark follows the waves in time, so more of them find the same pairs."""
    low, high, n = arrivals.agg(F.min("timestamp"), F.max("timestamp"), F.count("timestamp")).first()
    cuts = {low + (high - low) * part / WAVES for part in range(1, WAVES)} if low is not None else set()
    if n > most:
        parts = -(-n // most)
        at = F.percentile_approx(F.unix_micros("timestamp"), [part / parts for part in range(1, parts)], 100 * parts)
        cuts |= {low + timedelta(microseconds=us) for us in arrivals.agg(at.alias("at"), F.min(F.unix_micros("timestamp")).alias("low")).select(F.expr("transform(at, x -> x - low)")).first()[0]}
    return sum((F.when(F.col("timestamp") >= F.lit(c), 1).otherwise(0) for c in sorted(cuts)), F.lit(0)), len(cuts) + 1


def _joined_stream(shop: ShopTables, details: DataFrame, join, order: list = ORDER_INFO, detail: list = ORDER_DETAIL) -> Warehouse:
    """Runs ``join`` over orders and ``details`` in waves of equal time; what it gives is in the topic ``wide``. ``order`` and ``detail``: the fields it reads."""
    w = _warehouse(shop.spark)

    def source() -> DataFrame:
        streams = w.streams("order", "detail")
        return join(parse_strict(streams["order"], order, keep=("timestamp",)),
                    parse_strict(streams["detail"], detail, keep=("timestamp",)))

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        w.send(batch.select(F.lit("wide").alias("topic"), F.to_json(F.struct("*")).alias("value")), batch_id, "joined")

    cut, waves = _time_cuts(_arrivals(shop))
    _run_in_waves(w, [(shop.order_messages(), "order", cut), (details, "detail", cut)], Pipeline("join", "5 seconds", source, each_batch), waves, one_run=waves > WAVES)
    return w


def _warehouse(spark: SparkSession) -> Warehouse:
    root = files.shared_folder(spark)
    return Warehouse(spark, f"{root}/tables", kind="files", path=f"{root}/messages", as_of=AS_OF)


def _run_in_waves(w: Warehouse, inputs: list[tuple[DataFrame, str, Column]], job: Pipeline, waves: int = WAVES, empty_batches: bool = False,
                  one_run: bool = False, keep: bool = True) -> None:
    """Writes the messages once, then gives out wave by wave and runs the job on it, from its own checkpoint, or in ``one_run`` on all of them, which many waves need:
    a run of its own for each would load the state anew from all the changes before. Unless ``keep`` is set, a wave's messages go once its run has ended."""
    staged = None
    for rows, topic, wave in inputs:
        value = F.col("value") if "value" in rows.columns else F.to_json(F.struct(*[c for c in rows.columns if c not in ("timestamp", "wave")]))
        part = rows.select(F.lit(topic).alias("topic"), value.alias("value"), "timestamp", wave.cast("int").alias("wave"))
        staged = part if staged is None else staged.unionByName(part)
    with settings(w.spark, {CODE_LIMIT: SETTINGS[CODE_LIMIT]}):
        stage_waves(staged, w.path, "in")
    checkpoints, partitions = f"{w.root}/checkpoints", w.spark.sparkContext.defaultParallelism
    # Inner joins and dedupe emit nothing in a batch without data, so it can be left to the next wave to drop old state.
    with settings(w.spark, {"spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}):
        if one_run:
            job.feed(w.spark, checkpoints, [partial(publish_wave, w.spark, w.path, "in", wave) for wave in range(waves)], partitions)
            return
        for wave in range(waves):
            publish_wave(w.spark, w.path, "in", wave)
            job.drain(w.spark, checkpoints, state_partitions=partitions)
            if not keep:
                drop_wave(w.spark, w.path, "in", wave)


STREAM_QUERIES = {f.__name__: f for f in (
    cdc_route_stream, cdc_quarantine, dim_sync_stream, order_enriched_stream, order_wide_stream, order_wide_outer_stream, order_wide_windowed_stream,
    order_wide_share_stream, unmatched_details, trademark_amount_stream, trademark_amount_once_stream, trademark_amount_windows_stream, dau_first_start_stream, dau_index_stream, dau_bitmap_counts,
    waiting_in_state, wide_rows_clustered)}
