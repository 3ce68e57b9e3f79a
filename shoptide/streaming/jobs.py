"""The warehouse's streaming jobs, layer by layer."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.functions.entities import order_times, parse_lenient, parse_strict, to_value, unreadable
from shoptide.functions.money import cents
from shoptide.operators import ads, dau, dim, dwd, dws, ods
from shoptide.plans.skew import hot_groups
from shoptide.schemas import (BASE_CATEGORY3, BASE_TRADEMARK, ORDER_DETAIL, ORDER_INFO, ORDER_WIDE, PROVINCE_INFO,
                              SKU_INFO, SPU_INFO, USER_INFO, ddl, names, only)
from shoptide.sinks import index, jdbc
from shoptide.sinks.actives import ActiveDevices
from shoptide.sinks.clustering import clustered
from shoptide.sinks.messages import write_batch
from shoptide.sinks.seen import SeenIds
from shoptide.sinks.tables import BatchTables, KeyedTable
from shoptide.sources.messages import read_stream
from shoptide.streaming.runner import Pipeline, free_shuffles, held

NEWEST = ["timestamp", "offset"]
USER_ROW = ddl([*USER_INFO, ("age_group", "string", None), ("gender_name", "string", None)])
TRADEMARK_ROW = "`id` string, `tm_name` string"
#: A detail that waits for its order is kept as JSON; one that has its share only as its amounts.
LINES = "`order_detail_id` bigint, `order_id` bigint, `waiting` string, `origin_cents` bigint, `pay_cents` bigint"
AMOUNTS = "`stat_time` string, `tm_id` bigint, `tm_name` string, `amount` decimal(26,2)"
WINDOW_KEY = "`window_start` timestamp, `tm_id` bigint, `tm_name` string"
WINDOW_AMOUNTS = f"{WINDOW_KEY}, `amount` decimal(26,2)"
READ_UP_TO = "`group_id` string, `last_batch` bigint"
#: The topics of the dimension tables.
DIMENSIONS = ("ods_user_info", "ods_base_province", "ods_sku_info", "ods_spu_info", "ods_base_category3", "ods_base_trademark")


@dataclass
class Warehouse:
    """Where messages come from and go to, and the tables the jobs keep.

    The tables belong to the checkpoints of the jobs: a job started over without its checkpoint needs a new ``root``, and fails on an old one.
    Tables that a batch looks keys up in stand in ``folders`` folders by key; give as many as keep one at some hundred megabytes.
    """

    spark: SparkSession
    root: str
    kind: str = "kafka"
    path: str | None = None
    servers: str | None = None
    per_trigger: int | None = None
    as_of: date | None = None
    folders: int = 8

    def __post_init__(self) -> None:
        def keyed(name: str, keys: list[str], columns: str, folders: int = 0, by: list[str] | None = None) -> KeyedTable:
            return KeyedTable(self.spark, f"{self.root}/{name}", keys, columns, folders=folders, by=by)

        self.users = keyed("dim_user", ["id"], USER_ROW, self.folders)
        self.provinces = keyed("dim_province", ["id"], ddl(PROVINCE_INFO))
        self.spus = keyed("dim_spu", ["id"], ddl(SPU_INFO))
        self.categories = keyed("dim_category3", ["id"], ddl(BASE_CATEGORY3))
        self.trademarks = keyed("dim_trademark", ["id"], TRADEMARK_ROW)
        self.skus = keyed("dim_sku", ["id"], ddl(SKU_INFO), self.folders)
        self.user_status = keyed("user_status", ["user_id"], "`user_id` string, `is_first_order` boolean", self.folders)
        self.orders = keyed("orders_seen", ["id"], ddl(ORDER_INFO), self.folders)
        self.lines = keyed("order_lines", ["order_detail_id"], LINES, self.folders, ["order_id"])
        self.timed_orders = keyed("orders_in_time", ["id"], ddl(ORDER_INFO), self.folders)
        self.timed_details = keyed("details_in_time", ["id"], ddl(ORDER_DETAIL), self.folders)
        self.windows = keyed("tm_windows", ["window_start", "tm_id", "tm_name"], WINDOW_AMOUNTS)
        self.index = index.index_store(self.spark, f"{self.root}/index")
        self.summed = SeenIds(self.spark, f"{self.root}/ads_summed", folders=self.folders)
        self.actives = ActiveDevices(self.spark, f"{self.root}/actives", folders=self.folders)
        self.archive = BatchTables(self.spark, f"{self.root}/wide_archive", {"wide": ddl(ORDER_WIDE)})
        self.results = BatchTables(self.spark, f"{self.root}/ads", {"tm_amount": AMOUNTS, "ads_read": READ_UP_TO},
                                   {"tm_amount": ["stat_time", "tm_id"], "ads_read": ["group_id"]})

    def stream(self, *topics: str) -> DataFrame:
        return read_stream(self.spark, list(topics), self.kind, self.path, self.servers, per_trigger=self.per_trigger)

    def streams(self, *topics: str) -> dict[str, DataFrame]:
        """One stream per topic."""
        return {topic: self.stream(topic) for topic in topics}

    def send(self, messages: DataFrame, batch_id: int, job: str) -> None:
        write_batch(messages, batch_id, job, self.kind, self.path, self.servers)

    def quarantine(self, group: str) -> BatchTables:
        """Messages of a job that could not be read."""
        return BatchTables(self.spark, f"{self.root}/quarantine/{group}", {"messages": "`value` string"})

    def late(self, group: str) -> BatchTables:
        """Messages of a job that came when their window was closed."""
        return BatchTables(self.spark, f"{self.root}/late/{group}", {"rows": f"{WINDOW_KEY}, `value` string"})

    def expired(self, group: str) -> BatchTables:
        """Orders and details of a job that waited too long for the other side."""
        return BatchTables(self.spark, f"{self.root}/expired/{group}", {"orders": "`order_id` bigint", "details": "`order_id` bigint, `order_detail_id` bigint"})

    def readable(self, group: str, batch_id: int, *frames: tuple[DataFrame, str]) -> list[DataFrame]:
        """The rows that have their key; the messages of all others, which ``parsed`` keeps as ``value``, go to the quarantine of the batch."""
        bad = None
        for rows, key in frames:
            left_out = rows.where(unreadable(rows, key)).select("value")
            bad = left_out if bad is None else bad.unionByName(left_out)
        self.quarantine(group).commit(batch_id, {"messages": bad})
        return [rows.where(~unreadable(rows, key)).drop("value") for rows, key in frames]


def parsed(rows: DataFrame, key: str) -> DataFrame:
    """Rows parsed with their message, ``value``, of which only unreadable ones are kept, so that rows can be held instead of messages."""
    return rows.withColumn("value", F.when(unreadable(rows, key), F.col("value")))


def route_arrays(w: Warehouse, topic: str, group: str = "ods_array") -> Pipeline:
    """Array envelopes to one topic per table."""
    return _router(w, topic, group, ods.ARRAY_ENVELOPE, ods.ARRAY_OPS)


def route_objects(w: Warehouse, topic: str, group: str = "ods_object") -> Pipeline:
    """Object envelopes to one topic per table."""
    return _router(w, topic, group, ods.OBJECT_ENVELOPE, ods.OBJECT_OPS)


def _router(w: Warehouse, topic: str, group: str, kind: str, ops: list[str]) -> Pipeline:
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        envelopes = ods.read_envelopes(batch, kind, keep=("timestamp",))
        with held(envelopes.where(F.expr("NOT readable") | ods.wanted(ops))) as envelopes:
            w.quarantine(group).commit(batch_id, {"messages": envelopes.where("NOT readable").select(F.col("unread").alias("value"))})
            w.send(ods.route(ods.rows_of(envelopes, kind, keep=("timestamp",)), ops), batch_id, group)

    return Pipeline(group, "3 seconds", lambda: w.stream(topic), each_batch)


def sync_dimensions(w: Warehouse, group: str = "dim_sync") -> Pipeline:
    """Dimension topics, mixed in one stream, to keyed tables; SKU rows are completed from the lookups just saved."""
    entities = dict(zip(DIMENSIONS, (USER_INFO, PROVINCE_INFO, SKU_INFO, SPU_INFO, BASE_CATEGORY3, BASE_TRADEMARK)))

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            rows = [(parse_strict(batch.where(F.col("topic") == topic), entity, keep=("timestamp", "offset", "value")), entity[0][0])
                    for topic, entity in entities.items()]
            users, provinces, skus, spus, categories, trademarks = w.readable(group, batch_id, *rows)
            w.users.upsert(dim.derive_user(users, w.as_of), batch_id, NEWEST)
            w.provinces.upsert(provinces, batch_id, NEWEST)
            w.spus.upsert(spus, batch_id, NEWEST)
            w.categories.upsert(categories, batch_id, NEWEST)
            w.trademarks.upsert(dim.trademark_rows(trademarks), batch_id, NEWEST)
            newest = dim.latest(skus, ["id"], NEWEST)
            with held(newest):
                ids = lambda column: newest.select(F.col(column).alias("id")).distinct()
                w.skus.upsert(dim.enrich_sku(newest, w.spus.lookup(ids("spu_id")), w.categories.lookup(ids("category3_id")),
                                             w.trademarks.lookup(ids("tm_id"))), batch_id)

    return Pipeline(group, "60 seconds", lambda: w.stream(*DIMENSIONS), each_batch)


def detail_facts(w: Warehouse, group: str = "dwd_order_detail") -> Pipeline:
    """Details with their SKU columns."""
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with held(parsed(parse_lenient(batch, ORDER_DETAIL, keep=("value",)), "id")) as rows:
            details, = w.readable(group, batch_id, (rows, "id"))
            skus = w.skus.lookup(details.select(F.col("sku_id").cast("string").alias("id")).distinct())
            w.send(to_value(dwd.enrich_detail(details, skus), "dwd_order_detail", "id"), batch_id, group)

    return Pipeline(group, "5 seconds", lambda: w.stream("ods_order_detail"), each_batch)


def order_facts(w: Warehouse, group: str = "dwd_order_info") -> Pipeline:
    """Orders flagged and enriched; users of orders that survive become known.

    User status is read as it was before this batch, so a replay flags the same orders. Of the users only those of the batch are read.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with held(parsed(parse_lenient(batch, ORDER_INFO, keep=("value",)), "id")) as rows:
            orders = order_times(w.readable(group, batch_id, (rows, "id"))[0])
            users = orders.select(F.col("user_id").cast("string").alias("user_id")).distinct()
            with held(users):
                status = w.user_status.lookup(users, batch_id)
                enriched = dwd.enrich_order(orders, w.provinces.read(), w.users.lookup(users.withColumnRenamed("user_id", "id")), status, w.as_of)
                with held(enriched):
                    w.send(to_value(enriched, "dwd_order_info", "id"), batch_id, group)
                    w.user_status.upsert(dwd.user_status_rows(enriched), batch_id)

    return Pipeline(group, "3 seconds", lambda: w.stream("ods_order_info"), each_batch)


def wide_orders(w: Warehouse, group: str = "dws_order_wide") -> Pipeline:
    """Orders joined with details, and the paid amount allocated.

    Whatever comes first waits for the other side in a table, without a time limit: a detail until its order comes, an order for further
    details. A detail that has its share stays known by its id, so one that is sent again is left out, and an order's totals are
    the sums over its known details. Each batch looks up only the orders it is about, so the result does not depend on how messages
    fall into batches, on how far one of the topics is behind, or on clocks.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        keep = ("value", "timestamp", "offset")
        # The parsed rows are held, not the messages: reading these twice takes less than keeping them.
        with held(parsed(parse_strict(batch.where("topic = 'dwd_order_info'"), ORDER_INFO, keep=keep), "id")) as a, \
                held(parsed(parse_strict(batch.where("topic = 'dwd_order_detail'"), ORDER_DETAIL, keep=keep), "id")) as b:
            infos, details = w.readable(group, batch_id, (a, "id"), (b, "id"))
            arrived = dim.latest(infos, ["id"], NEWEST).select(*names(ORDER_INFO))
            ids = arrived.select(F.col("id").alias("order_id")).union(details.select("order_id")).distinct()
            with held(arrived), held(ids), held(w.lines.lookup(ids, batch_id)) as lines:
                earlier = w.orders.lookup(ids.withColumnRenamed("order_id", "id"), batch_id).join(arrived.select("id"), "id", "left_anti")
                orders = arrived.unionByName(earlier.select(*arrived.columns))
                waiting = parse_strict(lines.where("waiting IS NOT NULL"), ORDER_DETAIL, value="waiting").withColumns(
                    {"timestamp": F.lit(None).cast("timestamp"), "offset": F.lit(None).cast("bigint")})
                done = lines.where("waiting IS NULL")
                known = done.select(F.col("order_detail_id").alias("id"))
                # Of versions of a detail the newest counts; one that waits came before all of this batch.
                versions = details.select(*names(ORDER_DETAIL), *NEWEST).unionByName(waiting)
                new = dim.latest(versions, ["id"], NEWEST).drop(*NEWEST).join(known, "id", "left_anti")
                totals = done.groupBy("order_id").agg(F.sum("origin_cents").alias("origin_cents"), F.sum("pay_cents").alias("pay_cents"))
                with held(new), held(hot_groups(new, "order_id", "id")) as hot, \
                        held(dws.batch_shares(dws.wide_join(orders, new), totals, None if hot.isEmpty() else hot)) as shares:
                    w.send(to_value(dws.wide_rows(shares), "dws_order_wide", "order_detail_id"), batch_id, group)
                    free_shuffles(w.spark)  # those under the frames held so far, which stand on disk besides
                    found = shares.select(
                        "order_detail_id", "order_id", F.lit(None).cast("string").alias("waiting"),
                        (F.col("sku_num") * cents(F.col("sku_price"))).alias("origin_cents"),
                        F.coalesce(cents(F.col("final_detail_amount")), F.lit(0)).alias("pay_cents"))
                    still = new.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_anti").select(
                        F.col("id").alias("order_detail_id"), "order_id", F.to_json(F.struct(*names(ORDER_DETAIL))).alias("waiting"),
                        F.lit(0).cast("bigint").alias("origin_cents"), F.lit(0).cast("bigint").alias("pay_cents"))
                    w.orders.upsert(arrived, batch_id)
                    free_shuffles(w.spark)
                    w.lines.upsert(found.unionByName(still), batch_id)

    return Pipeline(group, "5 seconds", lambda: w.stream("dwd_order_info", "dwd_order_detail"), each_batch)

def wide_orders_in_time(w: Warehouse, retain: str = "30 minutes", early: str = "30 minutes", lateness: str = "30 minutes",
                        group: str = "dws_order_wide_in_time", large_state: bool = False) -> Pipeline:
    """Wide rows of orders and details that arrive within a time of each other, and what has waited too long.

    The other way to join them, with bounded state: the stream-stream join holds ids and times, and what it lets go unmatched is written to ``w.expired(group)``,
    so every order and detail that comes before the watermark ends as a wide row or there. Their columns wait in keyed tables and are looked up by batch.
    With times so long that most of what came is waiting, ``large_state`` keeps it off the heap.
    """
    entities = {"dwd_order_info": ORDER_INFO, "dwd_order_detail": ORDER_DETAIL}
    keep = ("value", "timestamp", "offset")

    def source() -> DataFrame:
        streams = w.streams(*entities)
        ids = {"dwd_order_info": [("id", "bigint", None)], "dwd_order_detail": [("id", "bigint", None), ("order_id", "bigint", None)]}
        orders, details = (parse_strict(streams[t], ids[t], keep=("timestamp",)).where("id IS NOT NULL") for t in ids)
        found = dws.wide_outer_stream(orders, details, retain=retain, early=early, lateness=lateness).withColumn("topic", F.lit(None).cast("string"))
        for topic, entity in entities.items():
            rows = parsed(parse_strict(streams[topic], entity, keep=keep), "id")
            # A row is one value here: held by columns, most of them null, it would take several times the work.
            found = found.unionByName(rows.select(F.lit(topic).alias("topic"), F.struct(*names(entity), *keep).alias(f"{topic}_row")), allowMissingColumns=True)
        return found

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            paired = F.col("order_id").isNotNull() & F.col("order_detail_id").isNotNull()
            kind = F.when(F.col("topic").isNotNull(), "message").when(paired, "pair").otherwise("alone").alias("kind")
            # Counting works all of it out at once. What a batch has none of isn't written: most batches that only move the watermark have next to nothing.
            kinds = {row[0] for row in batch.groupBy(kind).count().collect()}
            if "message" in kinds:
                came, lines_came = (batch.where(F.col("topic") == topic).select(f"{topic}_row.*") for topic in entities)
                infos, lines = w.readable(group, batch_id, (came, "id"), (lines_came, "id"))
                w.timed_orders.upsert(infos, batch_id, NEWEST)
                w.timed_details.upsert(lines, batch_id, NEWEST)
            pairs, orders, details = dws.outer_kinds(batch.where("topic IS NULL").select("order_id", "owner_id", "order_detail_id"))
            if "pair" in kinds:
                with w.timed_orders.rows_of(pairs.select(F.col("order_id").alias("id")), batch_id) as a, \
                        w.timed_details.rows_of(pairs.select(F.col("order_detail_id").alias("id")), batch_id) as b:
                    met = b.join(pairs.withColumnRenamed("order_detail_id", "id"), ["id", "order_id"], "left_semi")
                    w.send(to_value(dws.wide_join(a, met), "dws_order_wide_in_time", "order_detail_id"), batch_id, group)
            if "alone" in kinds:
                w.expired(group).commit(batch_id, {"orders": orders, "details": details})

    return Pipeline(group, "5 seconds", source, each_batch, large_state=large_state)


def waiting_in_state(w: Warehouse, checkpoints: str, group: str = "dws_order_wide_in_time", salts: int = dws.SALTS) -> DataFrame:
    """``kind, order_id, order_detail_id``: the orders and details that :func:`wide_orders_in_time` holds alone at the end of its last batch.

    Read from the state of the checkpoint, while the job runs or not. What has met the other side may still be in the state, but it is marked as matched.
    An order stands there in parts, and waits if all of them do.
    """
    at = f"{checkpoints}/{group}"
    joins = w.spark.read.format("state-metadata").load(at).where("operatorName = 'symmetricHashJoin'")
    operator, = [row[0] for row in joins.select("operatorId").distinct().collect()]

    def alone(side: str, *ids: str) -> DataFrame:
        state = w.spark.read.format("statestore").option("operatorId", operator).option("storeName", f"{side}-keyWithIndexToValue").load(at)
        return state.where("NOT value.matched").select(*[f"value.{i}" for i in ids])

    orders = alone("left", "id").groupBy(F.col("id").alias("order_id")).count().where(F.col("count") >= salts)
    details = alone("right", "order_id", "id")
    return (orders.select(F.lit("order").alias("kind"), "order_id", F.lit(None).cast("bigint").alias("order_detail_id"))
            .unionByName(details.select(F.lit("detail").alias("kind"), "order_id", F.col("id").alias("order_detail_id"))))


def unmatched_details(w: Warehouse) -> DataFrame:
    """Details whose order has not come yet."""
    return parse_strict(w.lines.read().where("waiting IS NOT NULL"), ORDER_DETAIL, value="waiting")


@dataclass(frozen=True)
class Database:
    """A database that takes the results instead of the warehouse's own tables."""

    url: str
    driver: str
    amounts: jdbc.Target
    read_up_to: jdbc.Target
    options: dict[str, str]


def trademark_amounts(w: Warehouse, group: str = "ads_order_wide", stamp: Callable[[int], Column] | None = None,
                      database: Database | None = None, once: bool = False) -> Pipeline:
    """Sum of each batch by trademark, which replaces one of the same time and trademark, saved together with the batch it was read up to.

    With ``once`` a wide row that is sent again in a later batch is not summed again: ``w.summed`` knows all ids that were.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        wanted = only(ORDER_WIDE, "order_detail_id", "tm_id", "tm_name", "final_detail_amount")
        no_default = [(name, kind, None if name == "order_detail_id" else default) for name, kind, default in wanted]
        with held(parsed(parse_strict(batch, no_default, keep=("value",)), "order_detail_id")) as rows:
            wide, = w.readable(group, batch_id, (rows, "order_detail_id"))
            key = "order_detail_id"
            with w.summed.unseen(wide, key, batch_id) if once else nullcontext(wide.dropDuplicates([key])) as wide:
                amounts = ads.trademark_amount(wide, stamp and stamp(batch_id))
                read = w.spark.createDataFrame([(group, batch_id)], READ_UP_TO)
                if database is None:
                    w.results.commit(batch_id, {"tm_amount": amounts, "ads_read": read})
                else:
                    jdbc.replace_in_one_transaction(batch_id, [(amounts, database.amounts), (read, database.read_up_to)], database.url,
                                                    database.driver, **database.options)
                if once:
                    # A batch that fails before this is replayed whole, and still sees only what was noted before it.
                    w.summed.note(wide.select(F.col(key).alias("id")), batch_id)

    return Pipeline(group, "5 seconds", lambda: w.stream("dws_order_wide"), each_batch)


def trademark_windows(w: Warehouse, width: str = "5 seconds", lateness: str = "1 hour", group: str = "ads_trademark_windows") -> Pipeline:
    """Sums by trademark and window of the orders' time, in a state that Spark keeps until the watermark has passed a window.

    Each batch replaces the sums that changed in ``w.windows``. A row that comes when its window is closed goes to ``w.late(group)``: the batch
    brings its rows beside the sums, and a row is late exactly if the sum of its window and trademark is none of those that changed.
    """
    key = ["window_start", "tm_id", "tm_name"]

    def source() -> DataFrame:
        wanted = only(ORDER_WIDE, "order_detail_id", "tm_id", "tm_name", "final_detail_amount", "create_time")
        plain = [(name, kind, None if name in ("order_detail_id", "create_time") else default) for name, kind, default in wanted]
        rows = parse_strict(w.stream("dws_order_wide"), plain, keep=("value",)).withColumn("event_time", F.try_to_timestamp("create_time"))
        readable = F.col("order_detail_id").isNotNull() & F.col("event_time").isNotNull()
        start = lambda row: F.window("event_time", width)["start"].alias("window_start")
        sums = rows.where(readable).withWatermark("event_time", lateness).groupBy(F.window("event_time", width), "tm_id", "tm_name").agg(
            F.sum("final_detail_amount").alias("amount"))
        empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
        return (sums.select(F.lit("sum").alias("kind"), F.col("window.start").alias("window_start"), "tm_id", "tm_name", "amount", empty("string", "value"))
                .unionByName(rows.where(readable).select(F.lit("row").alias("kind"), start(rows), "tm_id", "tm_name", empty("decimal(26,2)", "amount"), "value"))
                .unionByName(rows.where(~readable).select(F.lit("unread").alias("kind"), empty("timestamp", "window_start"), "tm_id", "tm_name",
                                                          empty("decimal(26,2)", "amount"), "value")))

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            sums = batch.where("kind = 'sum'").select(*key, "amount")
            late = batch.where("kind = 'row'").join(sums.select(*key), key, "left_anti").select(*key, "value")
            w.quarantine(group).commit(batch_id, {"messages": batch.where("kind = 'unread'").select("value")})
            w.late(group).commit(batch_id, {"rows": late})
            w.windows.upsert(sums, batch_id)

    return Pipeline(group, "5 seconds", source, each_batch, "update", large_state=True)


def wide_archive(w: Warehouse, group: str = "wide_archive", rows_per_file: int = 2_000_000) -> Pipeline:
    """Wide rows appended to ``w.archive``, those of a batch in Morton order of time and province, so that reads by either skip most of it.

    A batch is there once, however often it is replayed; a wide row sent again in a later batch is there twice, as in any append.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        no_default = [(name, kind, None if name == "order_detail_id" else default) for name, kind, default in ORDER_WIDE]
        with held(parsed(parse_strict(batch, no_default, keep=("value",)), "order_detail_id")) as rows:
            wide, = w.readable(group, batch_id, (rows, "order_detail_id"))
            by = {"time": "unix_micros(try_to_timestamp(create_time))", "province": "province_id"}
            w.archive.commit(batch_id, {"wide": clustered(wide, by, ["order_detail_id"], rows_per_file=rows_per_file)})

    return Pipeline(group, "60 seconds", lambda: w.stream("dws_order_wide"), each_batch)


def daily_actives(w: Warehouse, topic: str, zone: str = "UTC", group: str = "dau") -> Pipeline:
    """First start per day and device to the index of the processing day, by device; of several days in a batch the last stays."""
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        index.index_upsert(w.index, batch, "dau", batch_id, None, "mid", ("ts",))

    return Pipeline(group, "3 seconds",
                    lambda: dau.first_start_stream(dau.parse_startup(w.stream(topic), zone, keep=("timestamp",))), each_batch)


def active_bitmaps(w: Warehouse, topic: str, zone: str = "UTC", group: str = "dau_bitmaps") -> Pipeline:
    """Active devices by day, kept as bitmaps in ``w.actives``: no watermark, a start counts for its day however late it comes."""
    return Pipeline(group, "3 seconds", lambda: dau.parse_startup(w.stream(topic), zone), lambda batch, batch_id: w.actives.add(batch, batch_id))
