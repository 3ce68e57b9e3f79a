"""Registered batch queries: every operator over the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.functions.entities import order_times, parse_lenient, parse_strict, to_value
from shoptide.operators import ads, dau, dim, dwd, dws, ods
from shoptide.schemas import ORDER_DETAIL, ORDER_INFO, only
from shoptide.sinks import files, index, ledger
from shoptide.sinks.tables import BatchTables, KeyedTable
from shoptide.sources.tables import ShopTables

AS_OF = date(2021, 1, 1)


# --- change capture -------------------------------------------------------------------------------------------------

def order_envelopes(shop: ShopTables) -> DataFrame:
    """One object envelope per order: every 5th an update, every 7th a delete, every 11th a first load."""
    orders = shop.order_info()
    key = F.col("id")
    op = (F.when(key % 7 == 0, "DELETE").when(key % 5 == 0, "update").when(key % 11 == 0, "bootstrap-insert").otherwise("Insert"))
    table = F.when(key % 2 == 0, "ORDER_INFO").otherwise("order_info")
    return _object_envelope(table, op, orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns]), orders)


def detail_envelopes(shop: ShopTables) -> DataFrame:
    """One array envelope per line with the line and a free gift line; some with no or other rows, some not readable."""
    details = shop.order_detail()
    as_text = [c for c in details.columns]
    line = F.struct(*[F.col(c).cast("string").alias(c) for c in as_text])
    gift = F.struct((F.col("id") + 1).cast("string").alias("id"),
                    *[F.col(c).cast("string").alias(c) for c in as_text if c not in ("id", "order_price")],
                    F.lit("0.00").alias("order_price"))
    order = F.col("order_id")
    data = F.when(order % 17 == 0, F.array().cast(_array_of(line, details))).otherwise(F.array(line, _same_order(gift, as_text)))
    op = F.when(order % 7 == 0, "DELETE").when(order % 5 == 0, "UPDATE").otherwise("insert")
    table = F.when(order % 13 == 0, "cart_info").when(F.col("sku_id") % 2 == 0, "Order_Detail").otherwise("order_detail")
    body = F.to_json(F.struct(table.alias("table"), op.alias("type"), data.alias("data")))
    return details.select(F.when(order % 19 == 0, F.substring(body, 1, 20)).otherwise(body).alias("value"))


def cdc_object_route(spark: SparkSession, folder: str) -> DataFrame:
    shop = ShopTables(spark, folder)
    customers = shop.user_info().withColumn("_k", F.col("id").cast("bigint"))
    users = _object_envelope(F.lit("user_info"), F.when(F.col("_k") % 3 == 0, "bootstrap-insert").otherwise("update"),
                             customers.drop("_k"), customers)
    messages = order_envelopes(shop).unionByName(users)
    rows = ods.route(ods.parse_object(messages), ods.OBJECT_OPS)
    parsed = parse_lenient(rows, only(ORDER_INFO, "id", "user_id", "final_total_amount"), keep=("topic",))
    return parsed.select("topic", "id", "user_id", F.col("final_total_amount").cast("double").alias("amount"))


def cdc_array_route(spark: SparkSession, folder: str) -> DataFrame:
    rows = ods.route(ods.parse_array(detail_envelopes(ShopTables(spark, folder))), ods.ARRAY_OPS)
    parsed = parse_lenient(rows, only(ORDER_DETAIL, "id", "order_id", "sku_num", "order_price"), keep=("topic",))
    return parsed.select("topic", "id", "order_id", "sku_num", F.col("order_price").cast("double").alias("price"))


def cdc_exact_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose ids and amounts are unquoted numbers, of more digits than a double has, in array and object envelopes."""
    large = (F.col("order_price") + F.lit("99999999000000.00").cast("decimal(16,2)")).cast("decimal(16,2)")
    details = ShopTables(spark, folder).order_detail().select("id", "order_id", "sku_num", large.alias("order_price"))
    row = F.struct("id", "order_id", "sku_num", "order_price")
    body = lambda data: F.to_json(F.struct(F.lit("order_detail").alias("table"), F.lit("insert").alias("type"), data.alias("data"))).alias("value")
    half = F.col("sku_num") % 2 == 0
    rows = ods.parse_array(details.where(half).select(body(F.array(row)))).unionByName(ods.parse_object(details.where(~half).select(body(row))))
    parsed = parse_lenient(ods.route(rows, ods.ARRAY_OPS), only(ORDER_DETAIL, "id", "order_id", "order_price"), keep=("topic",))
    return parsed.select("topic", "id", "order_id", F.col("order_price").cast("string").alias("order_price"))


def cdc_malformed(spark: SparkSession, folder: str) -> DataFrame:
    return ods.malformed(detail_envelopes(ShopTables(spark, folder)), ods.ARRAY_ENVELOPE).select("value")


def order_info_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Text numbers to typed orders, with defaults, date and hour."""
    source = ShopTables(spark, folder).order_info().drop("create_date", "create_hour")
    text = to_value(source.select(*[F.col(c).cast("string").alias(c) for c in source.columns]), "ods_order_info")
    orders = order_times(parse_lenient(text, ORDER_INFO))
    return _money_as_double(orders.select("id", "province_id", "order_status", "user_id", "final_total_amount",
                                          "original_total_amount", "create_time", "operate_time", "create_date",
                                          "create_hour", "is_first_order"))


def order_detail_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Details written as JSON and read back with the strict schema."""
    text = to_value(ShopTables(spark, folder).order_detail(), "dwd_order_detail")
    return _money_as_double(parse_strict(text, ORDER_DETAIL).select(
        "id", "order_id", "sku_id", "order_price", "sku_num", "sku_name", "create_time", "spu_id", "tm_id", "category3_id"))


# --- dimensions -----------------------------------------------------------------------------------------------------

def dim_user(spark: SparkSession, folder: str) -> DataFrame:
    return dim.derive_user(ShopTables(spark, folder).user_info(), AS_OF)


def dim_sku(spark: SparkSession, folder: str) -> DataFrame:
    return enriched_sku(ShopTables(spark, folder), gaps=True)


def enriched_sku(shop: ShopTables, gaps: bool = False) -> DataFrame:
    """SKU rows completed from the lookups; with ``gaps`` every 13th trademark is missing."""
    trademarks = shop.base_trademark()
    return dim.enrich_sku(shop.sku_info(), shop.spu_info(), shop.base_category3(), _without_every_13th(trademarks) if gaps else trademarks)


def dim_upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of user versions written to a keyed table; the second replaces every third user."""
    users = ShopTables(spark, folder).user_info()
    table = KeyedTable(spark, files.shared_folder(spark), ["id"], "`id` string, `user_level` string, `version` int")
    first = (users.select("id", "user_level", F.explode(F.array(F.lit(1), F.lit(3), F.lit(2))).alias("version")))
    table.upsert(first, 0, ["version"])
    second = users.where(F.col("id").cast("bigint") % 3 == 0).select("id", F.lower("user_level").alias("user_level"), F.lit(4).alias("version"))
    table.upsert(second, 1, ["version"])
    table.upsert(second, 1, ["version"])
    return table.read()


# --- facts ----------------------------------------------------------------------------------------------------------

def order_detail_sku(spark: SparkSession, folder: str) -> DataFrame:
    shop = ShopTables(spark, folder)
    return _money_as_double(dwd.enrich_detail(shop.order_detail(), enriched_sku(shop, gaps=True)))


def order_first_flag(spark: SparkSession, folder: str) -> DataFrame:
    shop = ShopTables(spark, folder)
    flagged = dwd.flag_first_order(shop.order_heads(), known_users(shop))
    return flagged.select("id", "user_id", "create_time", "is_first_order")


def order_enriched(spark: SparkSession, folder: str) -> DataFrame:
    shop = ShopTables(spark, folder)
    return enriched(shop, shop.order_heads(), gaps=True).select("id", "user_id", "province_id", "order_status", "create_date", "create_hour",
                                       "is_first_order", "province_name", "province_area_code", "province_iso_code",
                                       "user_age_group", "user_gender")


def user_status(spark: SparkSession, folder: str) -> DataFrame:
    """Known users after one batch of orders has been recorded on top of the earlier ones."""
    shop = ShopTables(spark, folder)
    table = KeyedTable(spark, files.shared_folder(spark), ["user_id"], "`user_id` string, `is_first_order` boolean")
    table.upsert(known_users(shop), 0)
    table.upsert(dwd.user_status_rows(enriched(shop, shop.order_heads(), table.read())), 1)
    return table.read()


def known_users(shop: ShopTables) -> DataFrame:
    """Every 7th user has ordered before; the stored flag does not matter."""
    users = shop.user_info().where(F.col("id").cast("bigint") % 7 == 0)
    return users.select(F.col("id").alias("user_id"), (F.col("gender") == "F").alias("is_first_order"))


def enriched(shop: ShopTables, orders: DataFrame, status: DataFrame | None = None, gaps: bool = False) -> DataFrame:
    """Orders flagged and enriched; with ``gaps`` every 13th province and user is missing."""
    status = known_users(shop) if status is None else status
    provinces, users = shop.province_info(), shop.user_info()
    if gaps:
        provinces, users = _without_every_13th(provinces), _without_every_13th(users)
    return dwd.enrich_order(orders, provinces, users, status, AS_OF)


# --- wide orders ----------------------------------------------------------------------------------------------------

def order_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Fully enriched orders with their enriched details."""
    shop = ShopTables(spark, folder)
    wide = dws.wide_join(enriched(shop, shop.order_info()), dwd.enrich_detail(shop.order_detail(), enriched_sku(shop)))
    return _money_as_double(wide.drop("expire_time", "final_detail_amount"))


def order_wide_windowed(spark: SparkSession, folder: str) -> DataFrame:
    """Details arriving five seconds apart, with their order only if they share a four-batch window."""
    shop = ShopTables(spark, folder)
    orders = with_no_dimensions(shop.order_messages())
    details = with_no_sku(shop.detail_messages(5, -5))
    wide = dws.first_per_detail(dws.wide_join_windowed(orders, details))
    return wide.select("order_id", "order_detail_id", "user_id", "sku_id", "sku_num")


def order_wide_share(spark: SparkSession, folder: str) -> DataFrame:
    shop = ShopTables(spark, folder)
    shares = dws.order_shares(with_no_dimensions(shop.order_info()), with_no_sku(shop.order_detail()))
    return _money_as_double(shares.select("order_id", "order_detail_id", "final_total_amount", "original_total_amount",
                                          "sku_price", "sku_num", "is_last", "final_detail_amount"))


def order_wide_share_chunked(spark: SparkSession, folder: str) -> DataFrame:
    """The same allocation with a low limit for hot orders, so that a part of the orders goes by ranges of ids."""
    shop = ShopTables(spark, folder)
    shares = dws.order_shares(with_no_dimensions(shop.order_info()), with_no_sku(shop.order_detail()), min_rows=5)
    return _money_as_double(shares.select("order_id", "order_detail_id", "sku_num", "is_last", "final_detail_amount"))


def trademark_amount(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way: dimensions, wide join, allocation, sum by trademark."""
    shop = ShopTables(spark, folder)
    details = dwd.enrich_detail(shop.order_detail(), enriched_sku(shop))
    shares = dws.order_shares(enriched(shop, shop.order_info()), details, shop.order_detail())
    return _money_as_double(ads.trademark_amount(shares, F.lit("2021-01-01 00:00:00")))


def trademark_amount_windows(spark: SparkSession, folder: str) -> DataFrame:
    shop = ShopTables(spark, folder)
    details = dwd.enrich_detail(shop.order_detail(), enriched_sku(shop))
    shares = dws.order_shares(with_no_dimensions(shop.order_info()), details, shop.order_detail())
    timed = shares.withColumn("_created", F.to_timestamp_ntz("create_time"))
    sums = ads.trademark_amount_windows(timed, "_created", "5 seconds")
    return _money_as_double(sums.withColumn("window_start", F.col("window_start").cast("string")))


def trademark_amount_committed(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of two batches with one time, saved with the batch read up to: the second, which is replayed, replaces trademarks of the first."""
    shop = ShopTables(spark, folder)
    details = dwd.enrich_detail(shop.order_detail(), enriched_sku(shop))
    root = files.shared_folder(spark)
    wide = details.select("order_id", "tm_id", "tm_name", (F.col("order_price") * F.col("sku_num")).cast("decimal(16,2)").alias("final_detail_amount"))
    wide.write.parquet(f"{root}/wide")
    wide = spark.read.schema(wide.schema).parquet(f"{root}/wide")
    tables = BatchTables(spark, f"{root}/ads", {"tm_amount": "`stat_time` string, `tm_id` bigint, `tm_name` string, `amount` decimal(26,2)",
                                                "ads_read": "`group_id` string, `last_batch` bigint"},
                         {"tm_amount": ["stat_time", "tm_id"], "ads_read": ["group_id"]})
    second = (F.col("order_id") % 2 == 1) & (F.col("tm_id") % 3 != 0)
    for batch, rows in ((0, wide.where(~second)), (1, wide.where(second)), (1, wide.where(second))):
        read = spark.createDataFrame([("ads", batch)], "group_id string, last_batch long")
        tables.commit(batch, {"tm_amount": ads.trademark_amount(rows, F.lit("2021-01-01 00:00:00")), "ads_read": read})
    amounts = tables.current("tm_amount").select(F.col("stat_time").alias("row"), F.col("tm_id").alias("key"), F.col("amount").cast("double").alias("value"))
    read = tables.current("ads_read").select(F.col("group_id").alias("row"), F.lit(0).cast("bigint").alias("key"), F.col("last_batch").cast("double").alias("value"))
    return amounts.unionByName(read)


# --- daily actives and offsets --------------------------------------------------------------------------------------

def dau_first_start(spark: SparkSession, folder: str) -> DataFrame:
    return dau.first_start(dau.parse_startup(ShopTables(spark, folder).startup_log()))


def dau_index_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Starts put into daily indexes by device: the last start of a day stays."""
    logs = dau.parse_startup(ShopTables(spark, folder).startup_log(), keep=("event_id",))
    store = index.index_store(spark, files.shared_folder(spark))
    for batch, half in enumerate((F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1)):
        index.index_upsert(store, logs.where(half), "dau", batch, F.col("log_date"), "mid", ("ts", "event_id"))
    docs = store.read()
    return docs.select("index_name", "doc_id", F.get_json_object("source", "$.ts").cast("bigint").alias("ts"),
                       F.get_json_object("source", "$.event_id").cast("bigint").alias("event_id"))


def order_index_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Orders put into daily indexes by id: changed ones replace the documents of the batch before."""
    shop = ShopTables(spark, folder)
    store = index.index_store(spark, files.shared_folder(spark))
    orders = shop.order_heads().select("id", "user_id", "order_status", "create_date")
    index.index_upsert(store, orders, "order", 0, F.col("create_date"), "id")
    changed = orders.where("id % 4 = 0").withColumn("order_status", F.lit("changed"))
    index.index_upsert(store, changed, "order", 1, F.col("create_date"), "id")
    return store.read().select("index_name", "doc_id", F.get_json_object("source", "$.order_status").alias("order_status"),
                               F.get_json_object("source", "$.user_id").cast("bigint").alias("user_id"))


def offset_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets of two batches over several topics, saved, read as topic maps and taken apart again."""
    messages = ShopTables(spark, folder).table("events").select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), "ts")
    table = ledger.ledger_table(spark, files.shared_folder(spark))
    early = F.dayofmonth("ts") <= 15
    ledger.save_offsets(table, messages.where(early), "dau", 0)
    ledger.save_offsets(table, messages.where(~early), "dau", 1)
    return ledger.from_topic_maps(ledger.to_topic_maps(table.read()))


# --- helpers --------------------------------------------------------------------------------------------------------

def with_no_dimensions(orders: DataFrame) -> DataFrame:
    """Order columns the dimensions would fill, left at their defaults."""
    return orders.withColumns({name: F.lit(default).cast(kind) for name, kind, default in ORDER_INFO if name not in orders.columns})


def with_no_sku(details: DataFrame) -> DataFrame:
    return details.withColumns({name: F.lit(default).cast(kind) for name, kind, default in ORDER_DETAIL if name not in details.columns})


def _object_envelope(table, op, rows: DataFrame, source: DataFrame) -> DataFrame:
    body = F.struct(table.alias("table"), op.alias("type"), F.struct(*[F.col(c).cast("string").alias(c) for c in rows.columns]).alias("data"))
    return source.select(F.to_json(body).alias("value"))


def _array_of(line, details: DataFrame):
    return details.select(F.array(line).alias("a")).schema["a"].dataType


def _same_order(struct, columns: list[str]):
    return F.struct(*[struct[c].alias(c) for c in columns])


def _without_every_13th(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id").cast("bigint") % 13 != 0)


def _money_as_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
                       for f in df.schema.fields])


BATCH_QUERIES = {f.__name__: f for f in (
    cdc_array_route, cdc_object_route, cdc_malformed, cdc_exact_numbers, order_info_typed, order_detail_typed, dim_user, dim_sku,
    dim_upsert_latest, order_detail_sku, order_first_flag, order_enriched, user_status, order_wide, order_wide_windowed,
    order_wide_share, order_wide_share_chunked, trademark_amount, trademark_amount_windows, trademark_amount_committed, dau_first_start,
    dau_index_upsert, order_index_upsert, offset_ledger)}
