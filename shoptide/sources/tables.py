"""The given test tables seen as shop entities. Every rule is a projection or an ordinary join or sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoptide.functions.entities import order_times
from shoptide.functions.money import amount
from shoptide.functions.times import after_seconds, epoch_ms


# (factor, prime below 2**30)
ROW_ID_TERMS = [(728_191_213, 1_073_741_789), (523_481_377, 1_073_741_783)]


class ShopTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is looked up once."""
        path = f"{self.folder}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def order_totals(self) -> DataFrame:
        """Original amount, discount and freight per order in cents, discount and freight floored per line."""
        price = _whole(F.col("l_quantity")) * _whole(F.col("l_extendedprice") * 100)
        percent = lambda c: F.call_function("div", price * _whole(F.col(c) * 100), F.lit(100))
        return self.table("lineitem").groupBy("l_orderkey").agg(
            F.sum(price).alias("original"), F.sum(percent("l_discount")).alias("benefit"),
            F.sum(percent("l_tax")).alias("freight"))

    def order_heads(self) -> DataFrame:
        """Orders without their amounts: no join."""
        created = order_time()
        return order_times(self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_custkey") % 25).alias("province_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_custkey").alias("user_id"),
            after_seconds(created, F.lit(900)).cast("string").alias("expire_time"),
            created.cast("string").alias("create_time"),
        ))

    def order_info(self) -> DataFrame:
        """Orders with the amounts of their lines; an order without lines has zero amounts."""
        totals = self.order_totals()
        return self.order_heads().join(totals, F.col("id") == F.col("l_orderkey"), "left").fillna(
            0, ["original", "benefit", "freight"]).select(
            "id", "province_id", "order_status", "user_id",
            amount(F.col("original") - F.col("benefit") + F.col("freight")).alias("final_total_amount"),
            amount(F.col("benefit")).alias("benefit_reduce_amount"),
            amount(F.col("original")).alias("original_total_amount"),
            amount(F.col("freight")).alias("feight_fee"),
            "expire_time", "create_time", "create_date", "create_hour")

    def order_detail(self) -> DataFrame:
        return self.table("lineitem").select(*_detail_columns())

    def order_messages(self) -> DataFrame:
        """Orders with their arrival time."""
        return self.order_info().withColumn("timestamp", F.to_timestamp("create_time"))

    def detail_messages(self, seconds_per_line: int, offset: int = 0) -> DataFrame:
        """Details with their arrival time: some seconds after their order, by line number."""
        heads = self.table("orders").select("o_orderkey", order_time().alias("_created"))
        arrived = after_seconds(F.col("_created"), F.col("l_linenumber") * seconds_per_line + offset)
        joined = self.table("lineitem").join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(*_detail_columns(), arrived.cast("timestamp").alias("timestamp"))

    def user_info(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.cast("string").alias("id"),
            F.col("c_mktsegment").alias("user_level"),
            F.date_add(F.lit("1950-01-01").cast("date"), (key * 97 % 23000).cast("int")).cast("string").alias("birthday"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("gender"))

    def province_info(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("string").alias("id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").cast("string").alias("area_code"),
            F.concat(F.lit("CN-"), F.col("n_nationkey").cast("string")).alias("iso_code"))

    def sku_info(self) -> DataFrame:
        """SKU rows as captured, still without the looked-up names."""
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("id"),
            text_id(F.col("p_name")).cast("string").alias("spu_id"),
            amount(_whole(F.col("p_retailprice") * 100)).cast("string").alias("price"),
            F.concat(F.lit("sku-"), F.col("p_partkey").cast("string")).alias("sku_name"),
            trademark_id().cast("string").alias("tm_id"),
            text_id(F.col("p_type")).cast("string").alias("category3_id"),
            F.lit("2020-01-01 00:00:00").alias("create_time"))

    def spu_info(self) -> DataFrame:
        return self.table("part").select(text_id(F.col("p_name")).cast("string").alias("id"),
                                         F.col("p_name").alias("spu_name")).distinct()

    def base_category3(self) -> DataFrame:
        return self.table("part").select(text_id(F.col("p_type")).cast("string").alias("id"),
                                         F.col("p_type").alias("name"), F.lit("0").alias("category2_id")).distinct()

    def base_trademark(self) -> DataFrame:
        return self.table("part").select(trademark_id().cast("string").alias("id"), F.col("p_brand").alias("tm_name")).distinct()

    def startup_log(self) -> DataFrame:
        """Start records as log messages."""
        common = F.struct(
            F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("mid"),
            F.col("user_id").cast("string").alias("uid"),
            F.get_json_object("props", "$.k").alias("ar"),
            F.col("event_type").alias("ba"),
            F.lit("store").alias("ch"),
            F.lit("model").alias("md"),
            F.lit("Android 11").alias("os"),
            F.lit("v2.1").alias("vc"))
        body = F.struct(common.alias("common"), epoch_ms(F.col("ts")).alias("ts"))
        return self.table("events").select("event_id", "user_id", F.to_json(body).alias("value"))


def order_time() -> Column:
    return after_seconds(F.col("o_orderdate"), F.col("o_orderkey") % 86400)


def trademark_id() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")


def text_id(text: Column) -> Column:
    """A 60-bit id of a text, so that ids need no ranking over the whole table."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def row_id(parts: list[Column]) -> Column:
    """A 60-bit id of whole numbers: two polynomial remainders side by side, in plain BIGINT arithmetic."""
    high, low = (_remainder(parts, factor, prime) for factor, prime in ROW_ID_TERMS)
    return high * F.lit(1 << 30) + low


def _remainder(parts: list[Column], factor: int, prime: int) -> Column:
    total = F.lit(0).cast("bigint")
    for part in parts:
        total = (total * factor + part) % prime
    return total


def _whole(column: Column) -> Column:
    return F.rint(column).cast("bigint")


def _detail_columns() -> list[Column]:
    """The id is made from the line's own columns, so that no numbering within orders is needed."""
    parts = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    parts += [_whole(F.col("l_quantity")), _whole(F.col("l_extendedprice") * 100)]
    return [
        row_id(parts).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"),
        amount(_whole(F.col("l_extendedprice") * 100)).alias("order_price"),
        _whole(F.col("l_quantity")).alias("sku_num"),
        F.concat(F.lit("sku-"), F.col("l_partkey").cast("string")).alias("sku_name"),
        F.col("l_shipdate").cast("string").alias("create_time"),
    ]
