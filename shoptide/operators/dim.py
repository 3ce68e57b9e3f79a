"""Dimension rows: derived user columns, SKU completion, newest version per key."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptide.schemas import SKU_INFO, names

# Labels of the age groups and genders.
AGE_TO_20 = "20岁及以下"
AGE_21_TO_30 = "21岁到 30 岁"
AGE_OVER_30 = "30岁及以上"
FEMALE = "女"
MALE = "男"


def derive_user(users: DataFrame, as_of: date | None = None) -> DataFrame:
    """Adds age group, as of a day (default today), and gender name. An unknown birthday has no age group."""
    day = F.current_date() if as_of is None else F.lit(as_of)
    age = F.floor(F.datediff(day, F.try_to_timestamp("birthday", F.lit("yyyy-MM-dd")).cast("date")) / 365)
    return users.withColumns({
        "age_group": F.when(age <= 20, AGE_TO_20).when(age <= 30, AGE_21_TO_30).when(age > 30, AGE_OVER_30),
        "gender_name": F.when(F.col("gender") == "F", FEMALE).otherwise(MALE),
    })


def trademark_rows(trademarks: DataFrame) -> DataFrame:
    """Message field ``tm_id`` becomes the table key ``id``."""
    return trademarks.withColumnRenamed("tm_id", "id")


def enrich_sku(sku: DataFrame, spu: DataFrame, category3: DataFrame, trademark: DataFrame) -> DataFrame:
    """Completes SKU rows with three lookups; a SKU missing one of them is left out until it comes again.

    No broadcast is forced: the planner picks it from the lookups' real size.
    """
    spu = spu.select(F.col("id").alias("spu_id"), "spu_name")
    category3 = category3.select(F.col("id").alias("category3_id"), F.col("name").alias("category3_name"))
    trademark = trademark.select(F.col("id").alias("tm_id"), "tm_name")
    bare = sku.select("id", "spu_id", "price", "sku_name", "tm_id", "category3_id", "create_time")
    return (bare.join(spu, "spu_id").join(category3, "category3_id").join(trademark, "tm_id")
                .select(*names(SKU_INFO)))


def latest(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Newest row per key.

    The rank filter is applied on the map side too, so a key with very many versions
    sends at most one row per input partition.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order_by])
    return df.withColumn("_rank", F.row_number().over(newest_first)).where("_rank = 1").drop("_rank")
