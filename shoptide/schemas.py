"""Column lists of every entity, as ``(name, type, default)``; ``None`` means no default."""

from __future__ import annotations

MONEY = "decimal(16,2)"
NO_OPERATE_TIME = "1970-01-01 00:00:00"

ORDER_INFO = [
    ("id", "bigint", None),
    ("province_id", "bigint", None),
    ("order_status", "string", None),
    ("user_id", "bigint", None),
    ("final_total_amount", MONEY, None),
    ("benefit_reduce_amount", MONEY, None),
    ("original_total_amount", MONEY, None),
    ("feight_fee", MONEY, None),
    ("expire_time", "string", None),
    ("create_time", "string", None),
    ("operate_time", "string", NO_OPERATE_TIME),
    ("create_date", "string", None),
    ("create_hour", "string", None),
    ("is_first_order", "boolean", False),
    ("province_name", "string", None),
    ("province_area_code", "string", None),
    ("province_iso_code", "string", None),
    ("user_age_group", "string", None),
    ("user_gender", "string", None),
]

ORDER_DETAIL = [
    ("id", "bigint", None),
    ("order_id", "bigint", None),
    ("sku_id", "bigint", None),
    ("order_price", MONEY, None),
    ("sku_num", "bigint", None),
    ("sku_name", "string", None),
    ("create_time", "string", None),
    ("spu_id", "bigint", 0),
    ("tm_id", "bigint", 0),
    ("category3_id", "bigint", 0),
    ("spu_name", "string", None),
    ("tm_name", "string", None),
    ("category3_name", "string", None),
]

ORDER_WIDE = [
    ("order_id", "bigint", 0),
    ("province_id", "bigint", 0),
    ("order_status", "string", None),
    ("user_id", "bigint", 0),
    ("final_total_amount", MONEY, 0),
    ("benefit_reduce_amount", MONEY, 0),
    ("original_total_amount", MONEY, 0),
    ("feight_fee", MONEY, 0),
    ("expire_time", "string", None),
    ("create_time", "string", None),
    ("operate_time", "string", NO_OPERATE_TIME),
    ("create_date", "string", None),
    ("create_hour", "string", None),
    ("is_first_order", "boolean", False),
    ("province_name", "string", None),
    ("province_area_code", "string", None),
    ("province_iso_code", "string", None),
    ("user_age_group", "string", None),
    ("user_gender", "string", None),
    ("order_detail_id", "bigint", 0),
    ("sku_id", "bigint", 0),
    ("sku_price", MONEY, 0),
    ("sku_num", "bigint", 0),
    ("sku_name", "string", None),
    ("spu_id", "bigint", 0),
    ("tm_id", "bigint", 0),
    ("category3_id", "bigint", 0),
    ("spu_name", "string", None),
    ("tm_name", "string", None),
    ("category3_name", "string", None),
    ("final_detail_amount", MONEY, 0),
]

USER_INFO = [(c, "string", None) for c in ("id", "user_level", "birthday", "gender")]
PROVINCE_INFO = [(c, "string", None) for c in ("id", "name", "area_code", "iso_code")]
SPU_INFO = [(c, "string", None) for c in ("id", "spu_name")]
BASE_CATEGORY3 = [(c, "string", None) for c in ("id", "name", "category2_id")]
# The message field is tm_id; the table key is id (see operators.dim.trademark_rows).
BASE_TRADEMARK = [(c, "string", None) for c in ("tm_id", "tm_name")]
SKU_INFO = [
    (c, "string", None)
    for c in ("id", "spu_id", "price", "sku_name", "tm_id", "category3_id", "create_time",
              "category3_name", "spu_name", "tm_name")
]
STARTUP_LOG = [(c, "string", None) for c in ("mid", "uid", "ar", "ba", "ch", "md", "os", "vc")] + [("ts", "bigint", None)]

# The columns a Kafka source delivers; the file twin has the same.
MESSAGE = [
    ("key", "string", None),
    ("value", "string", None),
    ("topic", "string", None),
    ("partition", "int", None),
    ("offset", "bigint", None),
    ("timestamp", "timestamp", None),
    ("timestampType", "int", None),
]


def names(entity: list) -> list[str]:
    return [name for name, _, _ in entity]


def ddl(entity: list) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind, _ in entity)


def only(entity: list, *wanted: str) -> list:
    """The named fields of an entity, so that a reader parses no others."""
    return [field for field in entity if field[0] in wanted]
