"""Change-capture envelopes to per-table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tables that are routed, and operations that are kept per envelope.
TABLES = [
    "order_info",
    "order_detail",
    "user_info",
    "base_province",
    "base_category3",
    "sku_info",
    "spu_info",
    "base_trademark",
]
ARRAY_OPS = ["insert", "update"]
OBJECT_OPS = ["insert", "update", "bootstrap-insert"]

NAMED = "`table` IS NOT NULL AND `type` IS NOT NULL"
#: Envelopes by the type of their data: a row or several as JSON text.
ARRAY_ENVELOPE, OBJECT_ENVELOPE = "array<string>", "string"
#: An unquoted decimal number of more digits than a double keeps.
LONG_DECIMAL = r"[:,\[]\s*-?(?=[0-9.]{17})[0-9]+\.[0-9]"


def read_envelopes(messages: DataFrame, kind: str, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``table``, ``op`` and ``data`` of every message next to the ``keep`` columns, whether it is ``readable``, and ``unread``, its text where it is not.

    A message is parsed once. Rows are cut out as text, in which a decimal number passes through a double; a message with one that would not survive this is parsed as a
    VARIANT, which keeps 38 digits. (As VARIANT all messages would take four times as long, as each of its strings is escaped anew.)
    """
    schema = f"`table` string, `type` string, `data` {kind}"
    plain = F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    exact = F.try_variant_get(F.try_parse_json(F.col("value")), "$", f"struct<{schema}>")
    body = F.coalesce(F.when(F.col("value").rlike(LONG_DECIMAL), exact), plain)
    # As the output of a generator the body is not worked out again for each filter on it.
    rows = messages.select(*keep, "value", F.inline(F.array(body)))
    readable = F.expr(NAMED) if kind == ARRAY_ENVELOPE else F.expr(f"{NAMED} AND data IS NOT NULL")
    return rows.select(*keep, F.lower("table").alias("table"), F.lower("type").alias("op"), "data", readable.alias("readable"),
                       F.when(~readable, F.col("value")).alias("unread"))


def rows_of(envelopes: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``table``, ``op`` and ``value``, a row as JSON text: one for each element of an array, none for a NULL or empty one, or one for each object."""
    value = F.explode("data") if kind == ARRAY_ENVELOPE else F.col("data")
    return envelopes.where("readable").select(*keep, "table", "op", value.alias("value"))


def parse_array(messages: DataFrame, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``{table, type, data: [...]}``: one row per array element; NULL or empty ``data`` gives none."""
    return rows_of(read_envelopes(messages, ARRAY_ENVELOPE, keep, strict), ARRAY_ENVELOPE, keep)


def parse_object(messages: DataFrame, keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``{table, type, data: {...}}``: one row per message."""
    return rows_of(read_envelopes(messages, OBJECT_ENVELOPE, keep, strict), OBJECT_ENVELOPE, keep)


def malformed(messages: DataFrame, kind: str) -> DataFrame:
    """The messages the parsers leave out because they are no readable envelope."""
    return read_envelopes(messages, kind).where("NOT readable").select(F.col("unread").alias("value"))


def route(rows: DataFrame, ops: list[str]) -> DataFrame:
    """Keeps listed tables and operations and names the target topic.

    Only plain inserts of ``order_info`` pass: a changed status must not count as a new order.
    """
    return rows.where(wanted(ops)).withColumn("topic", F.concat(F.lit("ods_"), "table")).drop("table", "op")


def wanted(ops: list[str]) -> Column:
    """Whether rows of this ``table`` and ``op`` are routed."""
    listed = F.col("table").isin(TABLES) & F.col("op").isin(ops)
    return listed & ((F.col("table") != "order_info") | (F.col("op") == "insert"))
