"""JSON text to typed entity columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptide.schemas import ddl


def json_columns(df: DataFrame, schema: str, keep: tuple[str, ...] = (), value: str = "value",
                 mode: str = "PERMISSIVE") -> DataFrame:
    """The fields of a JSON text as columns, next to the ``keep`` columns.

    ``inline`` makes them the output of a generator: a later filter or join key cannot be pushed below the parse,
    where it would parse each message once more.
    """
    return df.select(*keep, F.inline(F.array(F.from_json(value, schema, {"mode": mode}))))


def parse_strict(df: DataFrame, entity: list, keep: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Typed ``from_json``; absent fields get their declared default."""
    parsed = json_columns(df, ddl(entity), keep, value)
    return parsed.select(*keep, *[_with_default(F.col(name), kind, default).alias(name) for name, kind, default in entity])


def parse_lenient(df: DataFrame, entity: list, keep: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """As :func:`parse_strict`, but numbers may be quoted, as change-capture payloads have them.

    A ``bigint`` field would turn a quoted number into NULL, so whole numbers are read as text and cast;
    ``decimal`` fields accept both forms exactly.
    """
    read_as = ", ".join(f"`{name}` {'string' if kind == 'bigint' else kind}" for name, kind, _ in entity)
    parsed = json_columns(df, read_as, keep, value)
    columns = []
    for name, kind, default in entity:
        column = F.col(name)
        if kind == "bigint":
            column = column.try_cast("bigint")
        columns.append(_with_default(column, kind, default).alias(name))
    return parsed.select(*keep, *columns)


def order_times(df: DataFrame) -> DataFrame:
    """Date and hour text cut from ``create_time``."""
    return df.withColumns({
        "create_date": F.substring("create_time", 1, 10),
        "create_hour": F.substring("create_time", 12, 2),
    })


def unreadable(rows: DataFrame, key: str) -> Column:
    """Whether a parsed row lacks its key, which text that is no JSON, or not of this entity, does."""
    return rows[key].isNull()


def to_value(df: DataFrame, topic: str, key: str | None = None) -> DataFrame:
    """One JSON message per row; with ``key`` a row sent again has the key of the one before."""
    keys = [F.col(key).cast("string").alias("key")] if key else []
    return df.select(F.lit(topic).alias("topic"), *keys, F.to_json(F.struct("*")).alias("value"))


def _with_default(column: Column, kind: str, default: object) -> Column:
    return column if default is None else F.coalesce(column, F.lit(default).cast(kind))
