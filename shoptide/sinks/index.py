"""Daily document index: documents by id within a dated index."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.sinks.tables import KeyedTable

DOCUMENTS = "`index_name` string, `doc_id` string, `source` string"


def index_store(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, root, ["index_name", "doc_id"], DOCUMENTS)


def documents(df: DataFrame, index: str, day: date | Column | None = None, id_col: str | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as JSON documents of ``<index>_<day>``; without an id column each gets an id of its own."""
    stamp = F.current_date() if day is None else day if isinstance(day, Column) else F.lit(day)
    name = F.concat(F.lit(f"{index}_"), stamp.cast("string"))
    doc_id = F.uuid() if id_col is None else F.col(id_col).cast("string")
    return df.select(name.alias("index_name"), doc_id.alias("doc_id"), F.to_json(F.struct("*")).alias("source"), *keep)


def index_upsert(store: KeyedTable, df: DataFrame, index: str, batch_id: int, day: date | Column | None = None,
                 id_col: str | None = None, order_by: tuple[str, ...] = ()) -> bool:
    """Puts documents in bulk: an id that exists is replaced, by the last one where a batch has several.

    One document is the same call on a one-row frame.
    """
    return store.upsert(documents(df, index, day, id_col, order_by), batch_id, list(order_by) or None)
