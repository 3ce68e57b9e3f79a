"""Tables and queries read over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Runs the whole query in the database; one task reads the result."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_table(spark: SparkSession, url: str, table: str, split_on: str | None = None,
               bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A full table; with a numeric ``split_on`` column it is read by ``parts`` tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on is not None:
        reader = reader.options(partitionColumn=split_on, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                                numPartitions=str(parts))
    return reader.load()


def register(spark: SparkSession, url: str, tables: dict[str, str], **options: str) -> None:
    """Dimension tables as temporary views, ``{view: table}``."""
    for view, table in tables.items():
        read_table(spark, url, table, **options).createOrReplaceTempView(view)
