"""JDBC sinks: bulk append, and results with their offsets in one transaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Bulk append without a transaction; two connections, a hundred rows a batch."""
    settings = {"batchsize": "100", "isolationLevel": "NONE", "numPartitions": "2", **options}
    df.write.format("jdbc").options(url=url, dbtable=table, **settings).mode("append").save()


@dataclass(frozen=True)
class Target:
    """A table with its key, and the staging table (same columns and ``batch_id``) its rows pass through."""

    table: str
    stage: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]


def replace_in_one_transaction(batch_id: int, frames: list[tuple[DataFrame, Target]], url: str, driver: str,
                               **options: str) -> None:
    """Replaces the frames' rows by key in all targets, in a single transaction.

    Tasks write to the staging tables in parallel; the transaction itself only moves staged rows inside the database.
    Rows a retried task staged twice are taken once. A replayed batch replaces its own rows.
    """
    spark = frames[0][0].sparkSession
    clear = [f"DELETE FROM {t.stage} WHERE batch_id = {int(batch_id)}" for _, t in frames]
    execute(spark, url, driver, clear, **options)
    for df, target in frames:
        staged = df.select(*target.columns, F.lit(batch_id).cast("bigint").alias("batch_id"))
        staged.write.format("jdbc").options(url=url, dbtable=target.stage, driver=driver, **options).mode("append").save()
    moves = [sql for _, target in frames for sql in move_statements(target, batch_id)]
    execute(spark, url, driver, [*moves, *clear], **options)


def move_statements(target: Target, batch_id: int) -> list[str]:
    same_key = " AND ".join(f"s.{k} = {target.table}.{k}" for k in target.keys)
    columns = ", ".join(target.columns)
    staged = f"FROM {target.stage} s WHERE s.batch_id = {int(batch_id)}"
    return [
        f"DELETE FROM {target.table} WHERE EXISTS (SELECT 1 {staged} AND {same_key})",
        f"INSERT INTO {target.table} ({columns}) SELECT DISTINCT {columns} {staged}",
    ]


def execute(spark: SparkSession, url: str, driver: str, statements: list[str], **options: str) -> None:
    """Runs statements in one transaction on a connection of the driver program; ``options`` such as user and password go to it."""
    jvm = spark._jvm
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    connector = jvm.java.lang.Class.forName(driver, True, loader).newInstance()
    properties = jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, str(value))
    connection = connector.connect(url, properties)
    try:
        connection.setAutoCommit(False)
        for sql in statements:
            statement = connection.createStatement()
            statement.executeUpdate(sql)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()
