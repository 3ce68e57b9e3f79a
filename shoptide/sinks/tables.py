"""Parquet tables written batch by batch: all-or-nothing batches, and the newest row per key on top."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoptide.operators.dim import latest
from shoptide.sinks import files

FOLDER, RUN = "key_folder", "run"
#: Messages and rows repeat themselves, and the usual light codec takes twice the disk.
STORED = "zstd"


class BatchTables:
    """One or more tables whose rows of a batch become visible together.

    Data goes to folders of its own; then one small commit file, put in place by a rename, names them. A batch that is
    already committed is left alone, so a replay changes nothing, and a half-written one is never seen. The first streaming
    query that writes owns the root: batch ids count per query, so another query, or one started over without its checkpoint, is an error.

    With ``keys`` a later batch replaces rows of the same key, and every ``compact_every`` batches the earlier ones are merged into one base, so a
    read stays short. ``keep`` limits what survives a merge.

    With ``folders``, columns and a number by table, rows stand in that many folders by a hash of these columns, so that a lookup by them reads only the folders
    it is about. The number belongs to the root: it can't be changed for one that has rows.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, list[str]] | None = None,
                 compact_every: int = 50, keep: Column | None = None, folders: dict[str, tuple[list[str], int]] | None = None):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self.keys, self.compact_every, self.keep, self.folders = keys, compact_every, keep, folders or {}

    def commit(self, batch_id: int, frames: dict[str, DataFrame], kind: str = "batch") -> bool:
        """Writes the frames as one batch; False when it was committed before."""
        self._claim()
        mark = f"{self.root}/commits/{kind}-{batch_id:012d}"
        if files.exists(self.spark, mark):
            return False
        if self.keys and kind == "batch":
            _, batches = self._committed(batch_id)
            if len(batches) >= self.compact_every:
                self.compact(batches[-1])
        folders = {}
        for name, df in frames.items():
            folders[name] = f"{self.root}/data/{name}/{RUN}={kind}-{batch_id:012d}-{uuid.uuid4().hex}"
            rows = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            if name in self.folders:
                # Rows of a folder come together, in as many files as their size asks for.
                rows = rows.withColumn(FOLDER, self._folder(name)).hint("rebalance", F.col(FOLDER))
                rows.write.option("compression", STORED).partitionBy(FOLDER).parquet(folders[name])
            else:
                rows.write.option("compression", STORED).parquet(folders[name])
        files.make_folder(self.spark, f"{self.root}/commits")
        files.put_text(self.spark, mark, json.dumps(folders))
        return True

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """Rows of all committed batches, or of those with an id below ``before``, with a ``batch_id`` column."""
        return self._stored(name, before).drop(FOLDER, RUN)

    def read_batch(self, name: str, batch_id: int) -> DataFrame:
        """The rows that one batch has committed, none if it has not; for the batch itself, as a merge takes in earlier ones."""
        mark = f"{self.root}/commits/batch-{batch_id:012d}"
        folder = json.loads(files.get_text(self.spark, mark)).get(name) if files.exists(self.spark, mark) else None
        columns = StructType.fromDDL(self.schemas[name]).names
        return self._rows(name, [folder] if folder else []).select(*columns)

    def _folder(self, name: str) -> Column:
        columns, number = self.folders[name]
        return F.pmod(F.xxhash64(*columns), F.lit(number)).cast("int")

    def _stored(self, name: str, before: int | None) -> DataFrame:
        base, batches = self._committed(before)
        marks = ([f"base-{base:012d}"] if base is not None else []) + [f"batch-{b:012d}" for b in batches]
        folders = [json.loads(files.get_text(self.spark, f"{self.root}/commits/{m}")).get(name) for m in marks]
        return self._rows(name, [f for f in folders if f])

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        schema = f"{self.schemas[name]}, `batch_id` bigint" + (f", `{FOLDER}` int" if name in self.folders else "")
        if not folders:
            none = [F.lit(None).cast(field.dataType).alias(field.name) for field in StructType.fromDDL(schema)]
            return self.spark.range(1).select(*none).where(F.lit(False))  # known to be empty when a plan is made, so that no job runs for it
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{name}").parquet(*folders)

    def current(self, name: str, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The newest row of every key, or only of rows that match ``wanted``, some of the table's columns.

        Rows are restricted before they are ranked, so the cost of a lookup follows what is looked up. If ``wanted``, which should be held, has the columns of the
        table's folders, only the folders of its rows are read. Their numbers, no more than there are folders, come to the driver first: run-time pruning does not
        see that a held frame is broadcast, and would read everything.
        """
        rows = self.matching(name, before, wanted)
        base, batches = self._committed(before)
        if len(batches) + (base is not None) > 1:
            rows = latest(rows, self.keys[name], ["batch_id"])
        return rows.drop("batch_id")

    def matching(self, name: str, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """As :meth:`current`, but the rows of all batches, with a ``batch_id`` column."""
        rows = self._stored(name, before)
        if wanted is not None:
            if name in self.folders and set(self.folders[name][0]) <= set(wanted.columns):
                touched = [row[0] for row in wanted.select(self._folder(name)).distinct().collect()]
                if len(touched) < self.folders[name][1]:
                    rows = rows.where(F.col(FOLDER).isin(touched))
            rows = rows.join(wanted, wanted.columns, "left_semi")
        return rows.select(*StructType.fromDDL(self.schemas[name]).names, "batch_id")

    def compact(self, upto: int) -> None:
        """Merges the batches up to ``upto`` into one base.

        What the base before still needs stays on disk for readers that have just begun; older files go.
        """
        before, _ = self._committed(upto)
        merged = {name: self.current(name, upto + 1) for name in self.schemas}
        if self.keep is not None:
            merged = {name: rows.where(self.keep) for name, rows in merged.items()}
        self.commit(upto, merged, kind="base")
        if before is not None:
            self.drop_older(before)

    def drop_older(self, base: int) -> None:
        """Removes the batches merged into ``base`` and the bases before it: marks first, then data."""
        for mark in files.children(self.spark, f"{self.root}/commits"):
            if mark.startswith(("_", ".")):
                continue
            kind, number = mark.split("-")
            if int(number) < base or (kind == "batch" and int(number) == base):
                folders = json.loads(files.get_text(self.spark, f"{self.root}/commits/{mark}"))
                files.remove(self.spark, f"{self.root}/commits/{mark}")
                for folder in folders.values():
                    files.remove(self.spark, folder)

    def _claim(self) -> None:
        claim(self.spark, self.root)

    def _committed(self, before: int | None) -> tuple[int | None, list[int]]:
        found = [m.split("-") for m in files.children(self.spark, f"{self.root}/commits") if not m.startswith(("_", "."))]
        found = [(kind, int(number)) for kind, number in found if before is None or int(number) < before]
        base = max((n for kind, n in found if kind == "base"), default=None)
        return base, sorted(n for kind, n in found if kind == "batch" and (base is None or n > base))


def claim(spark: SparkSession, root: str) -> None:
    """Notes the streaming query that writes to ``root``, or raises if it is another one than noted before."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if query is None:
        return
    path = f"{root}/owner"
    if not files.exists(spark, path):
        files.make_folder(spark, root)
        files.put_text(spark, path, query)
    elif (owner := files.get_text(spark, path)) != query:
        raise RuntimeError(f"{root} belongs to the streaming query {owner}; query {query}, which counts its batches anew, needs another root")


class KeyedTable:
    """Rows unique by key; the last batch to write a key wins, within a batch the last row by ``order_by``.

    ``folders`` is the number of folders the rows stand in, by a hash of the columns they are looked up ``by`` (the key, if not given); 0 for a small table.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], columns: str,
                 compact_every: int = 50, keep: Column | None = None, folders: int = 0, by: list[str] | None = None):
        self.keys = keys
        self.columns = StructType.fromDDL(columns).names
        self.batches = BatchTables(spark, root, {"rows": columns}, {"rows": keys}, compact_every, keep,
                                   {"rows": (by or keys, folders)} if folders else None)

    def upsert(self, df: DataFrame, batch_id: int, order_by: list[str] | None = None) -> bool:
        rows = latest(df, self.keys, order_by) if order_by else df.dropDuplicates(self.keys)
        return self.batches.commit(batch_id, {"rows": rows.select(*self.columns)})

    def read(self, before: int | None = None) -> DataFrame:
        return self.batches.current("rows", before)

    def lookup(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """The current rows that match ``wanted``, a frame of some of the table's columns."""
        return self.batches.current("rows", before, wanted)

    @contextmanager
    def rows_of(self, wanted: DataFrame, batch_id: int) -> Iterator[DataFrame]:
        """The rows current after the batch, among them all that match ``wanted``, a frame of the key: those the batch itself has written, and of earlier ones only
        what is wanted and not among these. So what a batch reads of the table is not dealt anew each time, as most of what it asks for came with it.
        """
        own = self.batches.read_batch("rows", batch_id)
        earlier = wanted.join(own.select(*self.keys), self.keys, "left_anti").distinct()
        earlier.persist()
        try:
            yield own.unionByName(self.lookup(earlier, batch_id).select(*self.columns))
        finally:
            earlier.unpersist()
