r"""Line dedup that can be taken back (operator 13): sharded cuckoo filters before exact tables of reference counts.

A line's key is the line without blanks at its ends and with A-Z lower-cased; keys of at least ``least`` code points take part, by a 128-bit hash of them. A key that
several documents hold loses all its lines except in the smallest doc_id that holds it.

``LineIndex`` keeps, in a folder that all executors share:

* references: one row per document and key, appended by ``insert``; ``delete`` appends the ids of documents that go.
* counts, exact: per key the number of references, the smallest and the largest doc_id that hold it. A key is shared if these two differ.
* filters: per shard of keys a cuckoo filter of the shared ones, 16-bit fingerprints in buckets of four. A key that becomes shared is put in, one that no
  longer is gets taken out, so after a deletion lines come back that were dropped because of the documents deleted. A filter that is full gets a second, larger table.

``drops`` asks for each reference first the filter of its shard, which the lines of one document alone rarely pass, and then the exact row.
References of a shard are dealt over blocks by document, and each block gets the shard's filter and shared keys, so that one line in a third of all
documents is spread; counting combines before its shuffle. There are as many shards as keep one at some hundred thousand keys, whatever the number of lines;
nothing is collected or broadcast. A state becomes visible by one small file, put in place by a rename, after all its tables are written, so a failed insertion
or deletion changes nothing.

Nulls: a null or empty text is one empty line. Rows with a null doc_id hold no references and keep all their lines. Rows of one doc_id are one document. An empty table
gives no rows. Only ``doc_id`` (a whole number) and the text are read; texts are split whole, and a slice of some megabytes, or the longest text, is in memory at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.llm.common import slices
from shoptide.llm.vectors import grouped, values
from shoptide.sinks import files

SLOTS = 4
REFERENCES = "doc_id long, k1 long, k2 long"
FILTERS = "shard int, part int, buckets int, slots binary"
COUNTS = "k1 long, k2 long, refs long, first long, last long"


def key_of(line: bytes, least: int) -> bytes | None:
    """The key of a line in UTF-8, None if it is too short."""
    key = line.strip().lower()  # of bytes these are the six blanks of ASCII and A-Z only
    return key if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least) else None


def _numbers(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Cuckoo:
    """Tables of fingerprints; a key is in one of two buckets of one of them."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @staticmethod
    def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        unsigned = keys.view(np.uint64)
        prints = np.maximum(unsigned & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        return prints, ((unsigned >> np.uint64(16)) & np.uint64(buckets - 1)).astype(np.int64)

    @staticmethod
    def _other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & (buckets - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        for table in self.tables:
            prints, here = self._places(keys, len(table))
            there = self._other(here, prints, len(table))
            found |= ((table[here] == prints[:, None]) | (table[there] == prints[:, None])).any(axis=1)
        return found

    def add(self, keys: np.ndarray) -> None:
        """Puts in ``keys``, which are not in yet: into the last table, or, where that lacks room for all of them, into a new one."""
        if not len(keys):
            return
        last = self.tables[-1] if self.tables else None
        if last is not None and np.count_nonzero(last) + len(keys) <= 0.85 * last.size:
            copy = last.copy()
            if self._put(copy, keys):
                self.tables[-1] = copy
                return
        fresh = np.zeros((1 << max(0, int(np.ceil(np.log2(len(keys) / (0.8 * SLOTS))))), SLOTS), dtype=np.uint16)
        if self._put(fresh, keys):
            self.tables.append(fresh)
            return
        half = len(keys) // 2  # more keys of one fingerprint and bucket than a table holds
        self.add(keys[:half])
        self.add(keys[half:])

    def _put(self, table: np.ndarray, keys: np.ndarray, rounds: int = 200) -> bool:
        """Puts keys in, moving others to their other bucket; False if some found no room."""
        rng = np.random.default_rng(len(keys))
        prints, at = self._places(keys, len(table))
        for turn in range(rounds):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != at[:-1]]), np.arange(len(at)), 0))
            room = np.cumsum(table[at] == 0, axis=1)
            fits = room[:, -1] > nth
            slot = (room > nth[:, None]).argmax(axis=1)
            table[at[fits], slot[fits]] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if not len(at):
                return True
            if turn:  # one key of each full bucket takes the place of another, which moves on
                kicks = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                victims = rng.integers(SLOTS, size=len(kicks))
                moved = table[at[kicks], victims]
                table[at[kicks], victims] = prints[kicks]
                prints[kicks] = moved
            at = self._other(at, prints, len(table))
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Each of ``keys``, which are all in."""
        for table in reversed(self.tables):
            flat = table.reshape(-1)
            prints, here = self._places(keys, len(table))
            buckets = np.stack([here, self._other(here, prints, len(table))], axis=1)
            waiting = np.arange(len(keys))
            missed = []
            while len(waiting):
                equal = (table[buckets[waiting]] == prints[waiting][:, None, None]).reshape(len(waiting), -1)
                has = equal.any(axis=1)
                missed.append(waiting[~has])
                waiting, at = waiting[has], equal.argmax(axis=1)[has]
                slot = buckets[waiting, at // SLOTS] * SLOTS + at % SLOTS
                once = np.unique(slot, return_index=True)[1]
                flat[slot[once]] = 0
                waiting = np.delete(waiting, once)
            keys = keys[np.sort(np.concatenate(missed))] if missed else keys[:0]
            if not len(keys):
                return


def references(docs: DataFrame, least: int = 10, text: str = "text") -> DataFrame:
    """``doc_id, k1, k2``: the keys of each document's text, each once per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            keys = [{md5(key).digest() for line in t.split(b"\n") if (key := key_of(line, least)) is not None} if t else () for t in texts]
            k1, k2 = _numbers([digest for some in keys for digest in some])
            ids = np.repeat(batch.column(0).to_numpy(), [len(some) for some in keys])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(k1), pa.array(k2)], names=["doc_id", "k1", "k2"])

    wanted = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return wanted.mapInArrow(run, REFERENCES)


def _filters_of(table: pa.Table) -> Cuckoo:
    rows = [(p, n, b) for p, n, b in zip(*(table[c].to_pylist() for c in ("part", "buckets", "slots"))) if b is not None]
    return Cuckoo([np.frombuffer(b, dtype=np.uint16).reshape(n, SLOTS).copy() for _, n, b in sorted(rows, key=lambda r: r[0])])


def changed_filters(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The filters with keys put in and taken out: ``changes (shard, k2, comes)``, of each shard one task."""
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = _filters_of(table)
        comes = table["comes"].to_pylist()
        keys = table["k2"].to_pylist()
        found.remove(np.array([k for k, c in zip(keys, comes) if c is False], dtype=np.int64))
        found.add(np.array([k for k, c in zip(keys, comes) if c is True], dtype=np.int64))
        tables = [t for t in found.tables if t.any()]
        shard = values(table, "shard")[0]
        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(tables), pa.int32()), pa.array(range(len(tables)), pa.int32()),
                                          pa.array([len(t) for t in tables], pa.int32()), pa.array([t.tobytes() for t in tables], pa.binary())],
                                         names=["shard", "part", "buckets", "slots"])

    both = old.selectExpr("shard", "part", "buckets", "slots", "cast(null as bigint) k2", "cast(null as boolean) comes").unionByName(
        changes.selectExpr("shard", "cast(null as int) part", "cast(null as int) buckets", "cast(null as binary) slots", "k2", "comes"))
    return grouped(both, ["shard"], run, FILTERS)


class _Exact:
    """The smallest doc_id of each shared key of a shard."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, first: np.ndarray):
        order = np.lexsort((k2, k1))
        self.k1, self.k2, self.first = k1[order], k2[order], first[order]

    def later(self, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether the key is shared and held by a smaller doc_id."""
        at, end = (np.searchsorted(self.k1, k1, side) for side in ("left", "right"))
        found = np.zeros(len(k1), dtype=bool)
        while (left := np.flatnonzero(at < end)).size:  # once, but for keys alike in 64 bits
            found[left] |= (self.k2[at[left]] == k2[left]) & (self.first[at[left]] < doc[left])
            at[left] += 1
        return found


class LineIndex:
    """What documents hold which lines, over insertions and deletions; see the module."""

    def __init__(self, spark: SparkSession, root: str, least: int = 10, shard_keys: int = 1 << 18, block_rows: int = 1 << 18):
        self.spark, self.root, self.least, self.shard_keys, self.block_rows = spark, root.rstrip("/"), least, shard_keys, block_rows
        states = [name for name in files.children(spark, f"{self.root}/states") if not name.startswith(("_", "."))]
        self.state = json.loads(files.get_text(spark, f"{self.root}/states/{max(states)}")) if states else {
            "number": 0, "references": [], "gone": [], "counts": None, "filters": None, "shards": 1}

    def insert(self, docs: DataFrame) -> None:
        """Takes in documents; one whose id is known adds its lines to those known."""
        number = self.state["number"] + 1
        path = self._written(references(docs, self.least).withColumn("since", F.lit(number)), "references", number)
        new = self.spark.read.schema(f"{REFERENCES}, since int").parquet(path).groupBy("k1", "k2").agg(*_counted())
        before = self.counts()
        merged = before.withColumn("was", F.col("first") < F.col("last")).unionByName(new.withColumn("was", F.lit(False))).groupBy("k1", "k2").agg(
            F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("was").alias("was"))
        self._next(number, merged, references=[*self.state["references"], path])

    def delete(self, doc_ids: DataFrame) -> None:
        """Lets go of the documents of ``doc_ids (doc_id)``; lines that were dropped only because of them come back."""
        number = self.state["number"] + 1
        path = self._written(doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().withColumn(
            "until", F.lit(number)), "gone", number)
        ids = self.spark.read.schema("doc_id long, until int").parquet(path).select("doc_id")
        alive = self.references()
        touched = alive.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct()
        rest = alive.join(ids, "doc_id", "left_anti").join(touched, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(*_counted())
        before = self.counts().withColumn("was", F.col("first") < F.col("last"))
        again = before.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", "was").join(rest, ["k1", "k2"], "left")  # refs are null where none is left
        merged = before.join(touched, ["k1", "k2"], "left_anti").unionByName(again.select(*before.columns))
        self._next(number, merged, gone=[*self.state["gone"], path])

    def references(self) -> DataFrame:
        """``doc_id, k1, k2`` of the documents that are in."""
        rows = self._read("references", f"{REFERENCES}, since int")
        if self.state["gone"]:
            gone = self._read("gone", "doc_id long, until int").groupBy("doc_id").agg(F.max("until").alias("until"))
            rows = rows.join(gone, "doc_id", "left").where("until is null or until < since")
        return rows.select("doc_id", "k1", "k2")

    def counts(self) -> DataFrame:
        """Exact number of references, smallest and largest doc_id of every key that is held."""
        return self._read("counts", COUNTS).where("refs is not null")

    def filters(self) -> DataFrame:
        return self._read("filters", FILTERS)

    def drops(self) -> DataFrame:
        """``doc_id, k1, k2`` of the references whose lines go."""
        shard = self._shard()
        counts = self.counts().withColumn("shard", shard)
        blocks = counts.groupBy("shard").agg(F.ceil(F.sum("refs") / self.block_rows).cast("int").alias("blocks"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        none = lambda kind: F.lit(None).cast(kind)
        filters = self.filters().join(blocks, "shard").select(
            "shard", every, F.lit(0).alias("kind"), "part", "buckets", "slots", *[none("long").alias(c) for c in ("k1", "k2", "doc_id")])
        no_filter = [none("int").alias("part"), none("int").alias("buckets"), none("binary").alias("slots")]
        exact = counts.where("first < last").join(blocks, "shard").select(
            "shard", every, F.lit(1).alias("kind"), *no_filter, "k1", "k2", F.col("first").alias("doc_id"))
        asked = self.references().withColumn("shard", shard).join(blocks, "shard").select(
            "shard", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"), F.lit(2).alias("kind"), *no_filter, "k1", "k2", "doc_id")
        met = filters.unionByName(exact).unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, tables, rows, sieve, exact_rows = None, [], [], None, None
            for batch in batches:
                column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
                shards, parts, kinds = (column[c].to_numpy() for c in ("shard", "block", "kind"))
                cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])])) if len(kinds) else []
                for a, b in zip(cuts, [*cuts[1:], len(kinds)]):
                    if now != (shards[a], parts[a]):
                        now, tables, rows, sieve, exact_rows = (shards[a], parts[a]), [], [], None, None
                    here = {c: column[c].slice(a, b - a) for c in column}
                    if kinds[a] == 0:
                        tables.append(pa.table({c: here[c] for c in ("part", "buckets", "slots")}))
                        continue
                    k1, k2, doc = (here[c].to_numpy() for c in ("k1", "k2", "doc_id"))
                    if kinds[a] == 1:
                        rows.append((k1, k2, doc))
                        continue
                    if not rows:
                        continue
                    if sieve is None:
                        sieve = _filters_of(pa.concat_tables(tables))
                        exact_rows = _Exact(*(np.concatenate(c) for c in zip(*rows)))
                    passed = np.flatnonzero(sieve.contains(k2))
                    passed = passed[exact_rows.later(k1[passed], k2[passed], doc[passed])]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[passed]), pa.array(k1[passed]), pa.array(k2[passed])], names=["doc_id", "k1", "k2"])

        return met.mapInArrow(run, REFERENCES)

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``doc_id, n_lines, n_dropped, kept`` of every row of ``docs``: its text without the lines that go. Documents that are not in keep theirs."""
        lists = self.drops().groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys")).select(
            "doc_id", F.transform("keys", lambda k: k["k1"]).alias("k1s"), F.transform("keys", lambda k: k["k2"]).alias("k2s"))
        read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                kept, lines, dropped = [], [], []
                for body, k1s, k2s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    lines.append(body.count(b"\n") + 1)
                    dropped.append(0)
                    if k1s:
                        both = np.array([k1s, k2s], dtype=np.int64).T.tobytes()
                        going = {both[i:i + 16] for i in range(0, len(both), 16)}
                        stay = [line for line in body.split(b"\n") if (key := key_of(line, least)) is None or md5(key).digest() not in going]
                        dropped[-1] = lines[-1] - len(stay)
                        body = b"\n".join(stay)
                    kept.append(body)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

        return read.join(lists, "doc_id", "left").select("doc_id", "text", "k1s", "k2s").mapInArrow(
            run, "doc_id long, n_lines long, n_dropped long, kept string")

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.state["shards"])).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = self.state[name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))

    def _written(self, rows: DataFrame, name: str, number: int) -> str:
        path = f"{self.root}/{name}/{number:08d}"
        rows.write.mode("overwrite").parquet(path)
        return path

    def _next(self, number: int, merged: DataFrame, **changed: list[str]) -> None:
        """Writes counts and filters of the next state from ``merged (k1, k2, refs, first, last, was)``, then the state itself."""
        path = self._written(merged, "counts", number)
        written = self.spark.read.schema(f"{COUNTS}, was boolean").parquet(path)
        shards = self.state["shards"]
        needed = -(-written.count() // self.shard_keys)
        state = {**self.state, **changed, "number": number, "counts": path}
        old = self.filters()
        shared, was = F.coalesce(F.col("first") < F.col("last"), F.lit(False)), F.col("was")
        if needed > 2 * shards:  # more keys than the shards are made for: filters anew, for more of them
            state["shards"], old, was = needed, self.spark.createDataFrame([], FILTERS), F.lit(False)
        changes = written.where(shared != was).select(F.pmod("k1", F.lit(state["shards"])).cast("int").alias("shard"), "k2", shared.alias("comes"))
        state["filters"] = self._written(changed_filters(old, changes), "filters", number)
        files.make_folder(self.spark, f"{self.root}/states")
        files.put_text(self.spark, f"{self.root}/states/{number:08d}", json.dumps(state))
        self.state = state


def _counted() -> list[Column]:
    return [F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")]
