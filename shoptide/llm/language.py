"""Language identification by partial matching (operator 3).

Each language has a tree of byte contexts up to ``order`` bytes with the counts of what followed. A byte's probability in a context is its share of
the counts, or the escape probability (method C: distinct followers over followers and counts) times what the next shorter context gives
to the bytes not seen here; below the empty context every byte is equally likely. So the code lengths of a text are exact for a proper distribution.

Counts are frozen after learning, so all of this is worked out once: the contexts of a few languages are the states of one automaton, with a row of
code lengths per state, byte and language. A text's states need no loop over its bytes: ``order`` gathers over the whole Arrow batch lead from
the empty context to the longest known one at every place at once, and a further gather adds up code lengths of these languages.

Learning reads at most ``per_language`` documents of a language (in the order of a hash), a bounded sample; prediction reads every whole text. A language
keeps its ``max_grams`` most frequent byte strings, all single bytes among them, and its ``max_contexts`` most frequent contexts: the bounds are each
language's own, so one with few rows or among many others loses nothing to these, and memory and time grow in proportion to the number of languages.

``und``: a text that is null or has no letter, or where nothing could be learned; its score is 0. Ties go to the smaller name. Rows with a null
doc_id are predicted, not held out, and not learned from. Only ``doc_id, text, lang`` are read; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptide.llm.common import fresh, slices

UNDETERMINED = "und"
LETTER = r"\p{L}"
#: Languages in one automaton, whose tables hold code lengths of all of them for the contexts of each.
TOGETHER = 4


class Model:
    """Counts of ``order`` + 1 bytes at most, by language. A language has at most ``max_contexts`` contexts, their own parts aside."""

    def __init__(self, counts: dict[str, dict[bytes, int]], order: int, max_contexts: int = 2500):
        """``counts``: how often each byte string of 1 to ``order`` + 1 bytes occurs."""
        self.counts, self.order, self.max_contexts = counts, order, max_contexts
        self.languages = sorted(counts)

    def __reduce__(self):
        return Model, (self.counts, self.order, self.max_contexts)

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """The automata of ``TOGETHER`` languages each, in order."""
        return [self._automaton(self.languages[i:i + TOGETHER]) for i in range(0, len(self.languages), TOGETHER)]

    def _contexts(self, language: str) -> set[bytes]:
        """The most frequent contexts of a language, with what they begin and end with."""
        totals: dict[bytes, int] = {}
        for gram, n in self.counts[language].items():
            if len(gram) > 1:
                totals[gram[:-1]] = totals.get(gram[:-1], 0) + n
        chosen = {g for g, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[: self.max_contexts]}
        chosen |= {g[k:] for g in chosen for k in range(1, len(g))}
        return chosen | {g[:k] for g in chosen for k in range(1, len(g))}

    def _automaton(self, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Class of each byte; next state (times classes) and code lengths by state and class; number of classes.

        The last class is the break between texts: it leads to the empty context and costs nothing. A language's code lengths go by its own contexts, whichever
        others it shares the automaton with.
        """
        contexts = [self._contexts(language) for language in languages]
        chosen = set().union(*contexts)
        seen = sorted({g[-1] for language in languages for g in self.counts[language]})
        other, width = len(seen), len(seen) + 2
        classes = np.full(256, other, dtype=np.uint8 if width < 256 else np.uint16)
        classes[seen] = np.arange(len(seen))
        states = [b"", *sorted(chosen, key=lambda g: (len(g), g))]
        number = {g: i for i, g in enumerate(states)}
        goto = np.zeros((len(states), width), dtype=np.int32)
        for i, g in enumerate(states):
            if g:
                goto[i] = goto[number[g[1:]]]
            if len(g) < self.order:
                for c, b in enumerate(seen):
                    longer = number.get(g + bytes([b]))
                    if longer is not None:
                        goto[i, c] = longer
        goto[:, -1] = 0
        shares = np.zeros((len(states), width, len(languages)), dtype=np.float32)
        unseen = max(1, 256 - len(seen))
        base = np.append(np.full(len(seen), 1 / 256), unseen / 256)
        for n, language in enumerate(languages):
            followers: dict[bytes, list[tuple[int, int]]] = {}
            for gram, count in self.counts[language].items():
                if len(gram) == 1 or gram[:-1] in contexts[n]:
                    followers.setdefault(gram[:-1], []).append((classes[gram[-1]], count))
            own = np.zeros((len(states), width - 1))
            for i, g in enumerate(states):
                shorter = own[number[g[1:]]] if g else base
                here = followers.get(g)
                if not here:
                    own[i] = shorter
                    continue
                at = np.array([c for c, _ in here])
                n_at = np.array([float(k) for _, k in here])
                both = n_at.sum() + len(at)
                rest = shorter.copy()
                rest[at] = 0
                left = rest.sum()
                own[i] = rest * (len(at) / both / left if left > 0 else 0.0)
                own[i, at] = n_at / (both if left > 0 else n_at.sum())
            own[:, other] /= unseen
            shares[:, :-1, n] = -np.log2(np.maximum(own, 1e-12))
        return classes, (goto * width).astype(np.int32), shares.reshape(-1, len(languages)), width

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
        """Bits of each text in each language; text i is ``data[offsets[i]:offsets[i + 1]]``."""
        return np.concatenate([self._bits(data, offsets, chunk, *table) for table in self.tables], axis=1)

    def _bits(self, data: np.ndarray, offsets: np.ndarray, chunk: int, classes: np.ndarray, goto: np.ndarray, costs: np.ndarray, width: int) -> np.ndarray:
        goto = goto.ravel()
        n = len(offsets) - 1
        bits = np.zeros((n, costs.shape[1]))
        starts = (offsets[:-1] - offsets[0]) + np.arange(n)  # each text follows one break
        stream = np.full(int(offsets[-1] - offsets[0]) + n, width - 1, dtype=classes.dtype)
        inside = np.ones(len(stream), dtype=bool)
        inside[starts] = False
        stream[inside] = classes[data[offsets[0]:offsets[-1]]]
        for a in range(0, len(stream), chunk):
            b = min(a + chunk, len(stream))
            lead = min(a, self.order)
            part = stream[a - lead:b].astype(np.int32)
            state = np.zeros(len(part), dtype=np.int32)
            for _ in range(self.order):
                moved = goto[state + part]
                state[1:] = moved[:-1]
                state[0] = 0
            cost = costs[(state + part)[lead:]]
            first = np.searchsorted(starts, a, side="right") - 1
            last = np.searchsorted(starts, b, side="left")
            cuts = np.maximum(starts[first:last] - a, 0)
            bits[first:last] += np.add.reduceat(cost, cuts, axis=0)
        return bits

    def predict(self, bits: np.ndarray) -> tuple[list[str], np.ndarray]:
        best = bits.argmin(axis=1)
        gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
        return [self.languages[i] for i in best], 1 / np.exp2(-gap).sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, order: int = 4, per_language: int = 600, min_count: int = 1, max_contexts: int = 2500,
          max_grams: int = 50_000, seed: int = 3) -> Model:
    """Counts over a bounded sample of the labelled rows of ``docs (doc_id, text, lang)``: ``per_language`` documents each.

    A language keeps its single bytes and, up to ``max_grams``, its most frequent byte strings, of those seen ``min_count`` times in its sample.
    At most languages times ``max_grams`` counts come to the driver and go to the workers.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    labelled = labelled.withColumn("drawn", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    sizes = [(r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not sizes:
        return Model({}, order, max_contexts)
    # Somewhat more than is wanted passes a threshold on the hash; the exact bound is then a rank over few rows.
    share = F.lit(False)
    for lang, n in sizes:
        keep = min(1.0, 1.2 * per_language / n + 20 / n)
        share = F.when(F.col("lang") == lang, F.pmod("drawn", F.lit(1 << 30)) < int(keep * (1 << 30)) + 1).otherwise(share)
    order_by = Window.partitionBy("lang").orderBy("drawn", "doc_id", "text")
    sample = labelled.where(share).withColumn("place", F.row_number().over(order_by)).where(F.col("place") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint64)
                code = data
                for size in range(1, order + 2):
                    if size > 1:
                        code = (code[:-1] << np.uint64(8)) | data[size - 1:]
                    found.setdefault((lang, size), []).append(code)
            for (lang, size), parts in found.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array([size] * len(codes), pa.int32()),
                     pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "size", "code", "n"])

    if order > 6:
        raise ValueError("contexts of at most 6 bytes")
    grams = sample.select("lang", "text").repartition(16).mapInArrow(count, "lang string, size int, code long, n long")
    grams = grams.groupBy("lang", "size", "code").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | (F.col("size") == 1))
    counts: dict[str, dict[bytes, int]] = {lang: {} for lang, _ in sizes}
    own = Window.partitionBy("lang").orderBy((F.col("size") == 1).desc(), F.desc("n"), "size", "code")
    for row in grams.withColumn("place", F.row_number().over(own)).where(F.col("place") <= max_grams).collect():
        counts[row["lang"]][row["code"].to_bytes(row["size"], "big")] = row["n"]
    return Model(counts, order, max_contexts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, in place of columns of these names; reads ``text`` only."""
    docs = docs.drop("lang_pred", "score")
    spark, n = docs.sparkSession, len(docs.columns)
    sent = spark.sparkContext.broadcast(model)
    letters, = fresh(docs, "letters")
    found = docs.select(*[docs[c] for c in docs.columns], F.coalesce(docs["text"].rlike(LETTER), F.lit(False)).alias(letters))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in slices(batches, at):
            letters = batch.column(n).to_numpy(zero_copy_only=False)
            names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if known.languages and batch.num_rows:
                texts = batch.column(at).cast(pa.large_string()).fill_null("")
                offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
                names, scores = known.predict(known.code_lengths(data, offsets))
            names = [name if ok else UNDETERMINED for name, ok in zip(names, letters)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(names, pa.string()), pa.array(np.where(letters, scores, 0.0))],
                names=[*batch.schema.names[:n], "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return found.mapInArrow(run, schema)
