"""SentencePiece encoding and decoding with merge-type models (operator 1).

Encoding keeps, for every prefix of a stretch of text, its unique last token: an automaton names the pieces that end there, and
the one is taken that is compatible with the last token of the prefix before it. Walking back from the end gives the ids.
Two tokens are compatible if merging their joined text never merges across the seam; the seam's right edge of the first token and left edge
of the second grow piece by piece, so it is enough to test the pairs of these edges.

No piece of such a model crosses from a character to a space after it, so a text falls into stretches at these places, and
equal stretches are encoded once per worker (a cache of bounded size). A model for which that does not hold is encoded in one stretch.

A null text is an empty one: the end id alone. Characters no piece has become byte tokens. Texts are never cut; ties of scores go to the left
merge, as the library does. Repeated rows, empty tables and further columns pass through unchanged.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptide.llm.common import fresh, slices

SPACE = "\u2581"
#: Fixed value: what stands for the unknown id in a decoded text.
UNKNOWN = " \u2047 "
IDS = T.ArrayType(T.IntegerType())
MAX_CACHED = 300_000
MAX_CACHED_LENGTH = 64


class Pieces:
    """The tables of a model. Small: its size is that of the vocabulary."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], controls: list[int], end_id: int, unknown: int, splits=None):
        """``pieces``: text, id and score of what may be merged; ``byte_ids``: the id of each byte."""
        self.byte_ids, self.controls, self.end_id, self.unknown = byte_ids, controls, end_id, unknown
        self.pieces = pieces
        if splits:
            self.splits = splits

    def __reduce__(self):
        return Pieces, (self.pieces, self.byte_ids, self.controls, self.end_id, self.unknown, self.splits)

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte tokens")
        other = [i for i in ids if model.is_control(i) or model.is_unknown(i)]
        skip = {*byte_ids.values(), *other}
        pieces = [(model.id_to_piece(i), i, model.get_score(i)) for i in ids if i not in skip]
        return Pieces(pieces, [byte_ids[b] for b in range(256)], other, model.eos_id(), model.unk_id())

    @cached_property
    def rank(self) -> dict[str, int]:
        """By text: the place in the order of merges; equal scores share one."""
        place = {s: r for r, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return {text: place[s] for text, _, s in self.pieces}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The plain way: merge the best pair, the leftmost of equals, until there is none; and the last pair merged."""
        parts, last, rank = list(text), None, self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    @cached_property
    def splits(self) -> dict[str, tuple[str, str] | None]:
        """The pieces that merging can make, each with the pair it is made of."""
        found = {}
        for text, _, _ in self.pieces:
            parts, last = self.merged(text)
            if len(parts) == 1:
                found[text] = last
        return found

    @cached_property
    def id_of(self) -> dict[str, int]:
        return {text: i for text, i, _ in self.pieces}

    def _edge(self, text: str, side: int) -> list[tuple[str, int, float]]:
        """From the outside in: the piece at one edge, its rank, and the rank at which it is merged into a larger one."""
        chain, above = [], float("inf")
        while text:
            split, rank = self.splits[text], self.rank[text]
            rank = rank if split else -1
            chain.append((text, rank, above))
            if not split:
                break
            text, above = split[side], rank
        return chain

    @cached_property
    def right_edges(self) -> dict[str, list]:
        return {text: self._edge(text, 1) for text in self.splits}

    @cached_property
    def left_edges(self) -> dict[str, list]:
        return {text: self._edge(text, 0) for text in self.splits}

    def compatible(self, first: str, second: str) -> bool:
        """Whether merging the joined text gives these two pieces again."""
        rank = self.rank
        for x, x_rank, x_above in self.right_edges[first]:
            for y, y_rank, y_above in self.left_edges[second]:
                r = rank.get(x + y)
                if r is not None:
                    when = max(r, x_rank, y_rank)
                    if when < x_above and when <= y_above:
                        return False
        return True

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for text in self.splits:
            found.add_word(text, (len(text), text))
        found.make_automaton()
        return found

    @cached_property
    def falls_apart(self) -> bool:
        """Whether no piece has a space after another character, or a line break beside one."""
        return not any(SPACE in text.lstrip(SPACE) or ("\n" in text and len(text) > 1) for text in self.id_of)

    def encode_stretch(self, text: str) -> list[int]:
        """The ids of a text in which spaces are already written as the model has them."""
        last: list[str | None] = [None] * (len(text) + 1)
        known = self._known
        for end, (length, piece) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if before is None:
                    last[end] = piece  # at the start, or after a character without pieces
                else:
                    pair = before, piece
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = self.compatible(before, piece)
                    if fits:
                        last[end] = piece
        if len(known) > MAX_CACHED:
            known.clear()
        ids, end, id_of = [], len(text), self.id_of
        while end:
            piece = last[end]
            if piece is None:
                ids.extend(self.byte_ids[b] for b in reversed(text[end - 1].encode()))
                end -= 1
            else:
                ids.append(id_of[piece])
                end -= len(piece)
        ids.reverse()
        return ids

    @cached_property
    def neighbours(self) -> set[str]:
        """The pairs of characters that are side by side in some piece; no merge crosses any other place."""
        return {text[i:i + 2] for text in self.id_of for i in range(len(text) - 1)}

    def encode_parts(self, text: str) -> bytes:
        """Like ``encode_stretch``, as bytes, cut where no piece can cross; parts are remembered."""
        parts, start, neighbours, found = [], 0, self.neighbours, self._parts
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in neighbours:
                parts.append(found[text[start:i]])
                start = i
        parts.append(found[text[start:]])
        return b"".join(parts)

    @cached_property
    def _parts(self) -> _Remembered:
        return _Remembered(lambda part: _packed(self.encode_stretch(part)))

    @cached_property
    def _known(self) -> dict[tuple[str, str], bool]:
        return {}

    @cached_property
    def _stretches(self) -> _Remembered:
        return _Remembered(lambda stretch: self.encode_parts(stretch.replace(" ", SPACE)))

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers one after another, without the end id."""
        if not text:
            return b""
        if not self.falls_apart:
            return self.encode_parts(SPACE + text.replace(" ", SPACE))
        self._stretches.trim()
        self._parts.trim()
        return b"".join(map(self._stretches.__getitem__, STRETCH.findall(" " + text.replace(SPACE, " "))))

    @cached_property
    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All surfaces one after another, the start of each id's and its length; control ids have none."""
        words = {i: text.replace(SPACE, " ").encode() for text, i, _ in self.pieces}
        words |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        words[self.unknown] = UNKNOWN.encode()
        size = max([*words, *self.controls]) + 1
        lengths = np.array([len(words.get(i, b"")) for i in range(size)], dtype=np.int64)
        return np.frombuffer(b"".join(words.get(i, b"") for i in range(size)), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


#: Spaces with the characters after them, or a line break alone.
STRETCH = re.compile(r"\n| *[^ \n]+| +")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"={len(ids)}i", *ids)


class _Remembered(dict):
    """Results by text, of bounded number and length of text."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(text) <= MAX_CACHED_LENGTH:
            self[text] = found
        return found

    def trim(self) -> None:
        if len(self) > MAX_CACHED:
            self.clear()


@cache
def model(path: str) -> Pieces:
    return Pieces.load(path)


def _shared(spark, path: str):
    """The model's tables, read by the driver and sent once to each executor; a worker keeps its copy, and its cache, over tasks."""
    return spark.sparkContext.broadcast(model(path))


def _encoded(known: Pieces, texts: pa.Array, end: bool) -> pa.ListArray:
    tail = _packed([known.end_id]) if end else b""
    found = [known.encode(text or "") + tail for text in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))


def _decoded(known: Pieces, ids: pa.ListArray) -> pa.Array:
    """All surfaces are copied at once; then each text is cut out."""
    codecs.register_error("each byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
    data, starts, lengths = known.surfaces
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    width = lengths[flat]
    ends = np.concatenate([[0], np.cumsum(width)])
    out = data[np.arange(ends[-1], dtype=np.int64) + np.repeat(starts[flat] - ends[:-1], width)].tobytes()
    cuts = ends[bounds]
    shown = flat[width > 0]
    first = np.concatenate([[0], np.cumsum(width > 0)])[bounds[:-1]]
    texts = []
    for a, b, i in zip(cuts[:-1], cuts[1:], first):
        part = out[a:b].decode("utf-8", "each byte")
        texts.append(part[1:] if part.startswith(" ") and shown[i] != known.unknown else part)
    return pa.array(texts, pa.string())


def _added(docs: DataFrame, path: str, read: str, fields: list[T.StructField], drop: bool, work) -> DataFrame:
    """``docs`` with the columns ``fields``, which ``work`` makes from a batch of the column ``read``."""
    sent = _shared(docs.sparkSession, path)
    kept = [c for c in docs.columns if c not in [f.name for f in fields] and not (drop and c == read)]
    n, names = len(kept), [*kept, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n, 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *work(sent.value, batch.column(n))], names=names)

    source, = fresh(docs, "source")
    schema = T.StructType([*[docs.schema[c] for c in kept], *fields])
    return docs.select(*[docs[c] for c in kept], docs[read].alias(source)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) in place of ``text``."""
    return _added(docs, path, text, [T.StructField(ids, IDS)], True, lambda known, column: [_encoded(known, column, end)])


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text``, the text of ``ids``; ``ids`` stay. Each byte that is not UTF-8 becomes U+FFFD."""
    return _added(docs, path, ids, [T.StructField(text, T.StringType())], False, lambda known, column: [_decoded(known, column)])


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", end: bool = True) -> DataFrame:
    """``docs`` with ``ids`` in place of ``text``, and ``decoded``, the text of these ids: both in one pass."""
    def work(known: Pieces, column: pa.Array) -> list[pa.Array]:
        found = _encoded(known, column, end)
        return [found, _decoded(known, found)]

    return _added(docs, path, text, [T.StructField(ids, IDS), T.StructField(decoded, T.StringType())], True, work)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, " ").cast("binary"), 256)
