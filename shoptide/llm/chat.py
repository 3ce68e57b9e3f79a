r"""Chat formatting by columnar byte assembly (operator 10).

A turn becomes ``<|im_start|>role<|im_sep|>text<|im_end|>``. Role and text are escaped so that no control string of
this or another common template can occur in them: a backslash is doubled, and a control string gets one after its first character.
Taking away the first backslash of each pair or single one gives back the text.

The rows of a conversation come together by a shuffle on its id and are sorted by turn. Per piece of a batch numpy computes the
lengths of all segments, their offsets by a running sum, and copies fixed parts and contents into one preallocated buffer, which becomes
the Arrow column as it is: short segments by scatter indices, long ones as slices.

A conversation that passes ``chunk`` bytes comes out in chunks, cut between turns and numbered from 0, each with its own spans, so a task holds a few
chunks or one turn, however long a conversation (as that of all rows without an id) is. It stays in one task, in a stream: its chunks follow one
another and its digest is one running hash. Its sort spills. A turn must fit a Spark string with its escapes.

Nulls: a null text or role is empty, a null conversation id is a conversation of its own, null turns come first. Equal turns are
ordered by role and text; repeated rows are all kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptide.llm.common import slices

START, BETWEEN, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROLS = (START, BETWEEN, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>")
FORMATTED = "conv_id long, chunk long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
#: Longer segments are copied without indices, which take many times their bytes.
LONG = 4096
FORMATTED_TEXT = 3  # the place of the text in its result
TEXT = 2  # the place of the text in what ``format_chats`` sorts
READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for control in CONTROLS:
        texts = pc.replace_substring(texts, control, f"{control[0]}\\{control[1:]}")
    return texts


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\", "") for part in text.split("\\\\"))


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of large strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copies the segment ``data[starts[i]:][:lengths[i]]`` to ``out[at[i]:]`` for all i: those up to ``LONG`` at once, the few longer ones each as a slice."""
    for i in np.flatnonzero(lengths > LONG):
        out[at[i]:at[i] + lengths[i]] = data[starts[i]:starts[i] + lengths[i]]
    short = lengths <= LONG
    at, starts, lengths = at[short], starts[short], lengths[short]
    before = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum()), dtype=np.int64)
    out[inside + np.repeat(at - before, lengths)] = data[inside + np.repeat(starts - before, lengths)]


def assemble(conv: pa.Array, roles: pa.Array, texts: pa.Array, loss_role: str, chunk: int = 0) -> pa.RecordBatch:
    """One row per run of equal ``conv``; ``chunk`` is the number of the first one within its conversation."""
    n = len(conv)
    known = conv.is_valid().to_numpy(zero_copy_only=False)
    ids = conv.fill_null(0).to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])]))
    role = _utf8(escape(roles))
    text = _utf8(escape(texts))
    fixed = np.frombuffer((START + BETWEEN + END).encode(), dtype=np.uint8)
    widths = [len(START), role[2], len(BETWEEN), text[2], len(END)]
    lengths = np.stack([np.broadcast_to(w, n) for w in widths], axis=1).astype(np.int64)
    at = (np.cumsum(lengths.ravel()) - lengths.ravel()).reshape(n, 5)
    total = int(lengths.sum())
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    begin = 0
    for k, width in ((0, len(START)), (2, len(BETWEEN)), (4, len(END))):
        _scatter(out, at[:, k], fixed, np.full(n, begin), np.full(n, width))
        begin += width
    _scatter(out, at[:, 1], *role)
    _scatter(out, at[:, 3], *text)
    ends = np.append(at[first[1:], 0], total)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    # Code points of each segment; ``reduceat`` gives one byte for an empty one.
    points = np.where(lengths.ravel() > 0, np.add.reduceat((out & 0xC0) != 0x80, at.ravel(), dtype=np.int64), 0)
    chars = (np.cumsum(points) - points).reshape(n, 5)
    loss = np.flatnonzero(pc.equal(roles, loss_role).to_numpy(zero_copy_only=False))
    group = np.searchsorted(first, loss, side="right") - 1
    base = chars[first[group], 0]
    chunks = np.zeros(len(first), dtype=np.int64)
    chunks[0] = chunk
    spans = pa.array(np.searchsorted(group, np.arange(len(first) + 1)), pa.int32())
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer).cast(pa.string())
    return pa.RecordBatch.from_arrays([
        conv.take(pa.array(first)), pa.array(chunks), pa.array(np.diff(np.append(first, n))), formatted,
        pa.ListArray.from_arrays(spans, pa.array(chars[loss, 3] - base)),
        pa.ListArray.from_arrays(spans, pa.array(chars[loss, 4] - base)),
    ], names=["conv_id", "chunk", "n_turns", "formatted", "loss_starts", "loss_ends"])


def format_chats(rows: DataFrame, loss_role: str = "assistant", chunk: int = 1 << 22) -> DataFrame:
    """``conv_id, chunk, n_turns, formatted, loss_starts, loss_ends`` of ``rows (conv_id, turn, role, text)``.

    Most conversations are one row; one of more than ``chunk`` bytes is several, in order within their partition. Loss spans are code points of
    ``formatted``, the end exclusive: the escaped text of each turn of ``loss_role``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size, number = [], 0, 0  # the conversation that may go on: its rows not yet given out, their bytes, the number of their chunk

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            column = {c: whole[c].combine_chunks() for c in whole.column_names}
            return assemble(column["conv_id"], *[column[c].cast(pa.large_string()).fill_null("") for c in ("role", "text")], loss_role, number)

        open_id = None  # that conversation, as an array of one value, so that a null one is one as well
        for piece in slices(batches, TEXT, chunk):
            conv = piece.column("conv_id")
            last = conv[-1]
            same = pc.equal(conv, last).fill_null(False) if last.is_valid else conv.is_null()
            cut = piece.num_rows - int(pc.sum(same).as_py())
            if open_id is not None and (cut or not open_id.equals(conv.slice(0, 1))):
                # The open conversation ends in or before this piece: it goes out with all that are whole.
                goes_on = open_id.equals(conv.slice(0, 1))
                if not goes_on and pending:
                    yield flush(pending)
                    pending = []
                number = number if goes_on else 0
                if cut or pending:
                    yield flush([*pending, piece.slice(0, cut)])
                pending, size, number = [], 0, 0
            elif cut:
                yield flush([piece.slice(0, cut)])
            rest = piece.slice(cut)
            pending.append(rest)
            size += int(pc.sum(pc.binary_length(rest.column(TEXT))).as_py() or 0)
            open_id = conv.slice(cut, 1)
            if size >= chunk:
                yield flush(pending)
                pending, size, number = [], 0, number + 1
        if pending:
            yield flush(pending)

    wanted = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
                         F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(run, FORMATTED)


def read_back(formatted: str, loss_starts: list[int], loss_ends: list[int]) -> tuple[list[tuple[str, str]], str]:
    """The turns and all text under the loss mask, unescaped, from a formatted conversation alone."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(START).partition(BETWEEN)
        turns.append((unescape(role), unescape(text)))
    return turns, "".join(unescape(formatted[a:b]) for a, b in zip(loss_starts, loss_ends))


def digests(chats: DataFrame) -> DataFrame:
    """What ``op10_chat`` returns, read back from the output of ``format_chats``, whose order within partitions it needs; holds one piece of chunks."""
    from hashlib import sha256

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, said, loss_chars, loss, chars = None, 0, None, 0, None, 0
        for piece in slices(batches, FORMATTED_TEXT):
            rows = []
            for row in piece.to_pylist():
                if row["chunk"] == 0:
                    if said is not None:
                        rows.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    conv, turns, said, loss_chars, loss, chars = row["conv_id"], 0, sha256(), 0, sha256(), 0
                spoken, learned = read_back(row["formatted"], row["loss_starts"], row["loss_ends"])
                for role, text in spoken:
                    said.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
                turns, loss_chars, chars = turns + len(spoken), loss_chars + len(learned), chars + len(row["formatted"])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=names)
        if said is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars), kinds)], names=names)

    return chats.mapInArrow(run, READ)
