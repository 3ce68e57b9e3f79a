"""Periodic run detection by maximal pairs (operator 12).

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``least`` words long, that no neighbouring word extends. Two occurrences of one
string that can be extended neither to the left nor to the right are a maximal pair; a run of length L and period q is the maximal pair
of length L - q at distance q. So maximal pairs that are close enough for their length are exactly the runs, with those of a multiple of the period beside
them, which cover the same words; none has to be extended.

1. Words become numbers and are sorted by prefix doubling; the ranks of every doubling are kept and give the longest common prefix (LCP) of neighbours. A word
   that starts no string of four words that occurs twice in its text cannot start a pair and is left out of the next steps.
2. The tree of LCP intervals is gone through bottom-up. A node holds the places of its suffixes in order, and lists of them by class, the word to their left.
   When two children of a node meet, pairs from different children and of different classes are maximal, with the node's length; only those
   close enough are looked up, from the smaller child in the larger one.
3. Occurrences of one string within half its length of each other are evenly spaced, and all but the first have the same word to their left. So a suffix needs
   to look at the class of its next neighbour and at the first place in reach only, and every pair that is looked at is a result.
4. Of pairs that cover the same words the one of the smallest distance is the run.

Texts are read whole; many short ones are sorted together, and none is compared with another. Memory is bounded by a slice of texts of some megabytes, or the longest text
(some 300 bytes per word). Nothing is shuffled.

A null or empty text has no words and no runs, and collapses to an empty text. Repeated rows have their runs each; an empty table gives no rows. Only ``doc_id``,
which may be null, and the text are read, so other columns do not disturb.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptide.llm.common import slices

FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _heads(changed: np.ndarray) -> np.ndarray:
    """The place of the last change up to each place."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def _changes(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]])


def sorted_suffixes(words: np.ndarray, owner: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``shortest`` words or, in part, fewer with another of their text, in order, and the LCP of each with the one before.

    ``owner`` is the text of each word and ``ends`` where it ends. Equal words of different texts never count as equal.
    """
    n = len(words)
    key = owner.astype(np.int64) * (int(words.max()) + 1) + words
    active = np.argsort(key, kind="stable")
    new = _changes(key[active])
    rank = np.empty(n, dtype=np.int32)
    rank[active] = _heads(new)
    single = new & np.append(new[1:], True)
    active = active[~single]
    levels, length, kept = [rank], 1, None
    while True:
        if kept is None and (2 * length > shortest or not len(active)):
            kept = active
        if not len(active):
            break
        after = active + length
        follows = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + follows
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old, new = rank[active], _changes(key)
        rank = rank.copy()
        rank[active] = old + (_heads(new) - _heads(_changes(old)))
        active = active[~(new & np.append(new[1:], True))]
        levels.append(rank)
        length *= 2
    suffixes = kept[np.argsort(rank[kept], kind="stable")]
    lcp = np.zeros(len(suffixes), dtype=np.int64)
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(a), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        equal = inside & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        common += equal.astype(np.int64) << level
    lcp[1:] = common
    return suffixes, lcp


def _meet(a: tuple, b: tuple, length: int, left: list[int], least: int, exponent: int, found: list) -> tuple:
    """Two children of a node of ``length`` made one; the maximal pairs between them that are close enough go to ``found``."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    places, classes = a
    reach = length // (exponent - 1)
    for i in b[0]:
        at, own = bisect_left(places, i), left[i]
        if at < len(places) and places[at] - i <= reach and left[places[at]] != own:
            later = classes[left[places[at]]]
            for k in range(bisect_left(later, i), len(later)):
                distance = later[k] - i
                if distance > reach:
                    break
                if distance + length >= least:
                    found.append((i, distance + length, distance))
        if at and i - places[at - 1] <= reach:
            first = places[bisect_left(places, i - reach)]
            if left[first] != own and i - first + length >= least:
                found.append((first, i - first + length, i - first))
    for i in b[0]:
        insort(places, i)
    for word, some in b[1].items():
        mine = classes.get(word)
        if mine is None:
            classes[word] = some
        else:
            for i in some:
                insort(mine, i)
    return a


def close_pairs(suffixes: list[int], lcp: list[int], left: list[int], shortest: int, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length covered, distance) of the maximal pairs that are close enough, from the tree of LCP intervals bottom-up."""
    found: list[tuple[int, int, int]] = []
    open_nodes: list[list] = []
    child = None
    for k in range(len(suffixes) + 1):
        here = lcp[k] if k < len(suffixes) and k else 0
        if here < shortest:
            here = 0
        while open_nodes and open_nodes[-1][0] > here:
            length, node = open_nodes.pop()
            child = _meet(node, child, length, left, least, exponent, found)
        if here:
            if open_nodes and open_nodes[-1][0] == here:
                open_nodes[-1][1] = _meet(open_nodes[-1][1], child, here, left, least, exponent, found)
            else:
                open_nodes.append([here, child])
        if k < len(suffixes):
            i = suffixes[k]
            child = ([i], {left[i]: [i]})
    return found


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Runs in texts of ``sizes`` words each that stand one after another in ``words``: rows (start, length, period), starts counted over all words."""
    if exponent < 3:
        raise ValueError("pairs are evenly spaced from three periods on")
    shortest = min(max(least - q, (exponent - 1) * q) for q in range(1, max(least, 1) + 1))
    if not len(words):
        return np.zeros((0, 3), dtype=np.int64)
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    suffixes, lcp = sorted_suffixes(words, owner, np.repeat(stops, sizes), shortest)
    left = np.concatenate([[-1], words[:-1]])
    left[(stops - sizes)[sizes > 0]] = -1
    pairs = close_pairs(suffixes.tolist(), lcp.tolist(), left.tolist(), shortest, least, exponent)
    if not pairs:
        return np.zeros((0, 3), dtype=np.int64)
    rows = np.array(pairs, dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
    rows = rows[np.concatenate([[True], ~same])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find(docs: DataFrame, text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    ``runs`` holds (start, length, period) by start, then period, words numbered from 0; ``collapsed`` is the words joined by one space without those that a run contains
    after its first period.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            tokens = [t.split() if t else [] for t in texts]  # bytes are split at the six blanks of ASCII
            sizes = np.array([len(t) for t in tokens], dtype=np.int64)
            flat = [word for part in tokens for word in part]
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            found = runs_of(coded.indices.to_numpy().astype(np.int64), sizes, least, exponent)
            starts, lengths, periods = found.T
            steps = np.zeros(len(flat) + 1, dtype=np.int64)
            np.add.at(steps, starts + periods, 1)
            np.add.at(steps, starts + lengths, -1)
            keep = np.cumsum(steps)[:-1] == 0
            begins = np.cumsum(sizes) - sizes
            owner = np.searchsorted(begins, starts, side="right") - 1
            offsets = np.searchsorted(owner, np.arange(len(sizes) + 1))
            changed = set(owner.tolist())
            collapsed = [b" ".join(compress(part, keep[begins[k]:begins[k] + len(part)].tolist()) if k in changed else part) for k, part in enumerate(tokens)]
            run_rows = pa.StructArray.from_arrays([pa.array(starts - begins[owner]), pa.array(lengths), pa.array(periods)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), run_rows),
                pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    read = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, {FOUND}")
