import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from shoptide.llm import runs
from shoptide.llm.queries import op12_runs
from tests.llm.data import FOLDER, documents, empty, odd


def plain(words, least=6, exponent=4):
    """Every period compared with the whole text; the smallest period of each stretch."""
    names = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes, found = np.array([names[w] for w in words]), {}
    for q in range(1, len(words) // exponent + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        for a, b in zip(np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])):
            if b - a + q >= max(least, exponent * q):
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("exponent", [3, 4, 6])
def test_runs_equal_plain_comparison(exponent):
    rng = random.Random(exponent)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            words = []
            for _ in range(rng.randint(0, 8)):
                words += [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(1, 7))] * rng.choice([1, 1, 2, 4, 5, 9])
            texts.append(words)
        want, before = [], 0
        for words in texts:
            want += [(s + before, length, q) for s, length, q in plain(words, exponent=exponent)]
            before += len(words)
        got = runs.runs_of(np.array([w for t in texts for w in t], dtype=np.int64), np.array([len(t) for t in texts]), exponent=exponent)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_periodic_texts_end_soon():
    for words in ([0] * 100_000, [0, 1] * 50_000, list(range(5)) * 20_000):
        assert len(runs.runs_of(np.array(words), np.array([len(words)]))) == 1


def test_texts_without_neighbouring_runs_share_nothing(spark):
    """A run ends with its text, though the next one goes on alike."""
    half = "a b a b a b a b"
    docs = documents(spark, [(i, half, "en", "s") for i in range(3)])
    assert {tuple(r.runs[0]) for r in runs.find(docs).collect()} == {(0, 8, 2)}


def test_odd_texts(spark):
    rows = [*odd(), (20, "x " * 9 + "y", "en", "s"), (21, "\x0bx\x0cx\rx x\tx\nx", "en", "s"), (22, "x x x x", "en", "s"), (None, "z z z z z z", "en", "s")]
    found = runs.find(documents(spark, rows)).collect()
    got = sorted((repr(r.doc_id), r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found)
    want = []
    for i, text, *_ in rows:
        words = words_of(text)
        want.append((repr(i), len(words), tuple(plain(words)), collapsed(words, plain(words))))
    assert got == sorted(want)
    assert runs.find(empty(spark)).count() == 0


def test_query_equals_plain_comparison(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {r.doc_id: r for r in op12_runs(spark, FOLDER).collect()}
    assert len(found) == len(docs)
    periodic = 0
    for row in docs:
        words = words_of(row.text)
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        each = plain(words)
        each.sort(key=lambda r: (r[0], r[2]))
        periodic += bool(each)
        best = min(each, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (len(each), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                sha256("".join(f"{s},{length},{q}\n" for s, length, q in each).encode()).hexdigest(), sha256(collapsed(words, each).encode()).hexdigest())
        got = found[row.doc_id]
        assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli, got.runs_sha256, got.collapsed_sha256) == want
    assert periodic > 10
