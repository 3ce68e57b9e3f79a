import math
import zlib

import numpy as np

from shoptide.llm import language
from shoptide.llm.queries import op3_language
from tests.llm.data import FOLDER, documents, empty, odd

COUNTS = {
    "aa": {b"a": 6, b"b": 3, b"ab": 3, b"ba": 2, b"aba": 2, b"bab": 1},
    "bb": {b"b": 7, b"c": 1, b"bb": 5, b"bc": 1, b"bbb": 4},
}


def share(counts, seen, context, byte):
    """Probability of a byte after a context, written out as recursion."""
    if context is None:
        return 1 / 256
    followers = {g[-1]: n for g, n in counts.items() if g[:-1] == context}
    shorter = context[1:] if context else None
    if not followers:
        return share(counts, seen, shorter, byte)
    both = sum(followers.values()) + len(followers)
    if byte in followers:
        return followers[byte] / both
    left = 1 - sum(share(counts, seen, shorter, b) for b in followers)
    return len(followers) / both * share(counts, seen, shorter, byte) / left


def plain_bits(counts, text, order):
    data, bits = text.encode(), 0.0
    contexts = {g[:-1] for c in COUNTS.values() for g in c}
    for i, byte in enumerate(data):
        context = data[max(0, i - order):i]
        while context not in contexts:
            context = context[1:]
        bits -= math.log2(share(counts, None, context, byte))
    return bits


def test_code_lengths_are_those_of_the_recursion():
    model = language.Model(COUNTS, 2)
    texts = ["", "abab", "bbbc", "aé", "cab bba", "b" * 50]
    coded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    data = np.frombuffer(b"".join(coded), dtype=np.uint8)
    for chunk in (3, 1000):
        bits = model.code_lengths(data, offsets, chunk)
        for i, t in enumerate(texts):
            for n, lang in enumerate(model.languages):
                assert abs(bits[i, n] - plain_bits(COUNTS[lang], t, 2)) < 1e-3


def test_shares_of_a_context_add_up_to_one():
    model = language.Model(COUNTS, 2)
    (classes, _, costs, width), = model.tables
    states = len(costs) // width
    shares = np.exp2(-costs.reshape(states, width, -1).astype(float))
    assert np.allclose(shares[:, classes].sum(axis=1), 1, atol=1e-4)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op3_language(spark, FOLDER).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.98


def test_odd_rows(spark):
    train = documents(spark, [(i, "the of and with that", "en", "a") for i in range(50)] + [(i, "der die und ist nicht", "de", "a") for i in range(50, 99)])
    model = language.learn(train)
    rows = odd()
    found = language.predict(documents(spark, rows), model).collect()
    assert len(found) == len(rows)
    for r in found:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert language.predict(empty(spark), model).count() == 0
    nothing = language.learn(empty(spark))
    assert {r.lang_pred for r in language.predict(documents(spark, rows), nothing).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    rows = [(i, "abc " * 5, "en", "a") for i in range(400)] + [(7, "abc " * 5, "en", "a")] * 300
    model = language.learn(documents(spark, rows), per_language=20, min_count=1)
    assert model.counts["en"][b"a"] == 20 * 5


def test_forty_languages_with_few_rows_each(spark):
    """Languages of made-up words over one alphabet; one has a hundred times the rows of the others, and takes nothing from them."""
    rng = np.random.default_rng(11)
    words = {f"l{i:02}": ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(25)] for i in range(40)}
    said = lambda lang: " ".join(rng.choice(words[lang], 40))
    rows = [(i * 1000 + k, said(lang), lang, "a") for i, lang in enumerate(words) for k in range(400 if i == 0 else 4)]
    model = language.learn(documents(spark, rows))
    assert model.languages == sorted(words)
    asked = [(i, said(lang), None, "a") for i, lang in enumerate(words)]
    found = {r.doc_id: r.lang_pred for r in language.predict(documents(spark, asked), model).collect()}
    assert np.mean([found[i] == lang for i, lang in enumerate(words)]) >= 0.95


def test_code_lengths_do_not_depend_on_the_languages_beside():
    rng = np.random.default_rng(4)
    counts = {}
    for n in range(7):
        text = bytes(rng.choice(list(b"abcdef"), 400))
        grams = [text[i:i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1)]
        counts[f"l{n}"] = {g: grams.count(g) for g in set(grams)}
    data = np.frombuffer(b"abcabcfedxyz" * 20, dtype=np.uint8)
    offsets = np.array([0, 100, 100, len(data)])
    whole = language.Model(counts, 2, max_contexts=9).code_lengths(data, offsets)
    for n, name in enumerate(counts):
        alone = language.Model({name: counts[name]}, 2, max_contexts=9).code_lengths(data, offsets)
        assert np.allclose(whole[:, n], alone[:, 0], rtol=1e-5)
