import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from shoptide.llm import pieces
from shoptide.llm.queries import op1_pieces
from tests.llm.data import FOLDER, documents, empty, odd

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(text):
    return np.frombuffer(pieces.model(PATH).encode(text), dtype=np.int32).tolist()


def test_compatible_pairs_are_those_that_merging_leaves():
    known, rng = pieces.model(PATH), random.Random(1)
    names = list(known.splits)
    for n in (300, len(names)):
        for _ in range(4000):
            a, b = rng.choice(names[:n]), rng.choice(names[:n])
            assert known.compatible(a, b) == (known.merged(a + b)[0] == [a, b])


def test_any_text_is_encoded_as_by_the_library(library):
    rng = random.Random(2)
    parts = ["a", "th", "e", " ", "  ", "\n", "\t", "é", "漢", "𝄞", "\u2581", "<s>", "</s>", "<0x0A>", "0", "ing", "\x00", "\r\n", " " * 20, " \n ", "."]
    vocabulary = list(pieces.model(PATH).id_of)
    for i in range(3000):
        text = "".join(rng.choice(parts if i % 2 else vocabulary) for _ in range(rng.randint(0, 25)))
        text = text if i % 4 else text.replace("\u2581", " ")
        assert ids(text) == library.encode(text)
    assert ids("ab" * 40_000) == library.encode("ab" * 40_000)


def test_one_stretch_is_encoded_like_many(library):
    known = pieces.Pieces(*pieces.model(PATH).__reduce__()[1])
    known.falls_apart = False
    for text in ("a b  c\nd", "   ", "x \n y"):
        assert np.frombuffer(known.encode(text), dtype=np.int32).tolist() == library.encode(text)


def test_query_equals_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op1_pieces(spark, FOLDER).collect()
    assert len(found) == len(docs)
    for row in found:
        want = [*library.encode(docs[row.doc_id] or ""), library.eos_id()]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(library.decode(want).encode()).hexdigest()


def test_odd_rows(spark, library):
    rows = odd()
    docs = documents(spark, rows)
    found = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert len(found) == len(rows)
    wanted = sorted((repr(i), [*library.encode(t or ""), 2]) for i, t, _, _ in rows)
    assert sorted((repr(r.doc_id), list(r.ids)) for r in found) == wanted
    for r in found:
        assert r.decoded == library.decode(list(r.ids))
    assert pieces.decode(pieces.encode(empty(spark), PATH), PATH).count() == 0
    both = pieces.round_trip(docs, PATH)
    assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in both.collect()) == sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in found)


def test_bytes_that_are_no_text(spark, library):
    byte = pieces.model(PATH).byte_ids
    odd_ids = [[byte[0xC3]], [byte[0xE6], byte[0xBC], 264], [], [2], [1, 264, 2], [0, 264], [1, 0, 264], [byte[0xF0], byte[0x9D], byte[0x84]], [264, 0, 0]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(odd_ids)], "doc_id long, ids array<int>")
    for r in pieces.decode(docs, PATH).collect():
        assert r.decoded == library.decode(odd_ids[r.doc_id])
