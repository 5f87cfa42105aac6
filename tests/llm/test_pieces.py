"""Merge rounds against the sentencepiece library, on texts that provoke ties, unsafe merges, runs of marks and bytes."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tabwright.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, `text_` int, decoded double"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def texts(model, seed):
    rnd = random.Random(seed)
    parts = ["a", "b", "en", "e", "n", " ", "  ", "▁", "\n", "\t", "é", "1", "中", "😀", "\x00", "-", "'", "A", "̀", "<s>", "<0x41>", "een", "ous", "ly", "�"]
    unsafe = [model.pieces[model.by_rank[i]].strip("▁") for i in np.flatnonzero(model.unsafe)]
    for _ in range(300):
        yield "".join(rnd.choice(parts) for _ in range(rnd.choice([1, 5, 30, 120])))
        yield "".join(model.pieces[rnd.randrange(259, 32000)] for _ in range(rnd.choice([1, 3, 20])))
        yield "".join(rnd.choice(unsafe) * rnd.choice([1, 1, 3]) for _ in range(rnd.choice([1, 3, 20])))
    for n in (*range(1, 36), 5000):
        yield from (" " * n, "x" + " " * n + "the", " " * n + "中")
    yield from ("", "een" * 5000, "".join(rnd.choice("etaoin") for _ in range(4000)), "a" * 5000)


def test_ids_and_texts_are_the_librarys(model, library):
    cases = list(texts(model, 7))
    for text, ids in zip(cases, model.encode(cases), strict=True):
        assert ids == library.encode(text), text[:80]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_any_ids_decode_as_the_library_does(model, library):
    rnd = random.Random(1)
    for _ in range(300):
        ids = [rnd.randrange(0, rnd.choice([259, 32000])) for _ in range(rnd.randrange(12))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_memo_does_not_change_ids(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_ENTRIES", 3)
    cases = list(texts(model, 8))[:200]
    for at in range(0, 200, 7):
        assert model.encode(cases[at : at + 7]) == [library.encode(t) for t in cases[at : at + 7]]


def test_tables(spark, library):
    rows = [(1, "some text", "x", 1, 1.0), (1, "some text", "x", 1, 1.0), (2, None, None, None, None), (None, "", "y", 2, 0.0), (3, "  lead\nand 中 😀 ", "z", 3, 3.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, pieces.digests(docs).collect()), key=str)
    want = []
    for key, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((key, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids)))))
    assert found == sorted(want, key=str)
    encoded = pieces.encode(docs)
    assert encoded.columns == [*docs.columns, "_ids"]
    back = pieces.decode(encoded, "_ids").collect()
    assert sorted((r["_decoded"], r["text"] or "") for r in back) == sorted((r[1] or "", r[1] or "") for r in rows)
    assert pieces.digests(docs.limit(0)).count() == 0
    assert "op11_piece_merges" in queries.QUERIES
