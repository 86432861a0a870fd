"""SentencePiece encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from linkwatch.llm import pieces
from tests.llm.helpers import awkward, empty, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(PATH))


def odd_texts():
    rng = random.Random(3)
    texts = [
        "", " ", "  ", " " * 5000, " " * 17, "a" * 9000, "\n\n\n", "é ü ß 漢字 \U0001f600 &|# " * 30, "<s></s><unk><0x41>", "▁▁a▁", "a\x00b", "\ufffd", " \t x",
        "the" * 3000, "=-" * 4000, "    if x:\n        return 1\n\t\tfoo", "\x85\xa0\u3000", prose(1),
    ]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x500), rng.randint(0x4E00, 0x9000), rng.randint(0x1F300, 0x1F600)])) for _ in range(3000))]
    texts += ["".join(rng.choice("abcdeirst") for _ in range(6000)), "".join(rng.choice(" ab\n") for _ in range(6000))]
    parts = ["ation", "the", "in", "er", " ", "  ", "s", "on", "re", "▁", "é", "漢", "\n", "0"]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(2000)]


def test_encodes_as_the_library(model, library):
    texts = odd_texts()
    ids, ends = model.encode(texts)
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    assert [model.decode(np.array(x, np.int32)) for x in want] == library.decode(want)


def test_words_kept_from_batch_to_batch(model, library):
    texts = odd_texts()[-200:]
    for _ in range(2):
        ids, ends = model.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == library.encode(texts)


def test_long_words_take_the_same_merges(model, library, monkeypatch):
    texts = odd_texts()
    monkeypatch.setattr(pieces, "LONG", 3)
    model._forget()
    ids, ends = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == library.encode(texts)


def test_decodes_any_ids(model, library):
    rng = random.Random(5)
    kinds = [lambda: rng.randint(0, 2), lambda: rng.randint(3, 258), lambda: rng.randint(259, 31999)]
    for _ in range(3000):
        ids = [rng.choice(kinds)() for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_columns(spark, library):
    model = pieces.read_model(PATH)
    docs = awkward(spark)
    out = pieces.with_decoded(pieces.with_ids(docs, model), model)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    for r in out.collect():
        ids = library.encode(r["text"] or "")
        assert list(r["ids"]) == ids and r["decoded"] == library.decode(ids) and r["key"] == "mine"
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.piece_digests(docs, model).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want.append((str(r["doc_id"]), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)
    assert pieces.piece_digests(empty(spark), model).collect() == []


def test_models_that_are_not_supported():
    data = pieces.read_model(PATH)
    # A piece set by hand: message 1 with text, score and kind 4.
    with pytest.raises(ValueError, match="by hand"):
        pieces.PieceModel(data + b"\x0a\x0a\x0a\x01~\x15\x00\x00\x00\x00\x18\x04")
    with pytest.raises(ValueError, match="byte fallback"):
        pieces.PieceModel(b"")
