import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gramloom.llm import bpetree


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path(bpetree.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return bpetree.vocabulary(public_tokenizers.path(bpetree.VOCABULARY))


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def test_random_texts_equal_the_library(vocab, library, monkeypatch):
    monkeypatch.setattr(bpetree, "LEAF_CHARS", 7)
    rng = random.Random(5)
    alphabets = ["ab", "abc  ", " \n\t", "aé ñ'sll1 2.!?", "the of and ing ed", "漢字かな é  x ", "<|endoftext|>'re've"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 120)))
        got = vocab.encode(text)
        assert ids(got) == library.encode_ordinary(text), text
        assert vocab.decode(np.frombuffer(got, dtype="<u4")) == text.encode()


def test_long_matches_join_over_seams(vocab, library):
    rng = random.Random(6)
    for alphabet in ("a", "ab", "abcdefgh", "theinganderof", "é", "zz", "0123456789", "-=*"):
        for n in (97, 1000, 20000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids(vocab.encode(text)) == library.encode_ordinary(text)


def test_documents(docs, rows, library):
    got = {r.doc_id: (r.n_tokens, ids(r.ids)) for r in bpetree.encode(docs).collect()}
    want = {i: library.encode_ordinary(t or "") for i, t in rows}
    assert got == {i: (len(w), w) for i, w in want.items()}
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpetree.decode(bpetree.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_empty_table(spark):
    assert bpetree.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
