import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loregraph.llm import segment_bpe as bpe

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.coder(PATH, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_library(both, text):
    own, other = both
    ids = own.encode(text)
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_and_short_pieces_agree(both):
    own, other = both
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcstheing é!!") for _ in range(n)).encode() for n in [1, 2, 3, 17, 127, 128, 129, 400, 5000]]
    assert own.encode_pieces(pieces) == [own.encode_piece(p) for p in pieces]
    assert own.encode("a" * 20_000) == other.encode_ordinary("a" * 20_000)


def test_memory_is_bounded(both, monkeypatch):
    own, other = both
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for i in range(30):
        own.learn({f"w{i}x{k}" for k in range(9)})
    assert len(own.memory) <= 50
    text = " ".join(f"w{i}" for i in range(300))
    ids = other.encode_ordinary(text)
    assert own.digests(text, None)[0] == len(ids)


def test_documents(spark, odd_docs, no_docs, both, monkeypatch):
    rows = bpe.encode_documents(odd_docs, PATH, PATTERN).collect()
    want = []
    for d in odd_docs.collect():
        ids = both[1].encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert sorted(map(str, rows)) == sorted(str(type(rows[0])(*w)) for w in want) or sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(no_docs, PATH, PATTERN).collect() == []
    back = bpe.decoded_documents(bpe.tokenized_documents(odd_docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(d.doc_id), (d.text or "").encode()) for d in odd_docs.collect())
