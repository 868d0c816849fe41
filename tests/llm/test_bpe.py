import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from peopleweave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.TextCodec(PATH, P.PATTERN)
ODD = ["", "a" * 5003, "ab" * 777, "aaab" * 500, "\n" * 999, " " * 1234, "é" * 501, "漢字" * 300, "a\n  b", "a \n b", " \n ", "x  ", "x \n", "don't we'll'll", "\x1c \x1c a", "1 22 ²½", "  a", "the the, the.the"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_random_texts():
    random.seed(1)
    letters = "ab e's  \n\t\x85\xa0　'lé漢字ñ12²½١😀.,!a̐ა\x1c​"
    for _ in range(2000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 9), st.data())
def test_join_is_associative_encoding(data, leaf, draw):
    codec = bpe.TreeCodec(RANKS, leaf)
    whole = codec._merge_long(data) if data else []
    cut = draw.draw(st.integers(0, len(data)))
    left, right = data[:cut], data[cut:]
    if left and right:
        assert codec.join(codec._tree(left), codec._tree(right)) == whole
    assert (codec._tree(data) if data else []) == whole and codec.decode(whole) == data


def test_small_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 7)
    codec, text = bpe.TextCodec(PATH, P.PATTERN), "one two three, four five. six seven eight nine ten eleven two three twelve " * 20
    assert codec.encode(text) == LIBRARY.encode_ordinary(text)


def test_operators(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (3, "same", "x"), (3, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH)
    got = sorted(((r.doc_id, r.text, list(r.ids), bytes(r.decoded)) for r in back.collect()), key=repr)
    assert got == sorted(((i, t, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=repr)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = sorted(tuple(r) for r in bpe.round_trip(docs.filter("doc_id IS NOT NULL"), PATH, P.PATTERN, keep=["doc_id"]).collect())
    want = sorted((i, len(e := LIBRARY.encode_ordinary(t)), sha(",".join(map(str, e)).encode()), sha(t.encode())) for i, t, _ in rows if i is not None)
    assert digests == want
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []
