import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from peopleweave.llm import token_files as T

PATH = P.path("word_bpe_49k.json")


def ids_of(text):
    tok = Tokenizer.from_file(PATH)
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


TEXTS = [None, "", " ", "Hello, World's \n end.", "J̌ x́ İstanbul ΟΔΟΣ", "<|endoftext|> a", "hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|><|endoftext|>e\u0301", "<|ENDOFTEXT|> <|endoftext| >", "<|EndOfText|>", "漢字 かな　\xa0x\x1cy\x85z", "a" * 3000, "I'll 12345 we're", "naïve\tcafé… “q” ﬁ", "word " * 4000, "e ́b"]


@pytest.mark.parametrize("text", TEXTS)
def test_chunks_give_the_library_ids(text):
    codec = T.ChunkTokenizer(PATH)
    for _ in range(2):
        assert np.frombuffer(codec.encode((text or "").encode()), "<u2").tolist() + [2] == ids_of(text)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    monkeypatch.setattr(T, "PIECE_BYTES", 50)
    text = "Hello world, this is <|endoftext|>a longer text than fifty bytes, with e\u0301 <|startoftext|> and more of it. " * 30 + "x" * 200
    assert np.frombuffer(T.ChunkTokenizer(PATH).encode(text.encode()), "<u2").tolist() + [2] == ids_of(text)


def test_a_text_above_four_megabytes():
    text = "Some words <|endoftext|> and others, ordinary ones. " * 90_000
    assert len(text) > 4 << 20 and np.frombuffer(T.ChunkTokenizer(PATH).encode(text.encode()), "<u2").tolist() + [2] == ids_of(text)


def test_random_texts_give_the_library_ids():
    random.seed(3)
    codec, letters = T.ChunkTokenizer(PATH), "aAbTJ's.,!1 2 \n\t\x1c\x85\xa0　́̌èÉß漢😀-<|>"
    for _ in range(400):
        text = "".join(random.choice([*letters, "<|endoftext|>", "<|startoftext|>"]) for _ in range(random.randint(0, 40)))
        assert np.frombuffer(codec.encode(text.encode()), "<u2").tolist() + [2] == ids_of(text), repr(text)


def test_files_hold_all_documents_in_order(spark):
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", None), (7, "same", "x"), (7, "same", "x"), (-5, "first", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest, dictionary = T.write_token_files(docs, PATH, part_bytes=3000)
    assert manifest.count() > 2
    got = T.read_token_files(manifest, dictionary).collect()
    assert sorted(((r.doc_id, zlib.crc32(r.ids)) for r in got), key=repr) == sorted(((i, zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t, _ in rows), key=repr)
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id


def test_direct_access_and_wrong_dictionary(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 30) for i in range(300)], "doc_id long, text string")
    manifest, dictionary = T.write_token_files(docs, PATH)
    uri = manifest.first().uri
    file = T.TokenFile(uri, dictionary)
    assert len(file) == manifest.first().docs and file.document(len(file) - 1).tolist() == ids_of(f"text number {int(file.doc_id[-1])} " * 30)
    with pytest.raises(ValueError):
        T.TokenFile(uri, dictionary + b"x")


def test_no_documents(spark):
    manifest, dictionary = T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert T.read_token_files(manifest, dictionary).collect() == []


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_and_marks_cost_one_call_and_no_normalising():
    codec = T.ChunkTokenizer(PATH)
    codec.tokenizer = Counting(codec.tokenizer)
    text = " ".join(f"{w}{m}" for w in ("Straße", "the", "Éclair", "naïve", "WORD", "\xb5m", "xºª") for m in ("", ",", ".", "***", "!!'", "&&&", "</", "''"))
    assert np.frombuffer(codec.encode(text.encode()), "<u2").tolist() + [2] == ids_of(text)
    assert codec.tokenizer.texts == 0


@pytest.mark.parametrize("group, entries", [(1, 5), (60, 5), (60, 100), (1 << 20, 1000)])
def test_groups_of_texts_keep_ids_and_order(monkeypatch, group, entries):
    monkeypatch.setattr(T, "GROUP_BYTES", group)
    monkeypatch.setattr(T, "MEMO_ENTRIES", entries)
    random.seed(5)
    words = ["the", "The", "\xc9t\xe9", "\xe9t\xe9", "\u212a", "\u1e9e", "\u212b", "\u0178", "x2", "\xb2", "won't", "'s", "...", "</w>", "\xe9</w>", "a\u0301", "\x85", "\xa0b", "", "\u03a3\u03b1\u03c2", "\u6f22", "*&*", "w\0"]
    texts = [t or "" for t in TEXTS] + [" ".join(random.choice(words) + random.choice(["", ",", ".", "&&", "'", "'s", "́", "”"]) for _ in range(random.randint(0, 12))) for _ in range(150)]
    got = T.ChunkTokenizer(PATH).encode_all(t.encode() for t in texts)
    tok = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
