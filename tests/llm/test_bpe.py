import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import bpe

PATH = bpe.rank_file()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def other():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={})


def test_random_letters_need_repair(other):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90)) for _ in range(400)]
    assert bpe.encode_texts(texts, PATH) == [other.encode_ordinary(t) for t in texts]
    enc = bpe.encoder(PATH)
    assert any(enc.greedy(t.encode()) != enc.merge(t.encode()) for t in texts)  # the guess alone would be wrong


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = test_any_text.__dict__.setdefault("enc", tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={}))
    assert bpe.encode_texts(texts, PATH) == [other.encode_ordinary(t) for t in texts]


def test_long_words_and_small_cache(other, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    texts = ["a" * 3000 + "b", " " * 900, "x" * 2000, "aB" * 700, "<|endoftext|> é", "", "word " * 3000]
    assert [bpe.encode_texts([t], PATH)[0] for t in texts] == [other.encode_ordinary(t) for t in texts]


def test_rows(spark, other):
    rows = [(1, "Hello world", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (1, "Hello world", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in bpe.encode(df).collect()))
    hello = other.encode_ordinary("Hello world")
    assert got == [(0, other.encode_ordinary("x")), (1, hello), (1, hello), (2, []), (3, [])]
    assert sorted((r.doc_id or 0, r.tokens) for r in bpe.count_tokens(df).collect()) == [(k, len(v)) for k, v in got]
    assert bpe.encode(df.limit(0)).collect() == []
