import base64
import random

import pytest

from garimi.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "a", "가", "Hello  world\n\n", "성명: 김철수 (010-1234-5678)", "<|endoftext|> 글", "　｡ﾊﾞ𝒳😀‍👩", "don't we'll", "ÃÂ\x90", "x" * 3000, "ab" * 700 + "a", "​﻿", "\t\r\n "]


def ids(enc, text):
    import numpy as np

    return np.frombuffer(enc.encode(text), np.int32).tolist()


def test_equals_public_library(reference):
    enc = bpe.Encoder(PATH)
    r = random.Random(0)
    random_texts = ["".join(r.choice("aeiou 가나힣éß1-\n") for _ in range(r.randrange(200))) for _ in range(200)]
    for t in TEXTS + random_texts:
        assert ids(enc, t) == reference.encode_ordinary(t), t[:40]
        assert reference.decode(ids(enc, t)) == t


def test_equals_the_other_file_of_the_vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = bpe.Encoder(PATH)
    for text in TEXTS:
        assert ids(enc, text) == t.encode(text, add_special_tokens=False).ids


def test_ties_are_merged_from_the_left():
    rank = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301}
    assert bpe.encode_piece(b"aaaaa", rank) == [300, 301]  # (aa)(aa)a -> aa + aaa
    assert bpe.encode_piece(b"aaaa", rank) == [300, 300]


def test_bounded_store(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    enc = bpe.Encoder(PATH)
    for i in range(50):
        enc.encode(f"w{i} x{i}")
    assert len(enc.kept) <= 3


def test_documents(spark):
    df = spark.createDataFrame([(1, "가나다", 9), (2, None, 9), (3, "", 9), (1, "가나다", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df).collect())
    assert [d for d, _ in got] == [1, 1, 2, 3] and got[0] == got[1] and got[0][1] and got[2][1] == [] and got[3][1] == []
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.count_tokens(df).collect()) == [(1, len(got[0][1]))] * 2 + [(2, 0), (3, 0)]
    assert bpe.encode(df.filter("false")).count() == 0
