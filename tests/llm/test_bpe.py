import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sillage.llm import bpe
from sillage.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.file_path())
    t.no_truncation()
    t.no_padding()
    return t


def check(library, texts):
    ours = bpe.load(bpe.file_path()).both(texts)
    for t, (ids, decoded), e in zip(texts, ours, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t[:80]
        assert decoded == library.decode(e.ids, skip_special_tokens=False), t[:80]


def test_random_texts(library):
    r = random.Random(1)
    letters = "aaabcdeE'ſsŠΣσςİ éñ\t\n  ..!!12３é\x00 ﻿<|>漢字👍🏽"
    words = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "I'LL", "ΟΔΟΣ"]
    texts = ["".join(r.choice([*letters, r.choice(words)]) for _ in range(r.randrange(60))) for _ in range(3000)]
    check(library, [*texts, "", " \n", "<|endoftext|>", "a<|endoftext|>b"])


def test_long_words(library):
    """A word above LONG takes the heap, with the same ids."""
    r = random.Random(2)
    check(library, ["a" * 5000, "=" * 3001, "".join(r.choice("abcdefghijklm") for _ in range(20_000)), "".join(r.choice("the in an") for _ in range(9000)), "x" * 511, "x" * 512])


def test_letters_of_all_tables(library):
    """Every third code point: letters that are newer than this Python's tables too."""
    check(library, [f"a{chr(c)}B" for c in range(0, 0x110000, 3) if not 0xD800 <= c < 0xE000])


def test_forgets_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    check(library, ["one two <|endoftext|> three", "four"])
    for k in range(5):
        check(library, [" ".join(f"w{i}x{k}" for i in range(40)) + " <|startoftext|> one"])


def _want(library, text):
    e = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(e, skip_special_tokens=False)
    return len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], *_want(library, d["text"])) for d in docs)
    assert sorted(map(tuple, QUERIES["op12_bpe_encoding"](spark, sf_dir).collect())) == want


def test_edges(spark, library, monkeypatch):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "same"), (2, "same"), (3, "long word " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 AS ids", "'x' AS n_tokens", "'y' AS decoded")
    got = sorted(map(tuple, bpe.digests(df).collect()), key=repr)
    assert got == sorted(((d, *_want(library, t)) for d, t in rows), key=repr)
    full = bpe.encode(df.where("doc_id = 2")).collect()
    assert [(r["ids"], r["decoded"], r["n_tokens"]) for r in full] == [(library.encode("same", add_special_tokens=False).ids, "same</w>", "x")] * 2
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(none).count() == 0 and bpe.encode(none).count() == 0


def test_decode():
    b = bpe.load(bpe.file_path())
    assert b.decode(b.encode_batch(["Low word"])[0].tolist()) == "low</w> word</w>" and b.decode([10**9]) == ""
