import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sillage.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def gapless(rows, capacity):
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_pieces_and_sequences(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    gapless(rows, 1024)
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == d["doc_id"]), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


@pytest.mark.parametrize("text", ["", " ", "It's we'll  \n\n x", "\u00a0é👍🏽 123abc", "<|endoftext|>", "a <|endoftext|>b<|endoftext|", "a" * 5000, " " * 3000, "\x00\x1f"])
def test_ids_are_the_tokenizers(tokenizer, text):
    got = np.frombuffer(packing.encoder(packing.vocabulary_path())(text), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_is_best_fit():
    r = random.Random(1)
    lengths = [r.randrange(1, 50) for _ in range(300)]
    bins, at = packing.best_fit(lengths, 50)
    fill, want = [], [0] * 300
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fits = [b for b in range(len(fill)) if 50 - fill[b] >= lengths[i]]
        if not fits:
            fill.append(0)
        want[i] = max(fits, key=lambda b: fill[b]) if fits else len(fill) - 1
        fill[want[i]] += lengths[i]
    assert max(bins) + 1 == len(fill)


def test_tree_of_groups(spark):
    r = random.Random(2)
    items = [(i, r.choice([r.randrange(1, 1025), 600, 1024])) for i in range(3000)]
    df = spark.createDataFrame(items, "item long, length long")
    out = packing.pack(df, group=100, fan_in=3).join(df, "item").collect()
    assert len(out) == 3000
    gapless(out, 1024)
    one = packing.pack(df, group=10_000).select("sequence_id").distinct().count()
    assert len({r["sequence_id"] for r in out}) <= 1.05 * one


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "x"), (3, "y"), (3, "y"), (4, "z " * 5000)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gapless(out, 1024)
    assert [r["length"] for r in out if r["doc_id"] in (1, 2)] == [1, 1]
    assert sum(r["doc_id"] == 3 for r in out) == 2 and any(r["doc_id"] is None for r in out)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "CLIMB", 20)
    r = random.Random(4)
    largest, rounds = [], packing._round

    def watched(items, capacity):
        largest.append(items.groupBy("grp").count().agg({"count": "max"}).first()[0] or 0)
        return rounds(items, capacity)

    monkeypatch.setattr(packing, "_round", watched)
    for n in (2_000, 4_000, 8_000):
        items = [(i, r.choice([r.randrange(1, 1025), 560, 700])) for i in range(n)]
        df = spark.createDataFrame(items, "item long, length long")
        largest.clear()
        out = packing.pack(df, group=250, fan_in=4).join(df, "item").collect()
        gapless(out, 1024)
        assert len(out) == n and max(largest[1:]) <= 4 * 20
        few = packing.pack(df, group=100_000).select("sequence_id").distinct().count()
        assert len({x["sequence_id"] for x in out}) <= 1.02 * few
