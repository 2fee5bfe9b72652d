import random
import re
from collections import Counter

import numpy as np

from sillage.llm import phrases
from sillage.llm.queries import ORACLES, QUERIES
from tests.oracle import same

SCHEMA = "doc_id bigint, lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    good = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, w), a in good.items():
        if any(lang == x and len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in good.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_automaton_counts_all_strings():
    r = np.random.default_rng(1)
    numbers = r.integers(-1, 3, 500)
    want = Counter()
    for d in range(1, 5):
        for i in range(len(numbers) - d + 1):
            if (numbers[i : i + d] >= 0).all():
                want[tuple(numbers[i : i + d].tolist())] += 1
    got = {tuple(p): int(n) for _, ps, ns in phrases.automaton(numbers, 4) for p, n in zip(ps.tolist(), ns)}
    assert got == want


def test_against_plain(spark):
    r = random.Random(3)
    words = ["A", "b", "C", "dé", "É", "x\x00y", "new", "york", "city"]
    rows = [
        (i, r.choice(["en", "de", None, "und"]), r.choice([" ", "\t", "  "]).join(r.choice([*words, "new york", "new york city", "b. ", ",", "\x0bq", "x;y"]) for _ in range(r.randrange(40))))
        for i in range(300)
    ]
    rows += [(7, "en", None), (7, None, ""), (7, "en", " .\n"), (8, "en", "one " * 5000), (8, "en", "one " * 5000), (9, "de", "z" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS phrase", "2 AS f").repartition(5)
    texts = [x[1:] for x in rows]
    want = plain(texts, 30, 2000)
    assert len(want) > 30 and found(phrases.top_phrases(df)) == want
    assert found(phrases.top_phrases(df, least=5, top=7)) == plain(texts, 5, 7)


def test_few_bits_and_small_shards(spark):
    """Phrases that share a bit, and shards of a few texts, change nothing."""
    r = random.Random(4)
    rows = [(i, "en", " ".join(r.choice("abcdefgh") for _ in range(50))) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = found(phrases.top_phrases(df, least=8))
    assert found(phrases.top_phrases(df, least=8, bits=64)) == want == plain([x[1:] for x in rows], 8, 2000)


def test_shard_sizes():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["en"] * 10), pa.array(["a b"] * 10)], names=["lang", "text"])
    was, phrases.SHARD = phrases.SHARD, 1
    try:
        shards = list(phrases._shards(iter([b, b])))
    finally:
        phrases.SHARD = was
    assert len(shards) == 7 and sum((s.numbers >= 0).sum() for s in shards) == 40


def test_empty(spark):
    assert phrases.top_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.top_phrases(spark.createDataFrame([(1, None, None), (None, "en", "a b")], SCHEMA)).count() == 0


def test_oracle(spark):
    same(spark, "/root/testdata/sf0.01", QUERIES["op11_phrase_mining"], ORACLES["op11_phrase_mining"])
