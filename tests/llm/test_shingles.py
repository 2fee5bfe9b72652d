import random
import re

import numpy as np
import pytest

from sillage.llm import shingles

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def result(spark, rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}


def sets(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    found = [(d, sets(t)) for d, t in rows]
    comp = {d: d for d, _ in found}
    links = [(a, b) for i, (a, x) in enumerate(found) for b, y in found[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in found:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: (len(x), comp[d]) for d, x in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, d = [], 0
    passage = [r.choice(words) for _ in range(30)]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([1, 3, 5, 8, 9, 10, 14, 30, 60, 120, 400]))] + (passage if r.random() < 0.4 else [])
        for _ in range(r.randrange(1, 6)):
            text = list(base)
            for _ in range(r.choice([0, 1, 1, 2, len(base) // 40, len(base) // 20])):
                text[r.randrange(len(text))] = r.choice(words)
            if r.random() < 0.3:
                text += r.choices(words, k=r.randrange(1, 4))
            rows.append((d, r.choice([" ", "\n", " \t"]).join(text).upper() if r.random() < 0.5 else " ".join(text)))
            d += 1
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    assert result(spark, rows) == want


def test_every_linked_pair_shares_a_signature():
    r = random.Random(9)
    for _ in range(300):
        n = r.choice([4, 5, 6, 9, 13, 20, 30, 64, 65, 100, 300])
        x = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        gone = r.randrange(0, n // 4 + 1)
        y = np.unique(np.concatenate([x[gone:], np.array([r.getrandbits(64) for _ in range(r.randrange(0, n // 4 + 1))], np.uint64)]))
        both = len(np.intersect1d(x, y))
        common = x[:: r.choice([1, 2, 5])] if r.random() < 0.5 else x[:0]
        if 100 * both >= 80 * (len(x) + len(y) - both) and (gone or len(y) != len(x)):
            assert len(np.intersect1d(shingles.signatures(x, common), shingles.signatures(y, common)))


def test_bands_cover_linked_sizes():
    for s in range(4, 3000):
        for t in (s, s + 1, s * 5 // 4):
            assert set(shingles.bands(s)) & set(shingles.bands(t)) or 100 * s < 80 * t


def test_word_hashes():
    text = "Ab  cd\u00a0e\tÀb ab\x0bAB"
    h = shingles.word_hashes(text.encode())
    assert len(h) == len(WORD.findall(text)) and h[0] == h[3] == h[4] and len(set(h.tolist())) == 3
    long = ("x" * (shingles.BLOCK + 5) + " y ").encode()
    assert len(shingles.word_hashes(long)) == 2
    many = ("ab " * 600_000).encode()
    assert len(set(shingles.word_hashes(many).tolist())) == 1


def test_edges(spark):
    assert result(spark, []) == {}
    same = " ".join(f"v{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (9, same), (4, same.upper()), (5, same), (5, same), (7, "one two"), (8, "ONE  two"), (6, "one")]
    got = result(spark, rows)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[9] == got[4] == got[5] == (46, 4)
    assert got[7] == got[8] == (1, 7) and got[6] == (1, 6)


def test_null_id(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (2, "a b c d e f g")]
    assert result(spark, rows) == {None: (3, None), 3: (3, 2), 2: (3, 2)}


def test_all_texts_of_a_repeated_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, "less " + b), (4, b.upper()), (7, "something else")]
    got = result(spark, rows)
    assert {d: c for d, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7}


def test_many_equal_and_empty_texts_emit_once(spark, monkeypatch):
    same = " ".join(f"v{i}" for i in range(40))
    rows = [(i, None) for i in range(300)] + [(1000 + i, " \n") for i in range(300)] + [(2000 + i, same) for i in range(300)]
    emitted = []
    made = shingles._met
    monkeypatch.setattr(shingles, "_met", lambda *a: (emitted.append(a[0].count()), made(*a))[1])
    got = result(spark, rows)
    assert emitted == [1]
    assert all(got[d] == (36, 2000) for d, t in rows if t == same)
    assert all(got[d] == (0, d) for d, t in rows if t != same)


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}x{i // 5000}" for i in range(40_000))
    near = long.replace("w77x", "other")
    df = spark.createDataFrame([(5, long, "k", 1, 2), (4, near, "l", 3, 4)], "doc_id long, text string, key string, id int, n int")
    out = sorted((r["doc_id"], r["component_id"]) for r in shingles.jaccard_components(df).collect())
    assert out == [(4, 4), (5, 4)]


def test_hot_signatures_are_dealt_by_their_count(spark, monkeypatch):
    """Near copies of one text share signatures; dealt out by salts they have the same links."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(300)] + [(1000, " ".join(base)), (1001, "a b c d e f g h")]
    want = result(spark, rows)
    assert {c for _, c in want.values()} == {0, 1001}
    monkeypatch.setattr(shingles, "HOT", 8)
    assert result(spark, rows) == want
