import random

import xxhash
from pyspark.sql import functions as F

from sillage.llm import lines

SCHEMA = "doc_id long, text string"


def kept(spark, rows):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def plain(line):
    return " ".join(x for x in line.lower().replace("\t", " ").split(" ") if x)


def simhash(line):
    words = [w for w in line.split(" ") if len(w) >= lines.LETTERS] or line.split(" ")
    hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    first, order = {}, sorted((d, k, plain(line)) for d, t in rows for k, line in enumerate(t.split("\n")))
    for d, k, line in order:
        if line:
            first.setdefault(line, (d, k))
    found = list(first)
    root = {x: x for x in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(found):
        for b in found[:i]:
            x, y = a.split(" "), b.split(" ")
            if (simhash(a) ^ simhash(b)).bit_count() <= lines.DISTANCE and 100 * edits(x, y) <= (100 - lines.SIMILARITY) * max(len(x), len(y)):
                root[top(a)] = top(b)
    keep = {}
    for x in found:
        keep[top(x)] = min(keep.get(top(x), first[x]), first[x])
    stay = set(keep.values())
    return {d: "\n".join(line for k, line in enumerate(t.split("\n")) if not plain(line) or (d, k) in stay) for d, t in rows}


def test_against_brute_force(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([3, 12, 60, 150, 400]))) for _ in range(40)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(r.randrange(1, 6)):
            line = r.choice(base).split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                line[r.randrange(len(line))] = r.choice(words)
            text.append((" " if r.random() < 0.1 else "") + ("  ".join(line) if r.random() < 0.1 else " ".join(line)).title())
        rows.append((d, "\n".join(text)))
    got = kept(spark, rows)
    want = brute(rows)
    assert {d: t for d, (t, _, _) in got.items()} == want
    assert sum(t.count("\n") for t in want.values()) < sum(t.count("\n") for _, t in rows)


def test_more_tables_find_the_same(spark, monkeypatch):
    rows = [(d, "\n".join(f"line number {k % 7} of the common kind with word{d % 3} and some {'long ' * 90}tail" for k in range(4))) for d in range(12)]
    one = kept(spark, rows)
    monkeypatch.setattr(lines, "BLOCKS", ((1, 4, 1), (1 << 62, 5, 2)))
    assert kept(spark, rows) == one


def test_edges(spark):
    assert kept(spark, []) == {}
    rows = [(1, None), (2, ""), (3, "a\n\nA \na"), (4, "a"), (None, "zz top\nzz top"), (5, "\n \n"), (6, "une ligne " * 20_000)]
    got = kept(spark, rows)
    assert got[1] == (None, 0, 0)
    assert got[2] == ("", 1, 1)
    assert got[3] == ("a\n", 4, 2)
    assert got[4] == ("", 1, 0)
    assert got[None] == ("zz top", 2, 1)
    assert got[5] == ("\n \n", 3, 3)
    assert got[6][1:] == (1, 1)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x y z", 7, "k"), (1, "x y z", 8, "l")], "doc_id long, text string, n_lines int, id string")
    out = lines.dedup_lines(df).orderBy("id").collect()
    assert [(r["text"], r["n_lines"], r["id"]) for r in out] == [("x y z", 1, "k"), ("x y z", 1, "l")]


def test_repeated_rows_of_long_lines(spark):
    line = " ".join(f"worden{k}" for k in range(120))
    rows = [(1, line)] * 5 + [(2, line), (3, "another\n" + line)]
    out = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_kept"]) for r in out) == [(1, line, 1, 1)] * 5 + [(2, "", 1, 0), (3, "another", 2, 1)]


def test_edited_lines_are_found_by_their_edits_alone(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    base = [[r.choice(words) for _ in range(n)] for n in (5, 7, 9, 10, 14, 19, 20, 22, 24, 30, 45, 80, 130, 300) for _ in range(8)]
    rows = [(k, " ".join(line)) for k, line in enumerate(base)]
    for share in (0, 0.1, 0.2):  # one word, or so many of them
        for k, line in enumerate(base):
            line = list(line)
            for p in r.sample(range(len(line)), max(1, int(share * len(line)))):
                line[p] = r.choice(words)
            rows.append((len(rows), " ".join(line)))
    got = kept(spark, rows)
    assert all(got[k][2] == 1 for k in range(len(base)))
    lost = sum(got[k][2] for k in range(len(base), len(rows)))
    assert lost <= 0.02 * (len(rows) - len(base))


def test_no_python_in_the_plan(spark):
    out = lines.simhashes(spark.range(3).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.lit("a b c").alias("text")))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_unlike_lines_with_a_common_passage_are_told_apart_before_their_texts(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 9)))
    passage = [word() for _ in range(70)]
    base = [passage + [word() for _ in range(30)] for _ in range(80)]
    rows = [(k, " ".join(line)) for k, line in enumerate(base)]
    rows += [(100 + k, " ".join(line[:-1] + [word()])) for k, line in enumerate(base[:10])]
    seen, similar = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda pairs: seen.append(pairs.count()) or similar(pairs))
    for size in (64, 8):  # buckets compared whole, and by leaders
        monkeypatch.setattr(lines, "ALL", size, raising=False)
        seen.clear()
        got = kept(spark, rows)
        assert [k for k, x in got.items() if x[2] == 0] == list(range(100, 110))
        assert sum(seen) <= 1200  # of 4,005 pairs, all of which share the passage


def test_sets_of_one_simhash_are_dealt_by_finer_blocks(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, r.getrandbits(64) - (1 << 63)) for k in range(300)]
    rows += [(300 + k, v ^ sum(1 << b for b in r.sample(range(63), k % 4))) for k, v in rows]
    same = lambda a, b: F.lit(True)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= lines.CLOSE}
    monkeypatch.setattr(lines, "BLOCKS", ((1 << 10, 64, 1), (1 << 62, 6, 3)))  # one bit: all buckets are large
    pairs, rest = lines._blocks(spark.createDataFrame(rows, "id long, sim long"), len(rows), same)
    assert {tuple(x) for x in pairs.collect()} == want
    assert rest.count() == 0


def test_lines_of_one_simhash_are_held_against_leaders(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    rows = [(k, " ".join([word() for _ in range(30)] + ["is", "often"] * 300)) for k in range(60)]
    seen, similar = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda pairs: seen.append(pairs.count()) or similar(pairs))
    monkeypatch.setattr(lines, "HOT", 8)
    got = kept(spark, rows)
    assert [k for k, x in got.items() if x[2]] == [0]
    assert sum(seen) <= 600  # of 1,770 pairs


def test_short_words_tell_lines_of_a_large_bucket_apart(spark, monkeypatch):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = [word(9) for _ in range(60)]
    rows = [(k, " ".join([word(r.choice([3, 3, 6])) for _ in range(24)] + passage)) for k in range(60)]
    rows += [(100 + k, text + " more") for k, text in rows[:5]]
    seen, similar = [], lines.similar
    monkeypatch.setattr(lines, "similar", lambda pairs: seen.append(pairs.count()) or similar(pairs))
    monkeypatch.setattr(lines, "ALL", 8)
    got = kept(spark, rows)
    assert [k for k, x in got.items() if not x[2]] == list(range(100, 105))
    assert sum(seen) <= 600  # of 2,080 pairs, all of which share the passage
