import random

import pytest
from pyspark.sql import functions as F

from sillage.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def poured(sizes, share=1.5, most=2.0):
    """Targets by handing out and cutting, again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        got = {s: most * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        more = {s for s in names if got[s] > most * sizes[s] and s not in full}
        if not more:
            return got
        full |= more


def test_targets_and_taken(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "d", "é", None]), " ".join(["w"] * r.choice([0, 1, 5, 40, r.randrange(300)]))) for i in range(2500)]
    out = mixing.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    source = {i: s for i, s, _ in rows}
    size = {i: len(t.split()) for i, _, t in rows}
    by: dict = {}
    for i, s in source.items():
        by[s] = by.get(s, 0) + size[i]
    want = poured(by)
    taken: dict = {}
    for x in out:
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == by[source[x["doc_id"]]]
        assert x["target"] == pytest.approx(want[source[x["doc_id"]]])
        assert x["taken"] in (0, x["size"], 2 * x["size"])
        taken[source[x["doc_id"]]] = taken.get(source[x["doc_id"]], 0) + x["taken"]
    assert len(out) == len(rows)
    assert all(taken[s] == pytest.approx(want[s], rel=0.02) for s in want)
    assert sorted(map(tuple, mixing.digest(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_tilt_meets_the_constraint(spark):
    pairs = spark.createDataFrame([("s", 1, 10), ("s", 50, 4), ("s", 200, 1)], "key string, size long, n long")
    goals = spark.createDataFrame([("s", 410, 410 / 15, t) for t in (100.0,)], "key string, source_size long, mean double, target double")
    t = mixing.tilts(pairs, goals).first()
    import math

    rate = lambda x: 2 / (1 + math.exp(-t["t"] * x / t["mean"]))
    assert 10 * rate(1) + 200 * rate(50) + 200 * rate(200) == pytest.approx(100.0, rel=1e-5)


def test_edges(spark):
    assert mixing.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = mixing.digest(spark.createDataFrame([(1, "a", None), (2, None, "")], SCHEMA)).collect()
    assert all((r["size"], r["target"], r["taken"]) == (0, 0.0, 0) for r in nothing)
    one = mixing.digest(spark.createDataFrame([(None, "a", "x y"), (5, "a", "z " * 100_000)], SCHEMA)).collect()
    assert {r["size"] for r in one} == {2, 100_000}


def test_copies_are_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * (i % 9 + 1), i) for i in range(200)], f"{SCHEMA}, size int").withColumn("rate", F.lit("r")).withColumn("key", F.lit(1))
    out = mixing.repeat_copies(df)
    assert out.columns == df.columns
    assert out.count() == mixing.mix(df).selectExpr("sum(copies)").first()[0]
    assert out.where("size <> doc_id or rate <> 'r'").count() == 0
    assert mixing.mix(df).columns == ["doc_id", "source", "text", "rate", "key", "size", "source_size", "target", "copies"]


def test_equal_rows_are_one_with_all_copies(spark):
    rows = [(i % 40, "ab"[i % 2], "w " * (i % 5 + 1), None) for i in range(200)] + [(1000 + i, None, "x y z", "n") for i in range(20)] + [(None, "a", None, "q")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, note string").repartition(3)
    out = mixing.repeat_copies(df)
    assert out.count() == mixing.mix(df).selectExpr("sum(copies)").first()[0]
    assert out.exceptAll(df.unionByName(df)).count() == 0 and out.where("text is null").count() == 0
