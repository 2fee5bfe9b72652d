import random

from pyspark.sql import functions as F

from sillage.operators import keywords


def test_hits_against_all_pairs(spark):
    r = random.Random(1)
    texts = [(i, r.choice([None, "", "ab", "".join(r.choice("abcé ") for _ in range(r.randrange(40)))])) for i in range(300)]
    words = [(r.choice([None, "", "a", "é ", "".join(r.choice("abcé") for _ in range(r.randrange(1, 6)))]), i) for i in range(80)]
    t, w = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(words, "word string, n int")
    want = sorted((i, word, n) for i, x in texts if x for word, n in words if word and word in x)
    for gram in (1, 2, 3, 4):
        assert sorted(map(tuple, keywords.hits(t, "id", "text", w, "word", gram).collect())) == want
    some = sorted({i for i, _, _ in want})
    assert sorted(q["id"] for q in keywords.containing(t, "id", "text", w, "word").collect()) == some
    assert keywords.hits(t, "id", "text", w.limit(0), "word").count() == 0 and keywords.hits(t.limit(0), "id", "text", w, "word").count() == 0


def test_many_keywords(spark):
    """100,000 keywords, by joins on grams alone."""
    words = spark.range(100_000).select(F.concat(F.lit("w"), F.hex(F.xxhash64("id"))).alias("word"), "id")
    texts = spark.range(0, 100_000, 97).select("id", F.concat(F.lit("some "), F.lit("w"), F.hex(F.xxhash64("id")), F.lit(" text")).alias("text"))
    found = keywords.hits(texts.withColumnRenamed("id", "k"), "k", "text", words, "word")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = found.collect()
    assert len(rows) == texts.count() and all(q["k"] == q["id"] for q in rows)


def test_texts_are_never_broadcast(spark, tmp_path):
    """Many texts in a small file: their grams must not go to the driver, whether keywords are few or not."""
    spark.range(2_000).select("id", F.lit("a red ring").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    words = spark.createDataFrame([("red",), ("ring",), ("rod",)], "word string")
    few, was = keywords.FEW, []
    try:
        for keywords.FEW in (few, 2):
            for found in (keywords.hits(texts, "id", "text", words, "word"), keywords.containing(texts, "id", "text", words, "word")):
                plan = found._jdf.queryExecution().executedPlan().toString()
                assert "BuildLeft" not in plan and ("BuildRight" in plan) == (keywords.FEW == few)
                was.append(found.count())
    finally:
        keywords.FEW = few
    assert was == [4_000, 2_000] * 2
