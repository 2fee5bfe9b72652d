import random

import pytest
from pyspark.sql import functions as F

from sillage.operators import eda, features, gates, pricing, ranks
from tests.oracle import rows

PS = (0, 1, 25, 50, 75, 90, 99, 100)


def same(df, by, **named):
    ours = ranks.percentiles(df, by, "v", PS, F.count(F.lit(1)).alias("n"), **named).toPandas()
    theirs = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in PS]).toPandas()
    assert list(ours.columns) == list(theirs.columns) and rows(ours) == rows(theirs)


@pytest.mark.parametrize("accuracy", [20, 500, 10_000])
def test_percentiles_of_groups(spark, accuracy):
    """Groups of one value to thousands, ties, nulls, null keys, a group without values."""
    r = random.Random(accuracy)
    data = [(g, None if g == 3 else f"k{g % 2}", r.choice([None, r.gauss(0, 1), float(r.randrange(5)), -2.0])) for g in range(8) for _ in range(4**g // 2 + 1)]
    data += [(9, "none", None)] * 3 + [(10, "one", 1.5), (11, "same", 7.0), (11, "same", 7.0)] + [(None, None, float(i)) for i in range(50)]
    df = spark.createDataFrame(data, "g int, k string, v double").repartition(7)
    same(df, ["g", "k"], accuracy=accuracy)
    same(df.limit(0), ["g", "k"], accuracy=accuracy)


def test_one_group_of_many_rows(spark):
    """10,000,000 distinct values of one group, in another order: the ranks are known."""
    n = 10_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.pmod(F.col("id") * 48_271, F.lit(n)) / 8).alias("v"))
    row = ranks.percentiles(df, ["g"], "v", PS, F.count(F.lit(1)).alias("n")).first()
    assert row["n"] == n and [row[f"p{p}"] for p in PS] == pytest.approx([p / 100 * (n - 1) / 8 for p in PS], rel=1e-12)


def test_no_task_holds_a_group(spark, sf_dir):
    from sillage.sources import views as v

    products = v.products(spark, sf_dir)
    for df in (eda.price_tiles(products), pricing.category_stats(products, "2024-01-01"), eda.category_array_stats(products), pricing.thresholds(products)):
        assert " percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()
    plan = gates.price_gaps(products)._jdf.queryExecution().sparkPlan().toString()
    window = plan[plan.index("Window") :]
    assert "_range" in window[:400]


def test_next_of_all(spark):
    r = random.Random(1)
    values = sorted({round(r.gauss(0, 100), 2) for _ in range(5000)})
    df = spark.createDataFrame([(x,) for x in r.sample(values, len(values))], "x double").repartition(6)
    want = dict(zip(values, [*values[1:], None]))
    for n in (2, 7, 64, 20_000):
        assert {q["x"]: q["to"] for q in ranks.with_next(df, "x", "to", n).collect()} == want
    some = spark.createDataFrame([(None,), (3.0,)], "x double")
    assert sorted(ranks.with_next(some, "x", "to").collect(), key=str) == sorted([(None, None), (3.0, None)], key=str)
    assert ranks.with_next(some.limit(0), "x", "to").count() == 0


def test_texts_are_streamed(spark):
    """Against texts joined whole: bigrams over seams, empty reviews between, reviews of one id."""
    texts = [
        (1, 5, "fr", "Crème, de nuit"), (1, 2, "fr", "the !!"), (1, 9, "fr", "parfum"), (1, 7, "en", "no"), (2, 1, "fr", None), (3, 1, "fr", "ΟΔΟΣ très"),
        (3, 1, "fr", "alpha beta"), (3, 3, "fr", "gamma"), (None, 4, "fr", "null produit"),
    ]
    df = spark.createDataFrame(texts, "product_id bigint, review_id bigint, language string, body string").repartition(3)
    found = {q["product_id"]: q["text"] for q in features.product_text(df).collect()}
    assert found == {1: "the    crème  de nuit parfum", 2: "", 3: "alpha beta οδος très gamma", None: "null produit"}
    counts = {(q["product_id"], q["term"]): q["n"] for q in features.terms(df).collect()}
    one = ["crème", "de", "nuit", "parfum", "crème de", "de nuit", "nuit parfum"]
    three = ["alpha", "beta", "οδος", "très", "gamma", "alpha beta", "beta οδος", "οδος très", "très gamma"]
    assert counts == {**{(1, t): 1 for t in one}, **{(3, t): 1 for t in three}, **{(None, t): 1 for t in ("null", "produit", "null produit")}}
    for out in (features.product_text(df), features.terms(df)):
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
