import random

from pyspark.sql import functions as F

from sillage.llm import dedup_links
from sillage.llm.common import components


def closed(edges):
    root: dict = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(7, 7)] + [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000, 1000 + i) for i in range(1, 80)]
    got = {x["id"]: x["comp"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == closed([(a, b) for a, b in edges if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_lose_no_link(spark):
    """Numbers that share a bucket link if they differ by 2 at most; hot buckets, leaders that link to few."""
    r = random.Random(2)
    members = sorted({(r.choice([0, 0, 0, r.randrange(9)]), r.randrange(150)) for _ in range(400)})
    df = spark.createDataFrame([(k, i, i) for k, i in members], "key long, id long, x long")
    near = lambda a, b: F.abs(a("x") - b("x")) <= 4
    verify = lambda pairs: pairs.where("abs(a - b) <= 2")
    leads = df.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("id") % 3 == 0, F.col("id"))), F.min("id")).alias("lead")).withColumn("lead_x", F.col("lead"))
    led = df.join(leads, "key")
    links = [(a, b) for k, a in members for m, b in members if k == m and a < b <= a + 2]
    for hot in (0, 20):
        out = dedup_links.linked(led, near, verify, lambda c: df.join(c, "id", "left").withColumn("comp", F.coalesce("comp", "id")), hot=hot)
        assert {x["id"]: x["comp"] for x in out.collect()} == closed(links)
