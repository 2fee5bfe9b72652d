import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sillage.llm import urls


def judged(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "page_id long, url string")
    return {r["page_id"]: r for r in urls.judge(df).collect()}


def test_rules(spark):
    values = [
        "https://A.Example.ORG/es/1", "http://example.org/en/12?x", "http://example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/a#b",
        "http://x.com/de/", "http://com.evil.net/de/", None, "no scheme", "http://org", "ftp://u.org/?q=a", "x://y.com://z/de/",
    ]
    got = judged(spark, values)
    want = ["example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None, None, None, "org/", None]
    assert [got[i]["rule"] for i in range(len(values))] == want
    assert got[0]["host"] == "a.example.org" and got[0]["path"] == "/es/1" and got[1]["path"] == "/en/12"
    assert (got[7]["host"], got[7]["path"]) == (got[8]["host"], got[8]["path"]) == ("", "")
    assert [got[i]["verdict"] for i in (0, 1, 2, 4, 5)] == ["block", "block", "allow", "allow", "block"]


def test_trees_learn(spark):
    r = random.Random(4)
    rows = []
    for i in range(1500):
        bad = r.random() < 0.5
        x, z = r.gauss(1 if bad else -1, 1), r.random()
        rows.append((i, x, z, int(bad)))
    df = spark.createDataFrame(rows, "order long, a double, b double, y int")
    model = urls.fit(df.where("order < 1000"), ["a", "b"], trees=6)
    test = df.where("order >= 1000").select("y", (model.score({"a": F.col("a"), "b": F.col("b")}) > 0).cast("int").alias("p"))
    assert test.where("y = p").count() / test.count() > 0.8
    assert model.trees[0][0] == "a"


def test_one_class(spark):
    got = judged(spark, ["http://a.org/x", "http://b.net/x"])
    assert got[1]["verdict"] == "allow"
    assert judged(spark, []) == {}


def plain_features(url):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url)
    n, low = max(1, len(url)), url.lower()
    return host, path, {
        "length": len(url), "host_length": len(host), "path_length": len(path), "depth": sum(x != "" for x in path.split("/")),
        "labels": len(host.split(".")), "digit_ratio": sum(c in "0123456789" for c in url) / n,
        "symbol_ratio": sum(not re.match("[a-zA-Z0-9]", c) for c in url) / n, "hyphens": host.count("-"),
        "entropy": -sum(k / n * math.log2(k / n) for k in collections.Counter(low).values()),
        "params": len(query[1].split("&")) if query and query[1] else 0,
        "page_suffix": len((re.search(r"\.([a-zA-Z0-9]+)$", path) or ["", ""])[1]), "https": int(low.startswith("https:")),
        "suffix_length": len(host.rpartition(".")[2]),
    }


def test_features_against_plain_python(spark):
    values = ["https://A.b-c.Example.ORG/es/1/x.html?a=1&b=2#f", "http://h", "", None, "x://y?z", "http://a.b/" + "p/" * 50_000 + "end.php?" + "q=1&" * 999]
    df = spark.createDataFrame(list(enumerate(values)), "i int, url string")
    host, path = urls.host_path(F.col("url"))
    rows = df.select("i", host.alias("host"), path.alias("path"), *[c.alias(k) for k, c in urls.features(F.col("url"), host, path).items()]).collect()
    for r in rows:
        h, p, want = plain_features(values[r["i"]])
        assert (r["host"], r["path"]) == (h, p)
        assert {k: r[k] for k in want} == pytest.approx(want)


def test_scores_and_left_out_urls(spark):
    """Blocked hosts are long and full of digits; the score is the base and the leaves that a plain walk reaches."""
    r = random.Random(8)
    rows = []
    for i in range(600):
        bad = r.random() < 0.5
        name = "".join(r.choice("abcdefgh" + "0123456789" * bad) for _ in range(r.randrange(14, 25) if bad else r.randrange(4, 15)))
        rows.append((i, f"http://{name}.{r.choice(['xyz', 'top'] if bad else ['fr', 'de'])}/{name[:3]}", int(bad)))
    df = spark.createDataFrame(rows, "i int, url string, y int")
    host, path = urls.host_path(F.col("url"))
    df = df.select("i", "y", *[c.alias(k) for k, c in urls.features(F.col("url"), host, path).items()])
    names = [c for c in df.columns if c not in ("i", "y")]
    model = urls.fit(df.where("i < 400"), names)
    out = df.withColumn("score", model.score({k: F.col(k) for k in names})).where("i >= 400").collect()

    def walk(t, row):
        return t if not isinstance(t, tuple) else walk(t[2] if row[t[0]] <= t[1] else t[3], row)

    assert all(abs(x["score"] - model.base - sum(walk(t, x) for t in model.trees)) < 1e-9 for x in out)
    assert sum((x["score"] > 0) == bool(x["y"]) for x in out) >= 0.9 * len(out)


def test_no_python_in_the_plan_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "r", 1.0)] * 2, "page_id long, url string, rule string, length double")
    out = urls.judge(df)
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
    assert [tuple(x)[:5] for x in out.collect()] == [(1, "a.org", "/x", "org/", "allow")] * 2


def test_held_out_accuracy(spark):
    """Trees learnt on half of the URLs that rules decide, tried on the other half: well above the constant."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    whole, lexical = urls.described(pages)
    ruled = whole.where("rule is not null").withColumn("half", F.pmod(F.xxhash64("url", F.lit(9)), F.lit(2)))
    out = urls.learn(ruled.where("half = 0"), lexical)(ruled.where("half = 1")).select("said", (F.col("score") > 0).alias("p")).toPandas()
    bad, told = out["said"] == "block", out["p"]
    print("right", (bad == told).mean(), "constant", (~bad).mean(), "blocked found", (bad & told).sum() / bad.sum(), "false alarms", (~bad & told).sum(), len(out))
    assert (bad == told).mean() > 0.9 and (bad & told).sum() > 0.8 * bad.sum()


def test_a_label_does_not_tell_of_itself(spark):
    """Hosts that come once each, labelled at random: nothing can be learnt, and nothing seems to be."""
    r = random.Random(8)
    rows = [(i, f"http://h{i}.{'com' if r.random() < 0.9 else 'org'}/{r.choice(['de', 'fr'])}/{r.randrange(99)}") for i in range(600)]
    whole, lexical = urls.described(spark.createDataFrame(rows, "page_id long, url string"))
    said = {i: r.choice(["block", "allow"]) for i, _ in rows}
    labels = spark.createDataFrame(list(said.items()), "page_id long, told string")
    ruled = whole.join(labels, "page_id").withColumn("said", F.col("told"))
    scores = [x["score"] for x in urls.learn(ruled, lexical)(ruled).select("score").collect()]
    assert max(map(abs, scores)) < 1.5


def test_very_long_urls(spark):
    got = judged(spark, ["http://b.org/" + "é/x?" * 100_000, "http://" + "a." * 20_000 + "net", "http://c.com/de/1"])
    assert got[0]["rule"] == "org/" and got[1]["rule"] is None and len(got) == 3
