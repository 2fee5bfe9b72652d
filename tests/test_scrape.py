import numpy as np
from pyspark.sql import functions as F

from sillage import schema
from sillage.operators import cluster, crawl, scrape
from sillage.sources import io

def now():
    return F.lit("2026-01-01").cast("timestamp")


def test_selectors():
    own = {"product": {"name": [".n"]}, "category": {"name": [".c"]}, "fallback": {"name": ["h1"]}}
    assert scrape.selectors("product", "name", own) == {"primary": [".n"], "fallback": ["h1"]}
    assert scrape.selectors("category", "name", own) == {"primary": [".c"], "fallback": []}
    assert scrape.selectors("review", "none", own) == {"primary": [], "fallback": []}


def test_products(spark):
    full = """<link rel='canonical' href='/c'><h1>Eau</h1><p class=brand>Maison X</p><b class=price>1.234,50 €</b>
        <div class=breadcrumb><a>Parfum</a><a>Sale</a></div><i class=badge>Refill</i>"""
    rows = [(1, "https://a.example/product/P7?x", full), (2, "https://a.example/x", full), (3, "https://a.example/product/P8", "<h1>Eau</h1>"), (4, None, None), (5, "", "")]
    out = scrape.scrape_products(spark.createDataFrame(rows, "page_id long, url string, html string"), "s", now(), ("parfum",)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["product_id"], r["brand"], r["price_value"], r["price_currency"], r["canonical_url"]) == ("P7", "X", 1234.5, "EUR", "https://a.example/c")
    assert r["refillable_flag"] and r["refill_evidence"] == ["badge"] and len(r["category_path"]) == 1 and r["source_site"] == "a.example"


def test_reviews(spark):
    one = "<div class=review><i class=review-id>{}</i><b class=rating>{}/5</b><p>{}</p></div>"
    text = "Une ligne de texte"
    html = one.format("a", 4, text) + one.format("a", 5, text) + one.format("", 3, text) + one.format("b", 9, text) + one.format("c", 3, "short")
    rows = [(1, "https://a.example/p", html), (2, "u", None), (3, "v", "<p>none</p>")]
    out = scrape.scrape_reviews(spark.createDataFrame(rows, "product_id long, url string, html string"), "s", now()).collect()
    assert sorted((r["review_id"], r["rating"], str(r["review_date"])) for r in out) == [("1_review_2", 3, "2026-01-01"), ("a", 4, "2026-01-01")]


def test_violations(spark):
    good = {"review_id": "r", "product_id": "p", "site": "s", "url": "https://a.example/x", "rating": 5, "body": "", "language": "fr", "review_date": "2025-01-01", "scrape_ts": "2025-01-01 00:00:00"}
    cases = [({}, []), ({"rating": 0}, ["rating: out of range"]), ({"rating": None}, ["rating: required"]), ({"url": "a.example"}, ["url: no address"]), ({"url": "HTTP://a"}, []),
             ({"language": "de"}, ["language: not allowed"]), ({"review_date": "never"}, ["review_date: required"])]
    ddl = "review_id string, product_id string, site string, url string, rating int, body string, language string, review_date string, scrape_ts string, n int"
    df = spark.createDataFrame([tuple((good | c | {"n": i}).values()) for i, (c, _) in enumerate(cases)], ddl).repartition(1).sortWithinPartitions("n")
    out = schema.validate(df, "review", {"language": schema.LANGUAGES}).collect()
    assert [r["errors"] for r in out] == [e for _, e in cases]
    assert schema.validate(df.limit(0), "review", {}).count() == 0


def test_discovery_ends_without_new_links(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "y"), ("a", 2, "z"), ("a", 3, "x"), ("a", 4, "w"), ("b", 2, "x"), ("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z")]
    out = crawl.discovered(spark.createDataFrame(rows, "listing string, page_no int, link string"), 2).collect()
    assert sorted(map(tuple, out)) == [("a", "x", 1), ("a", "y", 1), ("a", "z", 2), ("c", "x", 1), ("c", "y", 2)]


def test_crawl_checks_the_number_between_starts(spark):
    starts = spark.createDataFrame([("s", i, f"start{i}") for i in range(4)], "site string, start_no int, url string")
    links = spark.createDataFrame([(f"start{i}", k, f"p{i * 4 + k}") for i in range(4) for k in range(7)], "url string, link_no int, link string")
    landed = spark.createDataFrame([(f"start{i}",) for i in (0, 1, 3)] + [(f"p{k}",) for k in range(40) if k != 1], "url string")
    out = [r["url"] for r in sorted(crawl.crawl_plan(starts, links, landed, 8).collect(), key=lambda r: r["visit"])]
    assert out == ["start0", "p0", "p2", "p3", "p4", "start1", "p5", "p6", "p7", "p8"]
    assert crawl.crawl_plan(starts, links, landed, 5).count() == 5


def test_mini_batches_find_the_clusters(spark):
    r = np.random.default_rng(2)
    centres = np.array([[0.0, 0], [20, 0], [0, 20]])
    rows = [(i, [float(v) for v in centres[i % 3] + r.standard_normal(2)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "product_id long, x array<double>")
    out = {r["product_id"]: (r["cluster"], r["distance"]) for r in cluster.mini_batch(df, 3, batch=60, rounds=20).collect()}
    assert len({(i % 3, c) for i, (c, _) in out.items()}) == 3 and max(d for _, d in out.values()) < 6
    assert cluster.mini_batch(df.limit(0), 3).count() == 0
    assert cluster.mini_batch(df.limit(1), 3).first()["cluster"] == 0


def test_expired_files_go(spark, tmp_path):
    for name in ("a b.txt", "c.txt"):
        (tmp_path / name).write_text("x")
    assert io.remove_expired(spark, str(tmp_path), "2000-01-01", 3) == 0
    assert io.remove_expired(spark, str(tmp_path), "2999-01-01", 3) == 2
    assert not list(tmp_path.glob("*.txt"))


def test_category_pages(spark):
    page = (
        '<div class="product-card"><a class="product-link" href="/p/1">One</a></div><div class="product-card">none</div>'
        '<div class="product-card"><b>x</b><a class="product-link" href="p/2?a=1"> Two  it </a></div><a class="next" href="?page=2">more</a>'
    )
    pages = spark.createDataFrame([(1, "https://h.example/c/", page), (2, "https://h.example/d", None), (3, None, page)], "page_id long, url string, html string")
    rows = sorted(tuple(r) for r in scrape.scrape_categories(pages).collect())
    assert rows[:2] == [
        (1, 0, "https://h.example/p/1", "One", "https://h.example/c/?page=2"), (1, 2, "https://h.example/c/p/2?a=1", "Two it", "https://h.example/c/?page=2"),
    ]
    assert [r[:3] for r in rows[2:]] == [(3, 0, "/p/1"), (3, 2, "p/2?a=1")]
