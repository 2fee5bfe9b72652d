import datetime

import pytest
from pyspark.sql import functions as F

from sillage.functions import robots, scalars


def value(spark, f, *args):
    cols = [F.lit(a) if not isinstance(a, list) else F.array(*map(F.lit, a)) for a in args]
    return spark.range(1).select(f(*cols).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("1.234,56 €", 1234.56), ("12,50 €", 12.5), ("99.90", 99.9), ("EUR 0", None), ("gratuit", None), ("1,234.56", 1.23456), (None, None)],
)
def test_price(spark, text, want):
    assert value(spark, scalars.price, text) == want


@pytest.mark.parametrize("text,want", [("4.5/5", 4.5), ("3 étoiles", 3.0), ("2 Stars", 2.0), ("7", None), ("9/10 ou 4/5", 4.0), ("", None)])
def test_rating(spark, text, want):
    assert value(spark, scalars.rating, text) == want


@pytest.mark.parametrize("text,want", [("100 ml", 100.0), ("50g", 50.0), ("7,5 ml", 5.0), ("30", 30.0), ("x", None), ("0 ml", None)])
def test_size(spark, text, want):
    assert value(spark, scalars.size, text) == want


@pytest.mark.parametrize(
    "text,want",
    [("15/01/2024", (2024, 1, 15)), ("2024-1-5", (2024, 1, 5)), ("5-1-2024", (2024, 1, 5)), ("January 15, 2024", (2024, 1, 15)),
     ("le 3/2/2023 !", (2023, 2, 3)), ("hier", None), ("32/01/2024", None), (" 7 March 2024 ", (2024, 3, 7)), ("7 Mars 2024", None),
     ("a/b 2024-02-05", (2024, 2, 5)), ("x-y 05-02-2024.", (2024, 2, 5)), ("2024-13-01", None), ("June 31, 2024", None), (None, None)],
)
def test_date(spark, text, want):
    assert value(spark, scalars.date, text) == (want and datetime.date(*want))


def test_brand_and_category(spark):
    assert value(spark, scalars.brand, " Parfums Christian Beauty ") == "Christian"
    assert value(spark, scalars.brand, None) == ""
    assert value(spark, scalars.category, " Soins Visage ") == "skincare face"


def test_verified_negation_first(spark):
    assert value(spark, scalars.verified, "Achat non vérifié") is False
    assert value(spark, scalars.verified, "Verified") is True
    assert value(spark, scalars.verified, "?") is None


def test_language(spark):
    assert value(spark, scalars.language, "les bonnes crèmes avec une texture") == "fr"
    assert value(spark, scalars.language, None) == "other"


def test_author_keeps_no_names(spark):
    assert value(spark, scalars.author_label, "Marie Dupont") is None
    assert value(spark, scalars.author_label, " Client vérifié ") == "Client vérifié"


def test_next_page(spark):
    assert value(spark, scalars.next_page, "https://x.example/a") == "https://x.example/a?page=2"
    assert value(spark, scalars.next_page, "https://x.example/a?q=1&page=3") == "https://x.example/a?q=1&page=4"
    assert value(spark, scalars.next_page, "https://x.example/a?page=10") is None


def test_refill_priority(spark):
    assert value(spark, scalars.refill_evidence, ["Bio"], ["REFILL"], "recharge") == "badge"
    assert value(spark, scalars.refill_evidence, ["Rechargeable"], ["x"], "") == "facet"


@pytest.mark.parametrize(
    "path,allow,disallow,want",
    [("/a/b", [], ["/a"], False), ("/a/b", [], ["/c"], True), ("/x", ["/a"], ["/b"], False), ("/a/9", ["/a"], ["/*/9"], False), ("/a", ["/a"], [""], True)],
)
def test_robots(spark, path, allow, disallow, want):
    cast = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert spark.range(1).select(robots.allowed(F.lit(path), cast(allow), cast(disallow)).alias("x")).first()["x"] is want


def test_required_is_truthiness(spark):
    row = spark.createDataFrame([(1, "s", "b", "", 0.0, 7.0)], "product_id int, site string, brand string, name string, price_value double, rating_avg double")
    assert row.select(scalars.product_errors().alias("e")).first()["e"] == [
        "Missing required field: name", "Missing required field: price_value", "Invalid price value", "Invalid rating average"]


def test_robots_agents_by_exact_name(spark):
    text = "User-agent: Googlebot\nDisallow: /private\nCrawl-delay: 9\nUser-agent: *\nAllow:\nCrawl-delay: 2\nCrawl-delay: x\nUser-agent: Bot\nDisallow: /b"
    r = robots.parse(spark.createDataFrame([("d", text)], "domain string, content string")).first()
    assert (r["allow"], r["disallow"], r["crawl_delay"]) == ([""], [], 2.0)
    allowed = robots.allowed(F.lit("/x"), F.array(F.lit("")), F.array().cast("array<string>"))
    assert spark.range(1).select(allowed.alias("x")).first()["x"] is False  # an empty rule is a rule that nothing meets


def test_product_id(spark):
    rows = [("https://s/product/P1?x", "z"), ("https://s/", " a-1 !é"), ("https://s/", ""), ("https://s/", None)]
    out = spark.createDataFrame(rows, "u string, f string").select(scalars.product_id(F.col("u"), F.col("f")).alias("x")).collect()
    assert [r["x"] for r in out] == ["P1", "a-1é", None, None]
