import json

import pytest
from pyspark.sql import functions as F

from sillage import cli, schema
from sillage.functions import html
from sillage.operators import crawl, gates
from sillage.sources import io


def test_conform_and_missing(spark, tmp_path):
    df = spark.createDataFrame([("r1", "Très bon parfum", 5, "7")], "review_id string, text string, rating long, helpful_votes string")
    out = schema.conform(df, schema.REVIEW)
    row = out.first()
    assert row["body"] == "Très bon parfum" and row["helpful_count"] == 7 and row["language"] is None
    assert io.load(spark, f"{tmp_path}/nothing.parquet", schema.PRODUCT).count() == 0


def test_combine_by_name(spark, tmp_path):
    spark.range(2).select(F.col("id").cast("string").alias("product_id"), F.lit("a").alias("site")).write.parquet(f"{tmp_path}/a_products.parquet")
    spark.range(3).select(F.col("id").cast("string").alias("product_id"), F.lit(1.5).alias("price_value")).write.parquet(f"{tmp_path}/b_products.parquet")
    out = io.combine(spark, str(tmp_path), "products", schema.PRODUCT)
    assert out.count() == 5 and out.where("site is null").count() == 3 and out.where("price_value = 1.5").count() == 3


def test_dimensions(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"tiers": {"1": ["A", "B", "A"], "1.5": ["B", "C"]}}))
    assert {(r["brand"], r["tier"]) for r in io.brand_tiers(spark, f"{tmp_path}/b.json").collect()} == {("A", "1"), ("B", "1"), ("C", "1.5")}
    (tmp_path / "c.json").write_text(json.dumps({"mappings": {"g": {"x": ["s", "t"]}}}))
    assert io.category_synonyms(spark, f"{tmp_path}/c.json").count() == 2


def test_sinks_and_status(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y"])], "id int, tags array<string>")
    io.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["tags"] == "x|y"
    io.write_parquet(df, f"{tmp_path}/t.parquet")
    assert io.stored_files(spark, str(tmp_path)).first()["parquet"] >= 1


def test_selectors(spark):
    page = "<div class='a b'><span>One</span><span data-x='q-1'>Two</span></div><a href='/p/1'>L</a><ul><li>x</li><li> </li><li>y</li></ul>"
    pages = spark.createDataFrame([(1, "https://h.example/c/", page), (2, "u", None)], "page_id long, url string, html string")
    out = html.extract(
        pages, {"t": [".zz", ".a span"], "u": ["[data-x*='q']"], "f": ["div span:first-child"]}, {"l": ["ol li", "ul li"]}, {"link": (["a"], "href")}
    )
    one, two = sorted(out.collect(), key=lambda r: r["page_id"])
    assert (one["t"], one["u"], one["f"], one["link"]) == ("One", "Two", "One", "https://h.example/p/1") and list(one["l"]) == ["x", "y"]
    assert two["t"] is None and list(two["l"]) == []


def test_page_patterns(spark):
    page = "<title> Eau </title> Prix: 1 234,56 € <i class='brand'>Chloé</i> Rechargeable <b class='rating'>4</b><b class='star'>9</b><a href=\"/product/1\">x</a>"
    pages = spark.createDataFrame([(1, "https://h.example/c/", page)], "page_id long, url string, html string")
    row = crawl.page_fields(pages).first()
    assert (row["name"], row["price_value"], row["brand"], row["refill_evidence"]) == ("Eau", 234.56, "Chloé", "recharge,rechargeable,rechargeable")
    assert [r["rating"] for r in crawl.page_ratings(pages).collect()] == [4]
    assert [r["link"] for r in crawl.page_links(pages).collect()] == ["https://h.example/product/1"]


def test_no_duplicates_is_no_violation(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "rating int, body string")
    row = gates.review_duplicates(texts).first()
    assert (row["duplicates"], row["percentage"], row["flagged"]) == (0, 0.0, False)


def test_cli(spark, sf_dir, tmp_path, capsys):
    assert cli.main(["list"]) == 0
    assert "luxury_classification" in capsys.readouterr().out
    bronze, silver = f"{tmp_path}/bronze", f"{tmp_path}/silver"
    spark.sql("SELECT 'p1' AS product_id, 'a' AS site, 5.0D AS price_value").write.parquet(f"{bronze}/a_products.parquet")
    spark.sql("SELECT 'p2' AS product_id, 'b' AS site").write.parquet(f"{bronze}/b_products.parquet")
    for _ in range(2):
        assert cli.main(["normalize", bronze, silver]) == 0
    out = spark.read.parquet(f"{silver}/products.parquet")
    assert sorted((r["product_id"], r["price_value"], r["site"]) for r in out.collect()) == [("p1", 5.0, "a"), ("p2", None, "b")]
    assert cli.main(["validate", sf_dir]) == 1 and "FAIL" in capsys.readouterr().out
    assert cli.main(["run", "price_gap_uniformity", sf_dir, "--out", f"{tmp_path}/gaps"]) == 0
    assert spark.read.parquet(f"{tmp_path}/gaps").count() == 1
    assert cli.main(["status", str(tmp_path)]) == 0 and "| parquet |" in capsys.readouterr().out


def _broken(df):
    """df whose rows fail as they are written."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.raise_error(F.lit("torn")).cast(t)).alias(c) if c != "day" else F.col(c) for c, t in df.dtypes])


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    for by in (None, "day"):
        path = f"{tmp_path}/{by}/t"
        io.write_parquet(one, path, by)
        with pytest.raises(Exception, match="torn"):
            io.write_parquet(_broken(one), path, by)
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
        io.write_parquet(spark.read.parquet(path).withColumn("id", F.col("id") + 10).where("day = 'b'"), path, by)  # reads what it replaces
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ([12] if by is None else [1, 12])
        left = [p.name for p in (tmp_path / str(by)).iterdir()]
        assert left == ["t"]


def test_runs_commit_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    one = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-02-01"), (4, None)], "id int, day string")
    assert io.commits(spark, path).count() == 0
    with pytest.raises(Exception, match="torn"):
        io.write_run(_broken(one), path, "day", "run_1")
    assert io.commits(spark, path).count() == 0
    assert io.write_run(one, path, "day", "run_1") and not io.write_run(one, path, "day", "run_1")
    assert io.write_run(one.where("id = 2").withColumn("id", F.lit(7)), path, "day", "run_2")
    assert sorted(r["run_id"] for r in io.commits(spark, path).collect()) == ["run_1", "run_2"]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 3, 4, 7]
    assert io.expire_partitions(spark, path, "day", "2024-01-31") == ["2024-01-01", "2024-01-02"]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]
    assert io.expire_partitions(spark, f"{tmp_path}/none", "day", "2024") == []


def test_parse_keeps_all_of_a_line(spark):
    lines = ['{"k": 5, "at": "2024-01-31"}', '{"k": "x5", "tags": ["a"], "more": {"b": 1}}', '{"k": null, "tags": "none"}', '{"k": 1', "[1]", "", None, "{}"]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "id int, line string, rescued string")
    out = {r["id"]: r for r in schema.parse(df, "line", "k bigint, at date, tags array<string>").withColumn("status", schema.status()).collect()}
    assert [out[i]["status"] for i in range(8)] == ["kept", "rescued", "rescued", "rejected", "rejected", "rejected", "kept", "kept"]
    assert (out[0]["k"], str(out[0]["at"]), out[0]["rescued"]) == (5, "2024-01-31", None)
    assert out[1]["rescued"] == {"k": "x5", "more": '{"b":1}'} and list(out[1]["tags"]) == ["a"]
    assert out[2]["rescued"] == {"tags": "none"} and out[3]["corrupt"] == '{"k": 1'


#: What the entities must accept and refuse: a full product, one without a required field, prices and ratings out of range.
_PRODUCT = {
    "product_id": "p1", "site": "site_a", "url": "https://shop.example/p/1", "brand": "B", "name": "N", "category_path": ["parfum"], "price_value": 99.5,
    "price_currency": "EUR", "first_seen_ts": "2024-01-01 00:00:00", "last_seen_ts": "2024-01-02 00:00:00", "source_site": "shop.example",
    "source_url": "https://shop.example/p/1", "scrape_ts": "2024-01-02 00:00:00", "rating_avg": 4.5, "rating_count": 10,
}


@pytest.mark.parametrize(
    "change, status, errors",
    [({}, "kept", []), ({"brand": None}, "kept", ["brand: required"]), ({"rating_avg": 6.0}, "kept", ["rating_avg: out of range"]), ({"price_value": "cheap"}, "rescued", ["price_value: required"]), ({"extra": 1}, "rescued", [])],
)
def test_products_from_text(spark, change, status, errors):
    line = json.dumps({k: v for k, v in {**_PRODUCT, **change}.items() if v is not None})
    read = schema.parse(spark.createDataFrame([(line,)], "line string"), "line", schema.PRODUCT)
    assert read.select(schema.status().alias("s")).first()["s"] == status
    assert schema.validate(read, "product", {"site": ("site_a",)}).first()["errors"] == errors
