"""The canonical tables of the library, as deterministic views over generic star-schema tables.

The Parquet scans stay at the leaves of every plan, so filters and column pruning reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for "now" in every query that needs it.
AS_OF = "2026-01-01"
SITES = ("site_a", "site_b", "site_c")
#: Brands of the first and of the next tier.
TIER_1 = tuple(f"Brand#{i}" for i in range(1, 9))
TIER_15 = tuple(f"Brand#{i}" for i in range(9, 17))


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    badge = F.when(F.get(words, F.lit(1)) == "ring", "badge")
    facet = F.when(F.col("p_size") >= 40, "facet")
    text = F.when(F.get(words, F.lit(0)) == "new", "attribute_text")
    evidence = F.array_compact(F.array(facet, badge, text))
    return scan(spark, sf_dir, "part").select(
        k.alias("product_id"),
        F.element_at(F.array(*map(F.lit, SITES)), (k % 3 + 1).cast("int")).alias("site"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.array(F.lower("p_type"), F.get(words, F.lit(1))).alias("category_path"),
        F.col("p_retailprice").alias("price_value"),
        F.lit("EUR").alias("price_currency"),
        F.col("p_size").cast("double").alias("size_ml_or_g"),
        (F.lit(1.0) + (k % 41) / F.lit(10.0)).alias("rating_avg"),
        (k % 500).alias("rating_count"),
        evidence.alias("refill_evidence"),
        ((F.size(evidence) > 0) | (k % 97 == 0)).alias("refillable_flag"),
        F.when(k % 211 != 0, F.concat(F.lit("https://shop.example/product/"), k.cast("string"))).alias("source_url"),
        F.when(k % 307 != 0, F.date_add(F.lit("2025-06-01").cast("date"), (k % 30).cast("int"))).alias("scrape_ts"),
        F.when(k % 401 != 0, F.concat(F.lit("robots_"), (k % 7).cast("string"))).alias("robots_snapshot_id"),
        F.date_add(F.lit("2025-01-01").cast("date"), (k % 365).cast("int")).alias("first_seen_ts"),
    )


def brand_tiers(spark: SparkSession) -> DataFrame:
    """brand, tier; a brand of both tiers is of the first. A fixed dimension of a few rows."""
    rows = [(b, "1") for b in TIER_1] + [(b, "1.5") for b in TIER_15 if b not in TIER_1]
    return spark.createDataFrame(rows, "brand string, tier string")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    mod = F.col("l_orderkey") % 10
    return scan(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"),
        F.col("l_partkey").alias("product_id"),
        F.element_at(F.array(*map(F.lit, SITES)), (F.col("l_partkey") % 3 + 1).cast("int")).alias("site"),
        (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("rating"),
        F.round(F.col("l_discount") * 100).cast("int").alias("helpful_count"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.col("l_shipdate").cast("date").alias("review_date"),
        F.when(mod <= 5, "fr").when(mod <= 7, "en").otherwise("other").alias("language"),
        F.concat(F.lit("https://shop.example/review/"), F.col("l_orderkey").cast("string")).alias("source_url"),
        F.when(F.col("l_orderkey") % 503 != 0, F.col("l_shipdate").cast("date")).alias("scrape_ts"),
    )


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), (F.col("doc_id") % 100).alias("product_id"), F.col("source").alias("site"),
        F.col("text").alias("body"), F.col("lang").alias("language"), (1 + F.col("doc_id") % 5).alias("rating"),
    )


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "pages").select(
        "page_id", "url", "html", F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("domain"),
        F.nullif(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), F.lit("")).alias("path"),
    )


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "events").select(
        F.col("user_id").alias("domain_id"), "ts", "event_id", F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status")
    )


def manifest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per supplier: requests, robots provenance."""
    k = F.col("s_suppkey")
    return scan(spark, sf_dir, "supplier").select(
        F.concat(F.lit("run_"), k.cast("string")).alias("run_id"),
        F.element_at(F.array(*map(F.lit, SITES)), (k % 3 + 1).cast("int")).alias("site"),
        (k * 100).alias("total_requests"), (k % 5).alias("blocked_requests"),
        F.when(k % 4 != 0, F.concat(F.lit("etag"), k.cast("string"))).alias("robots_etag"),
        F.when(k % 9 != 0, F.lit("/robots.txt")).alias("robots_path"),
    )
