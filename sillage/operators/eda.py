"""Exploratory aggregates over products and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions.numeric import rnd, share
from sillage.operators.ranks import name, percentiles


def _category() -> Column:
    return F.get("category_path", F.lit(0))


def luxury_counts(products: DataFrame) -> DataFrame:
    return products.where("is_luxury").groupBy("site", "brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "site", "brand")


def refill_share(products: DataFrame) -> DataFrame:
    by = products.groupBy("brand").agg(rnd(share(F.col("refillable_flag")), 3).alias("refill_rate"), F.count(F.lit(1)).alias("n"))
    return by.where("n >= 1").orderBy(F.desc("refill_rate"), "brand")


def price_tiles(products: DataFrame) -> DataFrame:
    tiles = (25, 50, 75, 90)
    priced = products.where("price_value > 0").withColumn("cat", _category())
    more = [F.count(F.lit(1)).alias("n"), rnd(F.avg("price_value"), 2).alias("mean_price")]
    found = percentiles(priced, ["site", "cat"], "price_value", tiles, *more)
    return found.select("site", "cat", "n", "mean_price", *[rnd(F.col(name(p)), 2).alias(name(p)) for p in tiles]).orderBy("site", F.desc("p75"))


def review_health(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        rnd(F.avg("rating"), 3).alias("avg_rating"),
        rnd(share(F.col("language") == "fr"), 3).alias("fr_ratio"),
        F.count_distinct("product_id").alias("unique_products"),
    )


def text_sufficiency(texts: DataFrame) -> DataFrame:
    n = F.length("body")
    return texts.where("language = 'fr'").agg(
        F.count(F.lit(1)).alias("total_reviews"), rnd(F.avg(n), 2).alias("avg_len"),
        rnd(share(n >= 120), 3).alias("share_120p"), rnd(share(n >= 50), 3).alias("share_50p"),
    )


def luxury_comparison(products: DataFrame) -> DataFrame:
    return products.groupBy("is_luxury").agg(
        F.count(F.lit(1)).alias("product_count"), rnd(F.avg("price_value"), 2).alias("avg_price"),
        rnd(F.avg("rating_avg"), 2).alias("avg_rating"), rnd(F.avg("rating_count"), 0).alias("avg_review_count"),
        rnd(share(F.col("refillable_flag")), 3).alias("refill_rate"),
    )


def refill_evidence(products: DataFrame) -> DataFrame:
    """How often each kind of evidence occurs, in % of refillable products (one may have several)."""
    some = products.where("refillable_flag")
    total = some.agg(F.count(F.lit(1)).alias("total"))
    kinds = some.select(F.explode("refill_evidence").alias("evidence_type")).groupBy("evidence_type").agg(F.count(F.lit(1)).alias("n"))
    return kinds.crossJoin(total).select("evidence_type", "n", rnd(100.0 * F.col("n") / F.col("total"), 2).alias("percentage"))


def eda_summary(products: DataFrame, reviews: DataFrame) -> DataFrame:
    p = products.agg(
        F.count(F.lit(1)).alias("total_products"), F.count_if("is_luxury").alias("luxury_products"),
        F.count_if("refillable_flag").alias("refillable_products"), F.count_distinct("brand").alias("unique_brands"),
        F.count_distinct("site").alias("sites"),
    )
    r = reviews.agg(F.count(F.lit(1)).alias("total_reviews"), F.count_if(F.col("language") == "fr").alias("french_reviews"))
    return p.crossJoin(r)  # of two rows of one


def brand_overview(products: DataFrame) -> DataFrame:
    return products.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("price_value"), 2).alias("avg_price"), F.count_if("refillable_flag").alias("refillable")
    )


def category_array_stats(products: DataFrame) -> DataFrame:
    """Grouped by the whole category path."""
    more = [F.count(F.lit(1)).alias("n"), rnd(F.avg("price_value"), 2).alias("mean_price"), rnd(F.stddev_samp("price_value"), 3).alias("std_price")]
    by = percentiles(products, ["category_path"], "price_value", (75,), *more)
    return by.select(F.array_join("category_path", ">").alias("category"), "n", "mean_price", "std_price", rnd(F.col("p75"), 2).alias("p75"))


def missing_fields(products: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return products.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in names])


def corpus_summary(products: DataFrame) -> DataFrame:
    by = products.groupBy(_category().alias("category")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("price_value"), 2).alias("avg_price"))
    return by.select("category", "n", "avg_price")
