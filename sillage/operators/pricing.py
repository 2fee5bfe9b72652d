"""Price statistics by category and the luxury classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions.numeric import rnd
from sillage.operators.ranks import name, percentiles

#: The threshold where a category has no statistics; products that a category needs for statistics; rows of a report.
FALLBACK, LEAST, REPORTED = 100.0, 5, 20


def _category() -> Column:
    return F.get("category_path", F.lit(0))


def _priced(products: DataFrame) -> DataFrame:
    return products.where("price_value > 0").withColumn("category", _category())


def category_stats(products: DataFrame, as_of: str) -> DataFrame:
    more = [
        F.count(F.lit(1)).alias("n"), rnd(F.avg("price_value"), 2).alias("mean_price"), F.min("price_value").alias("min_price"),
        F.max("price_value").alias("max_price"), rnd(F.stddev_samp("price_value"), 3).alias("std_price"),
    ]
    tiles = (25, 50, 75, 90, 95)
    stats = percentiles(_priced(products), ["site", "category"], "price_value", tiles, *more)
    stats = stats.where(F.col("n") >= LEAST).select(
        "site", "category", "n", "mean_price", *[rnd(F.col(name(p)), 2).alias(name(p)) for p in tiles], "min_price", "max_price", "std_price",
        F.lit("EUR").alias("currency"), F.lit(as_of).alias("computed_ts"),
    )
    return stats.orderBy("site", F.desc("p75"))


def thresholds(products: DataFrame) -> DataFrame:
    found = percentiles(_priced(products), ["site", "category"], "price_value", (75,), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= LEAST).drop("n")


def classify(products: DataFrame, tiers: DataFrame) -> DataFrame:
    """products with brand_tier and is_luxury: of a tier, and priced at its category's 75th percentile or above. No
    price, or no category: not luxury; a category without statistics has the threshold FALLBACK. Adaptive execution
    broadcasts the two dimensions while they are small."""
    priced = products.withColumn("category", _category())
    joined = priced.join(tiers.withColumnRenamed("tier", "brand_tier"), "brand", "left").join(thresholds(products), ["site", "category"], "left")
    high = F.col("price_value") >= F.coalesce("p75", F.lit(FALLBACK))
    luxury = (F.col("price_value") > 0) & (F.col("category") != "") & F.col("brand_tier").isNotNull() & high
    return joined.withColumn("is_luxury", F.coalesce(luxury, F.lit(False))).drop("category", "p75")


def reason() -> Column:
    tier = F.col("brand_tier")
    return (
        F.when(F.col("is_luxury") & tier.isNotNull(), F.concat(F.lit("Brand tier "), tier, F.lit(" + price threshold met")))
        .when(F.col("is_luxury"), "Price threshold only")
        .when(tier.isNull(), "Brand not in luxury tiers")
        .otherwise("Price below category threshold")
    )


def kept_dropped(classified: DataFrame) -> DataFrame:
    """The first REPORTED kept and dropped products by id, with the reason."""
    status = F.when(F.col("is_luxury"), "kept").otherwise("dropped")
    first = lambda s: classified.where(F.col("is_luxury") == (s == "kept")).orderBy("product_id").limit(REPORTED)
    both = first("kept").unionByName(first("dropped"), allowMissingColumns=True)
    return both.select(status.alias("status"), "product_id", "brand", "name", "price_value", "price_currency", "brand_tier",
                       F.array_join("category_path", ">").alias("category_path"), reason().alias("classification_reason"))
