"""Integrity checks and quality gates (B3-B10, C6, D10-D18, D25, E1, F3). Counts over one table share one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions.numeric import rnd, share
from sillage.operators.ranks import with_next

#: Brands of which a real catalogue has some; the pattern of generated brand names.
EXPECTED_BRANDS = (
    "Chanel", "Parfums Christian Dior", "Guerlain", "Hermès", "Givenchy", "Maison Francis Kurkdjian", "Acqua di Parma",
    "Tom Ford Beauty", "La Mer", "Jo Malone London", "Le Labo", "By Kilian", "Yves Saint Laurent", "Lancôme",
    "Armani Beauty", "Valentino Beauty", "Burberry Beauty", "Chloé",
)
GENERATED = "^Brand_[0-9]+$"


def no_evidence() -> Column:
    return F.col("refillable_flag") & (F.coalesce(F.size("refill_evidence"), F.lit(0)) == 0)


def provenance_gate(products: DataFrame, reviews: DataFrame) -> DataFrame:
    two = F.col("source_url").isNull() | F.col("scrape_ts").isNull()
    p = products.agg(F.count_if(two).alias("products_2col"), F.count_if(two | F.col("robots_snapshot_id").isNull()).alias("products_3col"))
    r = reviews.agg(F.count_if(two).alias("reviews_2col"))
    return p.crossJoin(r)


def no_text_evidence() -> Column:
    """no_evidence() where the evidence is a text that holds a list."""
    e = F.col("refill_evidence")
    return F.col("refillable_flag") & (e.isNull() | e.isin("[]", ""))


def evidence_gate(products: DataFrame) -> DataFrame:
    out = products.agg(F.count_if(no_evidence()).alias("invalid"), F.count_if("refillable_flag").alias("total"))
    return out.withColumn("status", F.when(F.col("invalid") == 0, "PASS").otherwise("FAIL"))


def generated_brands(products: DataFrame) -> DataFrame:
    return products.agg(F.count_if(F.col("brand").rlike(GENERATED)).alias("n"))


def expected_brands(products: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    return products.agg(F.count_if(F.col("brand").isin(*brands)).alias("luxury_count"))


def price_gaps(products: DataFrame) -> DataFrame:
    """Distinct rounded gaps between neighbouring distinct prices; one at most tells of generated prices. The order of the
    prices is dealt to ranges; with_next() stitches them."""
    prices = with_next(products.select("price_value").distinct(), "price_value", "next")
    out = prices.select(rnd(F.col("next") - F.col("price_value"), 2).alias("gap")).agg(F.count_distinct("gap").alias("gaps"))
    return out.withColumn("uniform", F.col("gaps") <= 1)


def review_duplicates(texts: DataFrame) -> DataFrame:
    """Reviews whose rating and text repeat; more than a tenth is flagged. Grouped by a digest, not by the text."""
    groups = texts.groupBy("rating", F.sha2("body", 256).alias("body")).agg(F.count(F.lit(1)).alias("n"))
    out = groups.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"), F.count_if(F.col("n") > 1).alias("groups"), F.sum("n").alias("total")
    )
    part = F.coalesce(F.try_divide(100.0 * F.col("duplicates"), F.col("total")), F.lit(0.0))
    return out.withColumn("percentage", rnd(part, 2)).withColumn("flagged", F.col("percentage") > 10)


def manifest_plausibility(manifest: DataFrame, products: DataFrame) -> DataFrame:
    """Runs with fewer requests than twice the products of all sites."""
    total = products.agg(F.count(F.lit(1)).alias("products"))
    return manifest.crossJoin(total).where(F.col("total_requests") < 2 * F.col("products")).select("run_id", "site", "total_requests", "products")


def robots_provenance(manifest: DataFrame) -> DataFrame:
    return manifest.where("robots_etag IS NULL OR robots_path IS NULL").groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def rating_bounds(reviews: DataFrame) -> DataFrame:
    return reviews.agg(rnd(share(F.col("rating").between(1, 5)), 3).alias("in_bounds"))


def price_sanity(products: DataFrame) -> DataFrame:
    by = products.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"), F.min("price_value").alias("pmin"), F.max("price_value").alias("pmax"),
        F.count_distinct("price_value").alias("levels"), rnd(F.avg("price_value"), 2).alias("pavg"),
    )
    flags = {"few_levels": (F.col("levels") <= 2) & (F.col("n") >= 20), "constant": F.col("pmin") == F.col("pmax")}
    return by.where("n >= 10").withColumns(flags).orderBy("levels", F.desc("n"), "brand")


def luxury_coverage(classified: DataFrame) -> DataFrame:
    return classified.groupBy("site").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_luxury").alias("luxury"), rnd(share(F.col("is_luxury")), 3).alias("rate"),
        rnd(F.avg("price_value"), 2).alias("avg_price"),
    )


def review_quality(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), rnd(share(F.col("language") == "fr"), 3).alias("fr_ratio"),
        F.min("review_date").cast("string").alias("first_date"), F.max("review_date").cast("string").alias("last_date"),
        rnd(F.avg("rating"), 2).alias("avg_rating"),
    )


def collection_targets(classified: DataFrame, reviews: DataFrame) -> DataFrame:
    p = classified.agg(
        F.count(F.lit(1)).alias("products"), F.count_if("is_luxury").alias("luxury"), F.count_if("refillable_flag").alias("refillable")
    )
    r = reviews.agg(F.count(F.lit(1)).alias("reviews"), F.count_if(F.col("language") == "fr").alias("french"))
    ratio = lambda a, n: F.when(F.col(n) > 0, rnd(F.try_divide(F.col(a).cast("double"), F.col(n)), 3)).otherwise(0.0)
    out = p.crossJoin(r).withColumns({
        "luxury_ratio": ratio("luxury", "products"), "refill_ratio": ratio("refillable", "products"), "french_ratio": ratio("french", "reviews"),
    })
    goals = {
        "enough_products": F.col("products") >= 1000, "enough_reviews": F.col("reviews") >= 10000,
        "enough_luxury": F.col("luxury_ratio") >= 0.1, "enough_french": F.col("french_ratio") >= 0.5,
    }
    out = out.withColumns(goals)
    return out.withColumn("all_met", F.col("enough_products") & F.col("enough_reviews") & F.col("enough_luxury") & F.col("enough_french"))


def integrity_report(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """All violations of both tables from two scans, and the verdict."""
    two = F.col("source_url").isNull() | F.col("scrape_ts").isNull()
    p = products.agg(
        F.count_if(two).alias("products"), F.count_if(no_evidence()).alias("evidence"), F.count_if(F.col("brand").rlike(GENERATED)).alias("brands")
    )
    r = reviews.agg(F.count_if(two).alias("reviews"), F.count_if(~F.col("rating").between(1, 5)).alias("ratings"))
    names = ("products", "evidence", "brands", "reviews", "ratings")
    found = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in names]))
    out = p.crossJoin(r).withColumn("found", found)
    return out.select(F.array_join("found", "; ").alias("violations"), F.when(F.size("found") == 0, "PASS").otherwise("FAIL").alias("status"))


def fixture_contamination(df: DataFrame) -> DataFrame:
    """Rows marked as fixtures; a table without such a column has none."""
    if "is_fixture" not in df.columns:
        return df.agg(F.lit(0).cast("bigint").alias("n"))
    return df.agg(F.count_if("is_fixture").alias("n"))


def audit_sample(products: DataFrame, seed: str = "audit", n: int = 20) -> DataFrame:
    """A random sample that reruns repeat: the smallest digests of seed and id. A top-k, not a global sort."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("product_id").cast("string")))
    return products.select("product_id", "brand", "name", "price_value", "source_url", key.alias("k")).orderBy("k").limit(n).drop("k")
