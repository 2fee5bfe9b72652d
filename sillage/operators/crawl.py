"""Crawl analytics over landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions import scalars

#: Refill words looked for in pages (the repeated one counts twice); patterns of ratings, in order.
REFILL = ("recharge", "refill", "rechargeable", "rechargeable")
RATINGS = (r"(?i)rating[^>]*>(\d+)", r"(?i)star[^>]*>(\d+)", r"(?i)note[^>]*>(\d+)")
LINKS = (r'(?i)href="([^"]*product[^"]*)"', r'(?i)href="([^"]*p/[^"]*)"', r'(?i)href="([^"]*produit[^"]*)"')


def page_fields(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    price = F.replace(scalars.found(html, r"(\d+[,.]?\d*)\s*€"), F.lit(","), F.lit(".")).try_cast("double")
    words = F.array_compact(F.array(*[F.when(F.contains(F.lower(html), F.lit(w)), F.lit(w)) for w in REFILL]))
    return pages.select(
        "page_id", F.trim(scalars.found(html, r"(?i)<title[^>]*>([^<]+)</title>")).alias("name"), price.alias("price_value"),
        F.trim(scalars.found(html, r"(?i)brand[^>]*>([^<]+)</")).alias("brand"), F.array_join(words, ",").alias("refill_evidence"),
    )


def absolute(url: Column, base: Column) -> Column:
    """A link as seen from a page: absolute, scheme-relative, rooted, or relative to the page's folder."""
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return (
        F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, url))
        .when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat(folder, url))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct product links of each page."""
    raw = F.concat(*[F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in LINKS])
    links = pages.select("page_id", "url", F.explode(F.array_distinct(raw)).alias("raw"))
    full = links.select("page_id", absolute(F.col("raw"), F.col("url")).alias("link"))
    return full.where(scalars.is_product_url(F.col("link"))).distinct()


def all_links(pages: DataFrame) -> DataFrame:
    """Every link of each page, absolute, and whether it looks like a product's."""
    raw = F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    links = pages.select("page_id", "url", F.explode(F.array_distinct(raw)).alias("raw"))
    full = links.select("page_id", absolute(F.col("raw"), F.col("url")).alias("link"))
    return full.withColumn("is_product", scalars.is_product_url(F.col("link")))


def page_ratings(pages: DataFrame, most: int = 10) -> DataFrame:
    """The first ratings of a page, 1 to 5, in pattern order."""
    raw = F.concat(*[F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in RATINGS])
    kept = F.slice(F.filter(F.transform(raw, lambda x: x.try_cast("int")), lambda x: x.between(1, 5)), 1, most)
    return pages.select("page_id", F.posexplode(kept).alias("pos", "rating"))


def unseen(batch: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not in `seen`; of rows that repeat a key, the first by `order`."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return batch.join(seen.select(key), key, "left_anti").withColumn("__n", first).where("__n = 1").drop("__n")


def discovered(listings: DataFrame, most: int = 10) -> DataFrame:
    """(listing, page_no, link) to (listing, link, page_no): what paging through each listing finds, with the page a
    link is first on. Paging ends after `most` pages or with the first one that has no new link: only a gapless run of
    pages that are some link's first counts. No loop: first pages are an aggregate, runs a number by page."""
    first = listings.where(F.col("page_no").between(1, most)).groupBy("listing", "link").agg(F.min("page_no").alias("page_no"))
    new = first.select("listing", "page_no").distinct()  # `most` rows of a listing at most
    place = F.row_number().over(Window.partitionBy("listing").orderBy("page_no"))
    run = new.withColumn("place", place).where("place = page_no").select("listing", "page_no")
    return first.join(run, ["listing", "page_no"]).select("listing", "link", "page_no")


def crawl_plan(starts: DataFrame, links: DataFrame, landed: DataFrame, most: int = 10, each: int = 5) -> DataFrame:
    """The pages that a crawl visits, in order: (site, url, visit).

    starts: (site, start_no, url); links: (url, link_no, link), numbered from 0; landed: (url) of pages that can be
    had. Of each start that is landed its first `each` links are taken, those that are landed and not yet visited. The
    number of visits is checked against `most` between starts only, so a crawl may end above it. A site has some starts
    of `each` links, so its window is small."""
    ok = landed.select("url").distinct()
    first = starts.join(ok, "url", "left_semi")
    own = first.select("site", "start_no", F.lit(-1).alias("link_no"), "url")
    below = first.join(links.where(F.col("link_no") < each), "url").select("site", "start_no", "link_no", F.col("link").alias("url"))
    at = F.struct(F.col("start_no").cast("bigint").alias("start_no"), F.col("link_no").cast("bigint").alias("link_no"))
    visits = own.unionByName(below.join(ok, "url", "left_semi")).groupBy("site", "url").agg(F.min(at).alias("at"))
    order = Window.partitionBy("site")
    before = F.count(F.lit(1)).over(order.orderBy("at.start_no").rangeBetween(Window.unboundedPreceding, -1))
    numbered = visits.withColumn("before", before).withColumn("visit", F.row_number().over(order.orderBy("at")))
    return numbered.where(F.col("before") < most).select("site", "url", "visit")


def filter_urls(brands: DataFrame, categories: DataFrame) -> DataFrame:
    """A URL for each brand and category: both are small dimensions, and their product is the result."""
    slug = F.replace(F.lower("brand"), F.lit("#"), F.lit("-"))
    url = F.concat(F.lit("https://shop.example/"), F.col("category"), F.lit("?brand="), slug)
    return brands.select("brand").distinct().crossJoin(categories.select("category").distinct()).select("brand", "category", url.alias("url"))


def domain_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("domain_id").agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(F.col("status").isin(403, 429, 503)).alias("blocked_requests"),
        F.count_if(F.col("status") == 429).alias("rate_limit_violations"),
    )
