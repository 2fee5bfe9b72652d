"""The canonical tables in DuckDB SQL, as common table expressions that the oracles begin with."""

from __future__ import annotations

from sillage.sources.views import SITES, TIER_1, TIER_15

_SITES = "[" + ", ".join(f"'{s}'" for s in SITES) + "]"

PRODUCTS = f"""products AS (
  SELECT p_partkey AS product_id, {_SITES}[CAST(p_partkey % 3 AS INT) + 1] AS site, p_brand AS brand, p_name AS name,
    [lower(p_type), split_part(p_name, ' ', 2)] AS category_path, p_retailprice AS price_value, 'EUR' AS price_currency,
    CAST(p_size AS DOUBLE) AS size_ml_or_g, 1.0::DOUBLE + (p_partkey % 41) / 10.0::DOUBLE AS rating_avg, p_partkey % 500 AS rating_count,
    list_filter([CASE WHEN p_size >= 40 THEN 'facet' END, CASE WHEN split_part(p_name, ' ', 2) = 'ring' THEN 'badge' END,
      CASE WHEN split_part(p_name, ' ', 1) = 'new' THEN 'attribute_text' END], lambda x: x IS NOT NULL) AS refill_evidence,
    (p_size >= 40 OR split_part(p_name, ' ', 2) = 'ring' OR split_part(p_name, ' ', 1) = 'new' OR p_partkey % 97 = 0) AS refillable_flag,
    CASE WHEN p_partkey % 211 <> 0 THEN 'https://shop.example/product/' || p_partkey END AS source_url,
    CASE WHEN p_partkey % 307 <> 0 THEN DATE '2025-06-01' + CAST(p_partkey % 30 AS INT) END AS scrape_ts,
    CASE WHEN p_partkey % 401 <> 0 THEN 'robots_' || (p_partkey % 7) END AS robots_snapshot_id,
    DATE '2025-01-01' + CAST(p_partkey % 365 AS INT) AS first_seen_ts
  FROM part)"""

TIERS = "tiers AS (SELECT * FROM (VALUES " + ", ".join(
    [f"('{b}', '1')" for b in TIER_1] + [f"('{b}', '1.5')" for b in TIER_15]
) + ") t(brand, tier))"

REVIEWS = f"""reviews AS (
  SELECT l_orderkey || '-' || l_linenumber AS review_id, l_partkey AS product_id, {_SITES}[CAST(l_partkey % 3 AS INT) + 1] AS site,
    1 + CAST(trunc(l_quantity) AS INT) % 5 AS rating, CAST(round(l_discount * 100) AS INT) AS helpful_count, l_returnflag <> 'R' AS verified_purchase,
    CAST(l_shipdate AS DATE) AS review_date,
    CASE WHEN l_orderkey % 10 <= 5 THEN 'fr' WHEN l_orderkey % 10 <= 7 THEN 'en' ELSE 'other' END AS language,
    'https://shop.example/review/' || l_orderkey AS source_url,
    CASE WHEN l_orderkey % 503 <> 0 THEN CAST(l_shipdate AS DATE) END AS scrape_ts
  FROM lineitem)"""

TEXTS = "review_texts AS (SELECT doc_id AS review_id, doc_id % 100 AS product_id, source AS site, text AS body, lang AS language, 1 + doc_id % 5 AS rating FROM documents)"

PAGES = r"""crawl_pages AS (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain,
    nullif(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '') AS path FROM pages)"""

LOG = "fetch_log AS (SELECT user_id AS domain_id, ts, event_id, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status FROM events)"

MANIFEST = f"""manifest AS (SELECT 'run_' || s_suppkey AS run_id, {_SITES}[CAST(s_suppkey % 3 AS INT) + 1] AS site, s_suppkey * 100 AS total_requests,
    s_suppkey % 5 AS blocked_requests, CASE WHEN s_suppkey % 4 <> 0 THEN 'etag' || s_suppkey END AS robots_etag,
    CASE WHEN s_suppkey % 9 <> 0 THEN '/robots.txt' END AS robots_path FROM supplier)"""


def rnd(x: str, k: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(18,6)), {k}) AS DOUBLE)"


#: Classified products: price statistics by site and category, tier, threshold, verdict.
STATS = """stats AS (SELECT site, category_path[1] AS category, COUNT(*) AS n, quantile_cont(price_value, 0.75) AS p75
    FROM products WHERE price_value > 0 GROUP BY 1, 2 HAVING COUNT(*) >= 5)"""
CLASSIFIED = f"""{STATS}, classified AS (
  SELECT p.*, t.tier AS brand_tier,
    coalesce(price_value > 0 AND category_path[1] <> '' AND t.tier IS NOT NULL AND price_value >= coalesce(s.p75, 100), false) AS is_luxury
  FROM products p LEFT JOIN tiers t USING (brand) LEFT JOIN stats s ON s.site = p.site AND s.category = p.category_path[1])"""


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "
