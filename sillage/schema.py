"""The entities as Spark schemas, column aliases, and loading into them (B16, B17, section 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


#: Allowed values of enumerated fields.
EVIDENCE, LANGUAGES = ("facet", "badge", "attribute_text"), ("fr", "en", "other")
#: Other names that columns come under.
ALIASES = {"text": "body", "helpful_votes": "helpful_count"}

PRODUCT = (
    "product_id string, site string, url string, canonical_url string, brand string, line string, name string, category_path array<string>,"
    " price_value double, price_currency string, size string, size_ml_or_g double, availability string, rating_avg double, rating_count bigint,"
    " refillable_flag boolean, refill_evidence array<string>, refill_parent_sku string, packaging_notes string, ingredients_present boolean,"
    " ean_gtin string, image_url string, breadcrumbs array<string>, first_seen_ts timestamp, last_seen_ts timestamp, source_site string,"
    " source_url string, scrape_ts timestamp, is_luxury boolean, brand_tier string, enrichment string"
)
REVIEW = (
    "review_id string, product_id string, site string, url string, rating int, title string, body string, language string, review_date date,"
    " verified_purchase boolean, helpful_count int, author_label string, scrape_ts timestamp, sentiment_score double, sentiment_label string"
)
BRAND = "brand string, tier string, aliases array<string>, updated_ts timestamp"
PAGE_MANIFEST = "url string, url_hash string, status int, fetched_ts timestamp, bytes bigint, robots_allowed boolean, snapshot_path string"
COMPLIANCE = (
    "domain string, robots_etag string, robots_last_modified string, allow_paths array<string>, disallow_paths array<string>, crawl_delay double,"
    " start_ts timestamp, end_ts timestamp, total_requests int, blocked_requests int, rate_limit_violations int"
)
RUN_MANIFEST = (
    "run_id string, git_hash string, config_version string, start_ts timestamp, end_ts timestamp, domains array<string>, products_count int,"
    f" reviews_count int, errors_count int, compliance_manifests array<struct<{COMPLIANCE.replace(' ', ':').replace(',:', ', ')}>>"
)
PRICE_STATS = "site string, category string, p25 double, p50 double, p75 double, p90 double, count bigint, currency string, computed_ts timestamp"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of a schema, in its order and types: aliases resolved, missing columns typed nulls, others
    dropped. Values that don't fit a type become null."""
    have = {ALIASES.get(c, c) if ALIASES.get(c, c) not in df.columns else c: c for c in df.columns}
    out = []
    for part in _split(ddl):
        name, kind = part.split(" ", 1)
        source = F.col(have[name]).try_cast(kind) if name in have else F.lit(None).cast(kind)
        out.append(source.alias(name))
    return df.select(*out)


#: Columns that parse() adds.
RESCUED, CORRUPT = "rescued", "corrupt"


def parse(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """df with the JSON of a text column as typed columns in its place: `rescued` holds, by field, the text of values that
    did not fit their type and of fields that the schema lacks (null if there are none); `corrupt` holds a text that is no
    JSON object, whole. Nothing of a line is lost. A null text has nulls in all of them. Columns of the same names go."""
    names = [part.split(" ", 1) for part in _split(ddl)]
    taken = {column, RESCUED, CORRUPT, *(n for n, _ in names)}
    raw = F.from_json(column, "map<string, string>", {"mode": "PERMISSIVE"})
    read = df.withColumn("_raw", raw)
    kept = {n: read["_raw"][n].try_cast(t) if t in _PLAIN else F.from_json(read["_raw"][n], t) for n, t in names}
    read = read.withColumn("_typed", F.struct(*[x.alias(n) for n, x in kept.items()]))
    known = F.create_map(*[y for n, _ in names for y in (F.lit(n), F.col("_typed")[n].isNotNull())])
    rest = F.map_filter("_raw", lambda k, v: v.isNotNull() & ~F.coalesce(known[k], F.lit(False)))
    rescued = F.when(F.size(F.map_keys(rest)) > 0, rest)
    corrupt = F.when(F.col("_raw").isNull() & F.col(column).isNotNull(), F.col(column))
    return read.select(*[c for c in df.columns if c not in taken], "_typed.*", rescued.alias(RESCUED), corrupt.alias(CORRUPT))


#: Types that a text is cast to; others are parsed as JSON.
_PLAIN = ("string", "int", "bigint", "double", "boolean", "date", "timestamp")


def status() -> Column:
    """What parse() made of a row: rejected (no JSON object), rescued (something fits no column), or kept."""
    return F.when(F.col(CORRUPT).isNotNull(), "rejected").when(F.col(RESCUED).isNotNull(), "rescued").otherwise("kept")


#: Fields that an entity must have, ranges (None: open), fields of http(s) addresses.
REQUIRED = {
    "product": "product_id site url brand name category_path price_value price_currency first_seen_ts last_seen_ts source_site source_url scrape_ts".split(),
    "review": "review_id product_id site url rating body language review_date scrape_ts".split(),
}
RANGES = {"product": {"rating_avg": (0, 5), "rating_count": (0, None)}, "review": {"rating": (1, 5), "helpful_count": (0, None)}}
ADDRESSES = {"product": ("url", "canonical_url", "image_url", "source_url"), "review": ("url",)}


def violations(entity: str, allowed: dict[str, tuple[str, ...]]) -> Column:
    """What is wrong with a row of a conformed table, as an array of "field: reason": required fields that are null,
    values out of range, addresses without http(s) and host, values (of arrays: any) that are not among the allowed.
    A null breaks no rule but the first. Empty texts are values."""
    told = [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in REQUIRED[entity]]
    for c, (low, high) in RANGES[entity].items():
        out = F.col(c) < low if high is None else ~F.col(c).between(low, high)
        told.append(F.when(out | F.isnan(F.col(c).cast("double")), F.lit(f"{c}: out of range")))
    told += [F.when(~F.col(c).rlike(r"^(?i:https?)://[^/?#\s]+([/?#]\S*)?$"), F.lit(f"{c}: no address")) for c in ADDRESSES[entity]]
    for c, values in allowed.items():
        one = F.exists(c, lambda x: ~x.isin(*values)) if c.endswith("evidence") else ~F.col(c).isin(*values)
        told.append(F.when(one, F.lit(f"{c}: not allowed")))
    return F.array_compact(F.array(*told))


def validate(df: DataFrame, entity: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """df conformed to an entity, with its violations as `errors`; values that don't fit their type count as missing."""
    return conform(df, {"product": PRODUCT, "review": REVIEW}[entity]).withColumn("errors", violations(entity, allowed))


def _split(ddl: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]
