"""Extraction, normalisation and hashing of text fields, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists and patterns that results depend on.
FRENCH = (
    "le", "la", "les", "un", "une", "des", "et", "ou", "avec", "sans", "très", "plus", "moins", "bon", "bonne", "mauvais",
    "mauvaise", "parfait", "parfaite", "excellent", "excellente", "super", "génial",
)
ENGLISH = (
    "the", "a", "an", "and", "or", "with", "without", "very", "more", "less", "good", "bad", "perfect", "excellent",
    "great", "amazing",
)
CATEGORIES = (
    ("parfums", "fragrance"), ("soins", "skincare"), ("maquillage", "makeup"), ("visage", "face"), ("corps", "body"),
    ("cheveux", "hair"), ("yeux", "eyes"), ("lèvres", "lips"),
)
REFILL_FR = ("rechargeable", "recharge", "réutilisable")
REFILL_EN = ("refill", "refillable")
ANONYMOUS = r"client\s+vérifié|verified\s+customer|client\s+anon|anonymous\s+customer|utilisateur|user"
PRODUCT_URL = ("/product/", "/p/", "/produit/", "/item/", "product-", "produit-", "item-")
DATES = ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy", "d MMMM yyyy", "MMMM d, yyyy")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def price(text: Column) -> Column:
    """The number in a price; with "." and "," both, "," is the decimal mark; null unless above 0."""
    kept = F.regexp_replace(text, r"[^\d,.]", "")
    both = F.contains(kept, F.lit(",")) & F.contains(kept, F.lit("."))
    plain = F.when(both, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(kept, F.lit(","), F.lit(".")))
    value = plain.try_cast("double")
    return F.when(value > 0, value)


def rating(text: Column) -> Column:
    """The first of x/5, x étoiles, x stars and a bare number that lies in 0 to 5."""
    number = r"(?i)(\d+(?:\.\d+)?)"
    tries = [found(text, number + end).try_cast("double") for end in ("/5", r"\s*étoiles?", r"\s*stars?", "")]
    return F.coalesce(*[F.when(t.between(0, 5), t) for t in tries])


def size(text: Column) -> Column:
    """Millilitres or grams: the first kind of unit that matches decides, then a bare number; null unless above 0."""
    number = r"(?i)(\d+(?:\.\d+)?)"
    value = F.coalesce(*[found(text, number + end) for end in (r"\s*ml", r"\s*g", r"\s*grammes?", "")]).try_cast("double")
    return F.when(value > 0, value)


def whole_number(text: Column) -> Column:
    """The first digits, "," and "." dropped before."""
    return found(F.translate(text, ",.", ""), r"(\d+)").try_cast("bigint")


def review_rating(text: Column) -> Column:
    value = rating(text)
    return F.when(value.between(1, 5), value.cast("int"))


def body(text: Column) -> Column:
    """White space as single blanks; null at ten characters or fewer."""
    clean = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    return F.when(F.length(clean) > 10, clean)


def date(text: Column) -> Column:
    """A date of one of five formats (English month names); one in digits may stand inside a text. A format is tried only
    where the text has its shape, as a failed parse costs many times a match."""
    whole = F.trim(text)
    parsed = lambda x, f: F.try_to_timestamp(x, F.lit(f)).cast("date")
    slashes, year_first, day_first, day_month, month_day = DATES
    return F.coalesce(
        F.when(F.contains(text, F.lit("/")), parsed(found(text, r"(\d{1,2}/\d{1,2}/\d{4})"), slashes)),
        F.when(F.contains(text, F.lit("-")), F.coalesce(parsed(found(text, r"(\d{4}-\d{1,2}-\d{1,2})"), year_first), parsed(found(text, r"(\d{1,2}-\d{1,2}-\d{4})"), day_first))),
        F.when(whole.rlike(r"^\d+ \p{L}+ \d+$"), parsed(whole, day_month)),
        F.when(whole.rlike(r"^\p{L}+ \d+, \d+$"), parsed(whole, month_day)),
    )


def brand(text: Column) -> Column:
    clean = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?i)^(Parfums?\s+|Maison\s+)", "")
    return strip(F.regexp_replace(clean, r"(?i)\s+(Beauty|Parfums?|Cosmetics)$", ""))


def category(text: Column) -> Column:
    out = F.lower(strip(F.coalesce(text, F.lit(""))))
    for french, english in CATEGORIES:
        out = F.replace(out, F.lit(french), F.lit(english))
    return strip(out)


def breadcrumbs(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def category_path(crumbs: Column, words: tuple[str, ...]) -> Column:
    """Normalised crumbs that hold one of the words; ["unknown"] if none does."""
    kept = F.transform(F.filter(crumbs, lambda x: contains_any(F.lower(x), words)), category)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("unknown")))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def refill_evidence(facets: Column, badges: Column, text: Column, words: tuple[str, ...] = REFILL_FR + REFILL_EN) -> Column:
    """The first source that holds a word: facet, badge, attribute_text; null if none does."""
    some = lambda arr: F.coalesce(F.exists(arr, lambda x: contains_any(F.lower(x), words)), F.lit(False))
    return F.when(some(facets), "facet").when(some(badges), "badge").when(contains_any(F.lower(text), words), "attribute_text")


def language(text: Column) -> Column:
    """Which list has more members inside the text, as substrings; other on a tie."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    fr, en = count(FRENCH), count(ENGLISH)
    return F.when(fr > en, "fr").when(en > fr, "en").otherwise("other")


def author_label(text: Column) -> Column:
    """Only labels that name nobody."""
    return F.when(F.lower(text).rlike(ANONYMOUS), strip(text))


def product_id(url: Column, found: Column) -> Column:
    """The id in a product's URL; else the one found on the page, without what is neither word character nor hyphen."""
    in_url = F.regexp_extract(url, r"/product/([^/?]+)", 1)
    return F.when(in_url != "", in_url).when(found != "", F.regexp_replace(found, r"(?U)[^\w\-]", ""))


def helpful_count(text: Column) -> Column:
    """The first number, in which commas and points only group digits."""
    return F.regexp_extract(F.regexp_replace(text, "[,.]", ""), r"(\d+)", 1).try_cast("bigint")


def review_url(url: Column, review: Column) -> Column:
    return F.concat(url, F.lit("#review-"), review.cast("string"))


def review_id(product: Column, epoch: Column) -> Column:
    """The id of a review that has none of its own."""
    return F.concat(product.cast("string"), F.lit("_review_"), epoch.cast("string"))


def verified(text: Column) -> Column:
    """True, false or null; negations first, as they contain the positive words."""
    low = F.lower(text)
    no = contains_any(low, ("non vérifié", "not verified", "non confirmé"))
    return F.when(no, False).when(contains_any(low, ("vérifié", "verified", "confirmé", "confirmed")), True)


def product_key(brand_: Column, name: Column, size_: Column, site: Column) -> Column:
    low = lambda c: F.lower(F.trim(c))
    return F.md5(F.concat_ws("|", low(brand_), low(name), F.nullif(low(size_), F.lit("")), low(site)))


def review_key(product_id: Column, rating_: Column, day: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", product_id.cast("string"), rating_.cast("string"), day.cast("string"), F.lower(F.trim(F.substring(text, 1, 120)))))


def is_product_url(url: Column) -> Column:
    return contains_any(F.lower(url), PRODUCT_URL)


def slug_brand(url: Column) -> Column:
    """Chanel N5 from /product/chanel-n5-P1: up to the last hyphen of the segment, title case."""
    return F.initcap(F.replace(found(url, r"/product/([^/]+)-"), F.lit("-"), F.lit(" ")))


def next_page(url: Column, most: int = 10) -> Column:
    """The URL with its page number (1 if it has none) raised; null beyond `most`."""
    now = F.coalesce(found(url, r"[?&]page=(\d+)").try_cast("int"), F.lit(1))
    after = F.concat(F.lit("page="), (now + 1).cast("string"))
    has = url.rlike(r"[?&]page=\d+")
    add = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), after)
    out = F.when(has, F.replace(url, F.concat(F.lit("page="), now.cast("string")), after)).otherwise(add)
    return F.when(now + 1 <= most, out)


def with_facet(url: Column, facet: str = "facet=rechargeable") -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(facet))


def clean_text(text: Column) -> Column:
    """Letters, digits and white space only, lower case."""
    return strip(F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", " ")))


def product_errors() -> Column:
    """What is wrong with a product row. Required fields must be there and not empty or 0."""
    missing = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0"), F.lit(f"Missing required field: {c}"))
    checks = [missing(c) for c in ("product_id", "site", "brand", "name", "price_value")]
    checks.append(F.when(F.col("price_value") <= 0, F.lit("Invalid price value")))
    checks.append(F.when(~F.col("rating_avg").between(0, 5), F.lit("Invalid rating average")))
    return F.array_compact(F.array(*checks))


def review_errors() -> Column:
    missing = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit(f"Missing required field: {c}"))
    checks = [missing(c) for c in ("review_id", "product_id", "site", "rating")]
    checks.append(F.when(~F.col("rating").between(1, 5), F.lit("Invalid rating")))
    checks.append(F.when(~F.col("language").isin("fr", "en", "other"), F.lit("Invalid language")))
    return F.array_compact(F.array(*checks))
