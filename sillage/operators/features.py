"""The feature matrix: behaviour, price, sustainability, luxury and text blocks by product."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of the text block; documents that a term needs; components of its reduction.
TERMS, LEAST, COMPONENTS = 100, 2, 20
#: Letters of a body that order reviews of one id.
TIE = 256
#: Words that say nothing of a text.
STOP_WORDS = tuple(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing"
    " down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more"
    " most my no nor not now of off on once only or other our out over own same she so some such than that the their them then there"
    " these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)


def behaviour(reviews: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return reviews.groupBy("product_id").agg(
        F.count("rating").alias("review_count"), zero(F.avg("rating")).alias("rating_mean"), zero(F.stddev_samp("rating")).alias("rating_std"),
        zero(F.avg("helpful_count")).alias("helpful_mean"), zero(F.avg(F.col("verified_purchase").cast("int"))).alias("verified_ratio"),
        F.avg(F.when(F.col("language") == "fr", 1.0).otherwise(0.0)).alias("fr_ratio"),
    )


def price(products: DataFrame, as_of: str) -> DataFrame:
    """Prices against their category's; moments are aggregated and joined, so a category of many rows is not one task's."""
    rows = products.withColumn("category", F.get("category_path", F.lit(0)))
    moments = rows.groupBy(F.col("category").alias("of")).agg(F.avg("price_value").alias("m"), F.stddev_samp("price_value").alias("s"))
    z = F.try_divide(F.col("price_value") - F.col("m"), F.nullif("s", F.lit(0.0)))
    return rows.join(moments, F.expr("category <=> of")).select(
        "product_id", "price_value", F.coalesce(z, F.lit(0.0)).alias("price_z"),
        F.coalesce(F.try_divide("price_value", F.nullif("size_ml_or_g", F.lit(0.0))), F.lit(0.0)).alias("price_per_unit"),
        F.datediff(F.lit(as_of).cast("date"), "first_seen_ts").alias("newness_days"), F.lit(1.0).alias("availability_rate"),
        F.coalesce("size_ml_or_g", F.lit(0.0)).alias("size"),
    )


def sustainability(products: DataFrame) -> DataFrame:
    flag = F.when(F.col("refillable_flag"), 1.0).otherwise(0.0)
    shares = products.groupBy(F.col("brand").alias("of")).agg(F.avg(flag).alias("share"))
    return products.join(shares, F.expr("brand <=> of")).select(
        "product_id", flag.alias("refillable"), F.col("share").alias("brand_refill_share"),
        F.coalesce(F.size("refill_evidence"), F.lit(0)).alias("eco_badge_count"),
    )


def luxury(classified: DataFrame) -> DataFrame:
    tier = F.when(F.col("brand_tier") == "1", 1.0).when(F.col("brand_tier") == "1.5", 1.5).otherwise(0.0)
    return classified.select("product_id", F.col("is_luxury").cast("int").alias("luxury_flag"), tier.alias("tier_value"))


def numeric(df: DataFrame, but: tuple[str, ...] = ("product_id",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def matrix(products: DataFrame, classified: DataFrame, reviews: DataFrame, as_of: str, texts: DataFrame | None = None) -> DataFrame:
    """All numeric blocks, standardised by the population deviation; constant columns are 0. One aggregation gives the
    moments of all columns. Without texts there is no text block."""
    joined = price(products, as_of)
    text = [] if texts is None else text_block(texts)
    for block in (behaviour(reviews), sustainability(products), luxury(classified), *text):
        joined = joined.join(block, "product_id", "left")
    names = numeric(joined)
    filled = joined.select("product_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    moments = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}"))), F.lit(0.0))
    return filled.crossJoin(F.broadcast(moments)).select("product_id", *[scaled(c).alias(c) for c in names])  # moments: one row


def product_text(texts: DataFrame) -> DataFrame:
    """The French texts of a product in review order, cleaned. Reviews are sorted by product and streamed: a task holds
    one product's text, which is the value that it returns."""
    from sillage.functions.scalars import clean_text

    id_type = texts.schema["product_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ids, done, size = None, [], [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, first), pa.array(done, pa.string())], names=["product_id", "text"])

        for b in batches:
            first = b.column(0).type
            for product, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is not None and now[0] != product:
                    ids.append(now[0])
                    done.append(" ".join(parts))
                    size, parts = size + len(done[-1]), []
                    if size > 1 << 20:
                        yield block()
                        ids, done, size = [], [], 0
                now = (product,)
                if text is not None:
                    parts.append(text)
        if now is not None:
            ids.append(now[0])
            done.append(" ".join(parts))
            yield block()

    french = texts.where("language = 'fr'").select("product_id", "review_id", "body")
    rows = french.repartition("product_id").sortWithinPartitions("product_id", "review_id", "body").select("product_id", "body")
    return rows.mapInArrow(run, f"product_id {id_type}, text string").select("product_id", clean_text(F.col("text")).alias("text"))


def terms(texts: DataFrame) -> DataFrame:
    """(product_id, review_id, body, language) to (product_id, term, n): words of two letters or more that are no stop
    words, and pairs of neighbours, in the French reviews of a product in their order.

    Words and pairs are counted review by review; the pair over the seam of two reviews is the last word of one and the
    first of the next that has any, so only these two words of a review are put in order."""
    from sillage.functions.scalars import clean_text

    words = F.filter(F.split(clean_text(F.col("body")), r"(?U)[^\w]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    split = texts.where("language = 'fr'").select("product_id", "review_id", "body", words.alias("w")).where(F.size("w") > 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    both = F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))
    ends = split.select("product_id", "review_id", F.substring("body", 1, TIE).alias("body"), F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last"))
    before = F.lag("last").over(Window.partitionBy("product_id").orderBy("review_id", "body"))
    seams = ends.select("product_id", F.concat(before, F.lit(" "), F.col("first")).alias("term")).where("term is not null")
    return split.select("product_id", F.explode(both).alias("term")).unionByName(seams).groupBy("product_id", "term").agg(F.count(F.lit(1)).alias("n"))


def tfidf(texts: DataFrame, most: int = TERMS, least: int = LEAST) -> DataFrame:
    """(product_id, term, weight): the `most` terms by total count (ties by name) among those of `least` products,
    count times ln((1 + products) / (1 + products with it)) + 1, rows of unit length."""
    counts = terms(texts)
    kept = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    kept = kept.orderBy(F.desc("total"), "term").limit(most)
    total = texts.where("language = 'fr'").agg(F.count_distinct("product_id").alias("docs"))
    raw = counts.join(F.broadcast(kept), "term").crossJoin(F.broadcast(total))  # `most` rows, and one
    weighted = raw.select("product_id", "term", (F.col("n") * (F.ln((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("product_id")))
    return weighted.select("product_id", "term", (F.col("w") / norm).alias("weight"))


def text_components(weights: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Centred principal components of the term weights; the weights themselves if there are no more than k terms."""
    names = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]  # TERMS at most
    wide = weights.groupBy("product_id").pivot("term", names).agg(F.first("weight"))
    vector = array_to_vector(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in names]))
    rows = wide.select("product_id", vector.alias("raw"))
    if len(names) <= k:
        return rows.select("product_id", vector_to_array("raw").alias("components"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows).transform(rows)
    out = PCA(k=k, inputCol="centred", outputCol="components").fit(centred).transform(centred)
    return out.select("product_id", vector_to_array("components").alias("components"))


def text_block(texts: DataFrame) -> list[DataFrame]:
    """(product_id, txt_dim_00, ...) from the French texts; none if these have no terms."""
    weights = tfidf(texts).cache()
    if weights.isEmpty():
        return []
    components = text_components(weights)
    k = min(COMPONENTS, weights.select("term").distinct().count())
    return [components.select("product_id", *[F.get("components", F.lit(i)).alias(f"txt_dim_{i:02d}") for i in range(k)])]


def as_vector(df: DataFrame, names: list[str]) -> Column:
    return array_to_vector(F.array(*[F.col(c).cast("double") for c in names]))
