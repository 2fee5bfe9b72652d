"""Which keywords a text contains, by an index of q-grams: no comparison of every text with every keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram. Shorter keywords are a gram of their own length.
GRAM = 3
#: Keywords up to which their index is broadcast, some 100 bytes each.
FEW = 500_000


def _sided(df: DataFrame, n: int) -> DataFrame:
    """The side of a join that has n rows of keywords: broadcast if few, else both sides are sorted. Texts are never
    broadcast, whatever the planner takes their grams for: compressed files of many texts can be small."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct grams of a text; none if it is shorter."""
    last = F.length(text) - size + 1
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def hits(texts: DataFrame, key: str, text: str, keywords: DataFrame, keyword: str, gram: int = GRAM) -> DataFrame:
    """(key, *columns of keywords): a row for each row of texts and each row of keywords that it contains, case as it is.

    Of each keyword one gram stands in the index, the one that the fewest keywords have, so no gram leads to many of
    them; texts meet keywords by an equi-join on their grams, and pairs that meet are compared. Neither side need be small:
    up to FEW keywords, which are counted first, go to the texts; beyond that both sides are sorted, and a gram that many
    texts have is a skewed key, which adaptive execution splits. Keys are distinct. Null texts contain
    nothing; null and empty keywords are contained by none; repeated keywords count each."""
    words = keywords.where((F.col(keyword).isNotNull()) & (F.col(keyword) != ""))
    n, size = words.count(), F.least(F.length(keyword), F.lit(gram))
    distinct = words.select(F.col(keyword).alias("_word"), size.alias("_size")).distinct()
    every = distinct.select("_word", "_size", F.explode(_grams(F.col("_word"), F.col("_size"))).alias("_gram"))
    common = every.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    index = every.join(common, "_gram").groupBy("_word").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))

    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    parts = F.flatten(F.array(*[_grams(F.col("_text"), n) for n in range(1, gram + 1)]))
    met = rows.select("_key", "_text", F.explode(parts).alias("_gram")).join(_sided(index, n), "_gram").where(F.contains("_text", "_word"))
    return met.select("_key", "_word").join(_sided(words, n), F.col("_word") == F.col(keyword)).select(F.col("_key").alias(key), *keywords.columns)


def containing(texts: DataFrame, key: str, text: str, keywords: DataFrame, keyword: str, gram: int = GRAM) -> DataFrame:
    """The rows of texts that contain any of the keywords, with all their columns, by the same index."""
    found = hits(texts, key, text, keywords.select(keyword).distinct(), keyword, gram).select(key).distinct()
    return texts.join(found.hint("merge"), key, "left_semi")  # as many rows as texts, perhaps
