"""Exact percentiles and neighbours in a global order, without a task that holds a group or the whole order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketches that bound a rank (its error is a share of 1 / ACCURACY of the group); how many such errors
#: an interval reaches to either side; ranges that an order is dealt to.
ACCURACY, MARGIN, RANGES = 10_000, 3, 64


def name(p: int) -> str:
    return f"p{p}"


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)], F.lit(True))


def percentiles(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[int], *more: Column, accuracy: int = ACCURACY) -> DataFrame:
    """(*by, *more, p25, ...) for each group: `percentile(value, p / 100)` of all its values, interpolated, and the
    aggregates `more`. Null values do not count; a group without values has nulls.

    A mergeable sketch of each group bounds the values at the ranks asked for. Then one pass counts: values within the
    bounds one by one, those between them as one, so that of a group about 2 * MARGIN / accuracy of its values for each
    percentile are left when its ranks are looked up, in order. A rank outside its bounds, which the sketch rules out,
    raises an error; it gives no wrong value."""
    by = list(by)
    keys = [f"_by_{c}" for c in by]
    x = F.col(value).cast("double")
    error = MARGIN / accuracy
    low, high = ([min(1.0, max(0.0, p / 100 + s * error)) for p in ps] for s in (-1, 1))
    inf = float("inf")
    sketch = lambda at: F.percentile_approx(x, at, accuracy)
    first = df.groupBy(*by).agg(*more, F.count(x).alias("_n"), sketch(low).alias("_low"), sketch(high).alias("_high"))
    few = F.col("_n") <= accuracy  # an error is less than a rank there; all values are counted one by one
    open_low = F.array(*[F.lit(-inf) if q == 0 else F.when(few, -inf).otherwise(F.get("_low", F.lit(i))) for i, q in enumerate(low)])
    open_high = F.array(*[F.lit(inf) if q == 1 else F.when(few, inf).otherwise(F.get("_high", F.lit(i))) for i, q in enumerate(high)])
    bounds = first.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], open_low.alias("_low"), open_high.alias("_high"))

    rows = df.where(x.isNotNull()).select(*by, x.alias("_x")).join(bounds, _same(by, keys))
    inside = reduce(lambda a, b: a | b, [F.col("_x").between(F.get("_low", F.lit(i)), F.get("_high", F.lit(i))) for i in range(len(ps))])
    # a value outside all bounds counts as the highest bound below it
    below = F.array_max(F.filter("_high", lambda h: h < F.col("_x")))
    counted = rows.select(*by, inside.alias("_in"), F.when(inside, F.col("_x")).otherwise(F.coalesce(below, F.lit(-inf))).alias("_v"))
    counted = counted.groupBy(*by, "_v", "_in").agg(F.count(F.lit(1)).alias("_c"))

    order = Window.partitionBy(*by).orderBy("_v", F.desc("_in"))
    ranked = counted.withColumn("_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = first.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "_n")
    ranked = ranked.join(total, _same(by, keys)).withColumn("_from", F.col("_to") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.struct(F.col("_in").alias("sure"), F.col("_v").alias("v"))))

    found, picked = [], []
    for p in ps:
        place = F.lit(p / 100) * (F.col("_n") - 1).cast("double")
        lo, hi = F.floor(place), F.ceil(place)
        found += [at(lo).alias(f"_lo{p}"), at(hi).alias(f"_hi{p}")]
        a, b = F.col(f"_lo{p}"), F.col(f"_hi{p}")
        sure = F.when(~(a["sure"] & b["sure"]), F.raise_error(F.lit("a rank lies outside its bounds")).cast("double"))
        between = F.when((lo == hi) | (a["v"] == b["v"]), a["v"]).otherwise((hi - place) * a["v"] + (place - lo) * b["v"])
        picked.append(F.when(a.isNotNull(), F.coalesce(sure, between)).alias(name(p)))
    ranks = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *found).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *picked)
    kept = [c for c in first.columns if c not in ("_n", "_low", "_high")]
    return first.join(ranks, _same(by, keys), "left").select(*kept, *[name(p) for p in ps])


def with_next(df: DataFrame, value: str, to: str, ranges: int = RANGES) -> DataFrame:
    """df, of distinct values, with `to`: the next higher value of all, null at the highest.

    Values are dealt to ranges that begin at values of the table, which a sketch picks; RANGES numbers at most come to the
    driver. So the value after the last of a range is where the next one begins: no task sees the whole order. Null
    values have none and are the next of none."""
    steps = [i / ranges for i in range(1, ranges)]
    first = df.agg(F.min(value).alias("low"), F.percentile_approx(F.col(value), steps, ACCURACY).alias("starts")).first()
    if first["low"] is None:
        return df.withColumn(to, F.lit(None).cast(df.schema[value].dataType))
    starts = F.array(*[F.lit(v) for v in sorted({first["low"], *first["starts"]})])
    at = F.size(F.filter(starts, lambda s: s <= F.col(value)))
    inside = F.lead(value).over(Window.partitionBy("_range").orderBy(value))
    known = F.col(value).isNotNull()
    return df.withColumn("_range", F.when(known, at)).withColumn(to, F.when(known, F.coalesce(inside, F.get(starts, F.col("_range"))))).drop("_range")
