"""Mixing sources to target weights by entropy balancing.

Each source gets a target number of words. A document of a source is repeated at the rate 2 / (1 + exp(-t * x)), x
its size over the source's mean size: the solution of the bounded entropy problem "stay as near to one copy each as
you can, at most two, and meet the token constraint", whose convex dual has one variable t per source. Newton's
method solves all duals at once, each iteration one distributed aggregation over distinct (source, size) pairs;
systematic rounding along the sizes turns rates into copies. DataFrame operations only. The running sums of a source
are taken within ranges of sizes, then over the ranges, so that a hot source is dealt out; the rows that meet in one
place are its ranges, as many as the longest text has of them, and for the targets one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.common import cut, drop_cut, few, words

#: Weights of the sources in their order, repeating; share of all sizes to take; the most of a source that can be.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
ITERATIONS, TOLERANCE, SALTS, STARTS = 60, 1e-6, 64, 64
#: Binary digits of the sizes that a range holds.
RANGE = 5
#: Beyond this tilt the rates no longer change.
FLAT = 1e6
#: Rows up to which the table of copies, some 30 bytes each, is broadcast to the texts.
FEW = 500_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source (source, source_size, ...) with its target added: the weighted share, where it exceeds
    `most` times the source's size cut to that and the excess dealt to the others by weight, until none is above."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    cap = most * F.col("source_size")
    # A source is full once the water reaches cap / weight. In that order, each level supposes that all before are full;
    # the water stands at the first level that its own source still holds.
    ranked = ranked.withColumn("weight", pick).withColumn("cap", cap).withColumn("full_at", cap / pick)
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = min(share, most) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / weight_left)
    held = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(everything)
    return (
        leveled.withColumn("water", held["level"])
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("water")), F.col("cap")))
        .drop("rank", "weight", "cap", "full_at", "level", "water")
    )


def _rate(most: float):
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("t") * F.col("size") / F.col("mean")))
    return most / (1.0 + F.exp(-z))


def tilts(pairs: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """Newton's method on the duals. pairs: (key, size, n); goals: one row per source (key, source_size, mean, target).
    Adds t. A target of nothing or of all there is has no finite tilt: t is then -FLAT or FLAT. Raises if a target is
    not met."""
    solid = most * F.col("source_size")
    t0 = F.when(F.col("target") <= 0, -FLAT).when(F.col("target") >= solid * (1 - 1e-12), FLAT).otherwise(0.0)
    state = cut(goals.withColumns({"t": t0, "lo": F.lit(-FLAT), "hi": F.lit(FLAT), "off": F.lit(1.0)}))
    r = _rate(most)
    for _ in range(ITERATIONS):
        open_ = state.where(F.abs("t") < FLAT)
        sums = (
            pairs.join(open_.select("key", "t", "mean"), "key")
            .groupBy("key")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("got"),
                F.sum(F.col("n") * F.col("size") * r * (1 - r / most) * F.col("size") / F.col("mean")).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        step = F.col("t") - gap / F.greatest("slope", F.lit(1e-300))
        bounded = (  # a Newton step that leaves the bracket gives way to a longer or a halved one inside
            F.when((step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step - F.col("t")) < 64), step)
            .when(gap < 0, F.least(F.col("t") + 16, (F.col("t") + F.col("hi")) / 2))
            .otherwise(F.greatest(F.col("t") - 16, (F.col("t") + F.col("lo")) / 2))
        )
        new = cut(
            state.drop("off")
            .join(sums, "key", "left")
            .withColumn("off", F.coalesce(F.abs(gap) / F.greatest("target", F.lit(1.0)), F.lit(0.0)))
            .withColumn("lo", F.when(gap < 0, F.col("t")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(gap > 0, F.col("t")).otherwise(F.col("hi")))
            .withColumn("t", F.when(F.col("off") > TOLERANCE, bounded).otherwise(F.col("t")))
            .drop("got", "slope")
        )
        drop_cut(state)
        state = new
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            return state.drop("lo", "hi", "off")
    raise ArithmeticError(f"the tilts did not meet their targets within {ITERATIONS} iterations")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, text: str = "text", sized: str | None = None
) -> DataFrame:
    """docs (doc_id, source, text, ...), the text in the column or field `text`, with size (words of the text),
    source_size, target and copies (0 to 2) added; existing columns of these names are replaced. sized: a column that
    has the sizes already.

    Null text: size 0, never taken. Null source: a source of its own, last in the order. All sizes 0: all targets 0.
    Rows that repeat are documents of their own and may get different copies; ties in size are broken by a hash of
    doc_id. Reruns agree, but for rows that repeat a doc_id, which may swap copies. Whole texts count, however long. An
    empty table gives no rows.
    """
    added = ("size", "source_size", "target", "copies")
    base = docs.select([c for c in docs.columns if c not in added])
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    # "key" and what follows it never leave this function; a prefix keeps them clear of the caller's columns
    sized = base.withColumns({
        "__key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")),
        "size": F.col(sized) if sized else F.size(words(F.col(text))).cast("bigint"),
        "__salt": salt,
    })
    cells = cut(sized.groupBy(F.col("__key").alias("key"), "size", F.col("__salt").alias("salt")).agg(F.count(F.lit(1)).alias("n")))
    pairs = cut(cells.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n")))
    per = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    per = per.withColumn("source", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)))
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    goals = targets(per.withColumn("mean", mean), weights, share, most).select("key", "source_size", "mean", "target")
    solved = tilts(pairs, goals, most)
    # Systematic rounding: rates summed along (size, salt) within a source; a document gets the whole numbers it passes.
    rated = cut(
        cells.join(solved, "key")
        .withColumn("rate", F.when(F.col("size") > 0, _rate(most)).otherwise(0.0))
        .select("key", "size", "salt", "n", "source_size", "target", "rate", F.shiftright("size", RANGE).alias("range"))
    )
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rated.groupBy("key", "range").agg(F.sum(F.col("n") * F.col("rate")).alias("all"))
    ranges = ranges.select("key", "range", F.coalesce(F.sum("all").over(earlier), F.lit(0.0)).alias("before"))
    run = Window.partitionBy("key", "range").orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    own = rated.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(run), F.lit(0.0)))
    placed = cut(own.join(ranges, ["key", "range"]).withColumn("start", F.col("start") + F.col("before")).drop("range", "before"))
    # Where the count starts is free: of some starts, each source takes the one whose words come nearest its target.
    starts = [(k + 0.5) / STARTS for k in range(STARTS)]
    took = lambda s: F.sum(F.col("size") * (F.floor(F.col("start") + s + F.col("n") * F.col("rate")) - F.floor(F.col("start") + s)))
    took = placed.where("size > 0").groupBy("key").agg(F.first("target").alias("target"), *[took(s).alias(f"took_{k}") for k, s in enumerate(starts)])
    off = F.array(*[F.struct(F.abs(F.col(f"took_{k}") - F.col("target")).alias("off"), F.lit(s).alias("shift")) for k, s in enumerate(starts)])
    best = took.select("key", F.array_min(off)["shift"].alias("shift"))
    placed = placed.join(best, "key", "left").select(
        F.col("key").alias("__key"), "size", F.col("salt").alias("__salt"), "source_size", "target", F.col("rate").alias("__rate"),
        (F.col("start") + F.coalesce("shift", F.lit(0.5))).alias("__start"),
    )
    within = Window.partitionBy("__key", "size", "__salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    ranked = sized.withColumn("__rank", F.row_number().over(within))
    at = lambda k: F.floor(F.col("__start") + k * F.col("__rate"))
    passed = at(F.col("__rank")) - at(F.col("__rank") - 1)
    return (
        ranked.join(placed, ["__key", "size", "__salt"])
        .withColumn("copies", F.least(passed, F.lit(int(most))).cast("int"))
        .select(*base.columns, *added)
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the query's view of mix(). Words are counted once; no text is carried."""
    sized = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("words")))
    return mix(sized, sized="words").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_copies(docs: DataFrame) -> DataFrame:
    """docs with each row as often as mix() takes it; all its columns stay, whatever their names.

    What is ranked and counted are two hashes of each row and its size; texts move once at most, to the number of their
    copies. Rows that are equal in all columns are one, with the copies of all. Rules for nulls, ties and empty tables as in mix().
    """
    told = [F.col(f"`{c}`") for c in docs.columns]
    told += [c.isNull() for c in told]
    both = [F.xxhash64(F.lit(k), *told).alias(f"__h{k}") for k in (1, 2)]
    narrow = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("__words"), *both))
    keys = ["__h1", "__h2"]
    totals = mix(narrow, sized="__words").groupBy(*keys).agg(F.sum("copies").cast("int").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    totals = cut(totals.where("__n > 0"))
    one, several = totals.where("__rows = 1"), totals.where("__rows > 1")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *both)
    rows = whole.join(few(one, FEW), keys).select("__row", "__n")
    if not several.isEmpty():
        rows = rows.unionByName(whole.join(few(several, FEW), keys).groupBy(*keys).agg(F.first("__row").alias("__row"), F.first("__n").alias("__n")).drop(*keys))
    return rows.select("__row", F.explode(F.sequence(F.lit(1), "__n")).alias("__copy")).select("__row.*")
