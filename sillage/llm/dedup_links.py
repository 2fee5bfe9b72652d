"""Links from buckets: the part that the near-duplicate operators share.

Items that may be alike meet in buckets. Emitting all pairs of a bucket grows with its square, so a bucket's members
are first held against one leader. What links to the leaders is then connected, and only pairs of different components
are compared further, of which one side at least is outside its bucket's largest component. The components are those of all links among items that share a bucket: nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.llm.common import components, cut

Near = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


#: Members of a hot bucket's largest component that the others are held against before they are among each other.
PICKS = 8


def _picked(members: DataFrame, comps: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame], hot: int) -> DataFrame | None:
    """Links of members of hot buckets to some of their bucket's largest component; None if no bucket is hot."""
    extra = [c for c in members.columns if c not in ("id", "key")]
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key")
    many = cut(members.join(large, "key", "left_semi"))
    if many.isEmpty():
        return None
    own = many.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top")).where("top.n > 1").select("key", F.col("top.comp").alias("big"))
    own = cut(own.join(top, "key"))
    order = F.xxhash64("id")
    pick = own.where("comp = big").groupBy("key", F.pmod(order, F.lit(PICKS))).agg(F.min(F.struct(order, "id", *extra)).alias("p"))
    pick = pick.select("key", F.col("p.id").alias("lead"), *[F.col(f"p.{c}").alias(f"lead_{c}") for c in extra])
    met = own.where("comp <> big").join(pick, "key").where(near(lambda c: F.col(c), lambda c: F.col(f"lead_{c}")))
    return verify(met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())


def linked(
    members: DataFrame,
    near: Near,
    verify: Callable[[DataFrame], DataFrame],
    with_comp: Callable[[DataFrame], DataFrame],
    near_rest: Near | None = None,
    hot: int = 0,
    also: DataFrame | None = None,
    closer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components (id, comp) of the items that have links.

    members: (id, key, lead, ...) with the id of the item that leads the bucket, the columns that `near` compares and
    the lead's as lead_...; near(a, b): a condition that all linked pairs meet, over columns of either side; verify:
    (a, b) to the pairs among them that are links; with_comp: from (id, comp) to the members (id, key, comp, ...) of
    buckets of more than two, comp the id itself where that has none, with the columns of near_rest, a closer condition
    for pairs without a leader; hot: in buckets of more members than this, those outside the largest component are first
    held against PICKS members of it too (0: in none);
    also: further pairs (a, b) that may be links, which are verified together with the first of these; closer: from the
    ids that go on to pairs without a leader, to (id, ...) with further columns for near_rest.
    """
    extra = [c for c in members.columns if c not in ("id", "key") and not c.startswith("lead")]
    star = members.where((F.col("id") != F.col("lead")) & near(lambda c: F.col(c), lambda c: F.col(f"lead_{c}")))
    pairs = star.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    pairs = (pairs if also is None else pairs.unionByName(also)).distinct()
    comps = cut(components(verify(pairs)))

    def joined(comps: DataFrame, more: DataFrame) -> DataFrame:
        """comps with further links, each component a star."""
        more = cut(more)
        return comps if more.isEmpty() else components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))

    if hot:
        more = _picked(members.select("id", "key", *extra), comps, near, verify, hot)
        if more is not None:
            comps = cut(joined(comps, more))

    # Only buckets that hold several components go on; of those, the component with the most members is not compared
    # with itself.
    own = cut(with_comp(comps))
    mixed = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    own = cut(own.join(cut(mixed), "key", "left_semi"))
    if closer is not None:
        if own.isEmpty():
            return comps
        own = own.join(cut(closer(cut(own.select("id").distinct()))), "id")
    top = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", "n").alias("big"))
    own = cut(own.join(top, "key").withColumn("out", F.col("comp") != F.col("big")).drop("big"))
    left = own.where("out").select(*[F.col(c).alias(f"x_{c}") for c in own.columns if c != "key"], "key")
    right = own.select(*[F.col(c).alias(f"y_{c}") for c in own.columns if c != "key"], "key")
    rest = left.join(right, "key").where(
        (F.col("x_comp") != F.col("y_comp"))
        & (~F.col("y_out") | (F.col("x_id") < F.col("y_id")))
        & (near_rest or near)(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}"))
    )
    rest = rest.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    return joined(comps, verify(rest))
