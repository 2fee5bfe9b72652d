"""Crawl rules: robots files to rules, and rules to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that rules hold after they were read.
TTL = 3600


def parse(files: DataFrame) -> DataFrame:
    """(domain, content) to (domain, allow, disallow, crawl_delay) of the sections for the agents `*` and `bot`, by
    exactly these names. The agent of a line is the last one named above it; lines above any count for all. Of several
    delays the last that is a number holds. An empty rule stays: it matches nothing."""
    lines = files.select("domain", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", r"\r", ""))
    split = F.regexp_extract(line, r"^([^:#]*):(.*)$", 1)
    parts = lines.select(
        "domain", "pos", F.lower(F.trim(split)).alias("field"), F.trim(F.regexp_extract(line, r"^([^:#]*):(.*)$", 2)).alias("value")
    ).where("field <> ''")
    agent = F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("domain").orderBy("pos"))
    told = parts.withColumn("agent", F.coalesce(agent, F.lit("*"))).where("agent in ('*', 'bot')")
    of = lambda field: F.array_sort(F.collect_set(F.when(F.col("field") == field, F.col("value"))))
    number = F.when(F.col("field") == "crawl-delay", F.expr("try_cast(value as double)"))
    delay = F.max(F.when(number.isNotNull(), F.struct("pos", number.alias("delay"))))["delay"]
    return told.groupBy("domain").agg(of("allow").alias("allow"), of("disallow").alias("disallow"), delay.alias("crawl_delay"))


def matches(path: Column, rule: Column) -> Column:
    """A rule with "*" is a pattern anchored at the start; others are prefixes; the empty rule matches nothing."""
    pattern = F.concat(F.lit("^"), F.replace(rule, F.lit("*"), F.lit(".*")))
    return F.when(rule == "", False).when(F.contains(rule, F.lit("*")), F.rlike(path, pattern)).otherwise(F.startswith(path, rule))


def allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Any disallow rule that matches forbids; where there are allow rules, one must match."""
    no = F.coalesce(F.exists(disallow, lambda r: matches(path, r)), F.lit(False))
    some = F.coalesce(F.size(allow), F.lit(0)) > 0
    yes = F.coalesce(F.exists(allow, lambda r: matches(path, r)), F.lit(False))
    return ~no & (~some | yes)


def at_fetch(requests: DataFrame, versions: DataFrame, ttl_s: int = TTL) -> DataFrame:
    """requests (domain, ts, ..) with `rules`: the latest of versions (domain, fetched_at, rules) that was read at or before
    the request, if less than ttl_s before it; null where there is none, which allows everything. Versions of one time
    and domain: the greatest. Null domains and times have no rules.

    Time is dealt to bins of ttl_s; a version stands in its own bin and the next, which covers its life. So the order
    is taken by domain and bin: a domain with most of the requests is as many tasks' as it has bins."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ltz"))
    life = ttl_s * 1_000_000
    bin_of = lambda c: F.floor(F.col(c) / life).cast("bigint")
    told = versions.groupBy("domain", micros("fetched_at").alias("_at")).agg(F.max("rules").alias("rules")).where("domain is not null and _at is not null")
    told = told.select("domain", "_at", F.explode(F.array(bin_of("_at"), bin_of("_at") + 1)).alias("_bin"), F.lit(0).alias("_kind"), F.struct("_at", "rules").alias("_v"))
    asked = requests.withColumn("_at", micros("ts"))
    names = [c for c in requests.columns if c != "domain"]
    rows = asked.select("domain", "_at", bin_of("_at").alias("_bin"), F.lit(1).alias("_kind"), F.struct(*names).alias("_r"))
    both = told.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy("domain", "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1")
    rules = F.when(F.col("_at") - F.col("_last._at") < life, F.col("_last.rules"))
    return last.select("domain", "_r.*", rules.alias("rules"))
