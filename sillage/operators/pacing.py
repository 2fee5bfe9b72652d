"""Request pacing as ordered folds over each domain's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statuses looked back on, errors that halve the rate, bounds and start of the rate, factor of recovery.
LOOK_BACK, ERRORS, LOW, HIGH, START, RAISE = 20, 3, 0.1, 1.0, 0.5, 1.2
BLOCKED = (403, 429, 503)


def error_window(log: DataFrame) -> DataFrame:
    """Errors and requests among the last LOOK_BACK of each domain, at each request."""
    by = Window.partitionBy("domain_id").orderBy("ts", "event_id")
    last = by.rowsBetween(1 - LOOK_BACK, 0)
    error = F.when(F.col("status").isin(*BLOCKED), 1).otherwise(0)
    return log.select(
        "domain_id", "event_id", "ts", F.sum(error).over(last).alias("errors"), F.count(F.lit(1)).over(last).alias("seen"), F.row_number().over(by).alias("step")
    )


def adaptive_rate(log: DataFrame) -> DataFrame:
    """The rate of each domain after its last request: halved at each request with ERRORS errors or more in the
    window, raised at each with none in a full window, within bounds. Window counts are computed first; what is folded
    per domain is one small array of codes."""
    code = F.when(F.col("errors") >= ERRORS, -1).when((F.col("errors") == 0) & (F.col("seen") >= LOOK_BACK), 1).otherwise(0)
    steps = error_window(log).select("domain_id", "step", code.alias("code"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step", "code"))), lambda s: s.code)
    fold = F.aggregate(
        "codes", F.lit(START),
        lambda r, c: F.when(c == -1, F.greatest(F.lit(LOW), r / 2)).when(c == 1, F.least(F.lit(HIGH), r * RAISE)).otherwise(r),
    )
    return steps.groupBy("domain_id").agg(ordered.alias("codes")).select("domain_id", F.size("codes").alias("requests"), F.round(fold, 6).alias("rps"))


def send_times(log: DataFrame, gap_us: int = 2_000_000) -> DataFrame:
    """When each request may be sent if a domain's requests are `gap_us` apart at least: the running maximum of
    arrival - i * gap, plus i * gap, which is the closed form of send = max(arrival, send before + gap)."""
    by = Window.partitionBy("domain_id").orderBy("ts", "event_id")
    i = (F.row_number().over(by) - 1) * gap_us
    arrived = log.select("domain_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("arrival"), "ts").withColumn("i", i)
    sent = F.max(F.col("arrival") - F.col("i")).over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i")
    return arrived.select("domain_id", "event_id", "arrival", sent.alias("send"), (sent - F.col("arrival")).alias("wait"))
