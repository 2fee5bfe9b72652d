"""Pacing and dedup over streams of fetch events: the stateful forms of J1 and J4."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sillage.operators.pacing import BLOCKED, ERRORS, HIGH, LOOK_BACK, LOW, RAISE, START


def step(rate: float, window: list[int], status: int) -> tuple[float, list[int]]:
    """The rate and the window of errors after one more request."""
    window = [*window, int(status in BLOCKED)][-LOOK_BACK:]
    if sum(window) >= ERRORS:
        return max(LOW, rate / 2), window
    if sum(window) == 0 and len(window) >= LOOK_BACK:
        return min(HIGH, rate * RAISE), window
    return rate, window


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rate, seen, window = state.get if state.exists else (START, 0, [])
    window = list(window)
    for f in frames:
        for status in f.sort_values(["ts", "event_id"])["status"]:
            rate, window = step(rate, window, status)
            seen += 1
    state.update((rate, seen, window))
    yield pd.DataFrame({"domain_id": [key[0]], "requests": [seen], "rps": [rate]})


def adaptive_rates(log: DataFrame) -> DataFrame:
    """A stream of (domain_id, ts, event_id, status) to the rate of each domain after each batch."""
    return log.groupBy("domain_id").applyInPandasWithState(
        _update, "domain_id bigint, requests bigint, rps double", "rps double, requests bigint, window array<int>", "update", GroupStateTimeout.NoTimeout
    )


def unseen(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream without the rows whose key came before, as far back as events may be late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def domain_counts(log: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Requests and errors of each domain by time window."""
    by = log.withWatermark("ts", late).groupBy(F.window("ts", width), "domain_id")
    return by.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status").isin(*BLOCKED)).alias("errors"))
