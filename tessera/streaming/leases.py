"""Leases as keyed state of a stream: claims in the order of their times, and expiry by timers.

The table form (`state.claim_leases`) decides one claim a lease at one time. Here every lease holds
its row in the state store, claims are decided as they come, and a timer gives a lease up once it
can no longer be reused, whether or not anyone asks for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUESTS = "lease_id long, request_id long, at timestamp, state string, expires_at timestamp, uri string"
DECISIONS = "lease_id long, request_id long, at long, uri string, outcome string"
NEVER = 2**62
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeaseProcessor(StatefulProcessor):
    """Holds for each lease_id its row and when it ceases to be reusable; times are microseconds, so no time zone has a part in it."""

    def __init__(self, pending_minutes: int, margin_minutes: int):
        self.pending, self.margin = pending_minutes * 60_000_000, margin_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "until long, uri string")

    def until(self, state: str | None, at: int, expires: int) -> int:
        """The microsecond from which a lease made at `at` is no longer reusable."""
        if state not in ("pending", "active"):
            return -NEVER
        lasts = NEVER if expires == NEVER else expires - self.margin
        return min(lasts, at + self.pending) if state == "pending" else lasts

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at_us", "request_id"])
        held = before = self.held.get() if self.held.exists() else None
        out = []
        for r in asked.itertuples():
            reused = held is not None and r.at_us < held[0]
            if not reused:
                held = (self.until(r.state, r.at_us, r.expires_us), r.uri)
            out.append((key[0], r.request_id, r.at_us, held[1], "reused" if reused else "claimed"))
        if held is not before:
            self.held.update(held)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if abs(held[0]) < NEVER:
                self.handle.registerTimer(-(-held[0] // 1000))
        yield pd.DataFrame(out, columns=["lease_id", "request_id", "at", "uri", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, uri = self.held.get()
        self.held.clear()
        yield pd.DataFrame([(key[0], None, until, uri, "expired")], columns=["lease_id", "request_id", "at", "uri", "outcome"]).astype({"request_id": "Int64"})

    def close(self) -> None:
        pass


@contextmanager
def keyed_store(spark: SparkSession):
    """The state store that keyed state with timers needs, for queries started inside; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def lease_decisions(requests: DataFrame, *, pending_minutes: int = 15, margin_minutes: int = 120, late: str = "0 seconds") -> DataFrame:
    """For each request of a stream (REQUESTS) `claimed` or `reused` with the uri that holds then, and for each lease that ran out `expired`.

    A lease can be reused while it is active, or pending for less than `pending_minutes`, and its expiry
    (null: never) is more than `margin_minutes` away; else the request's own row takes its place. Requests of one
    batch are taken by (at, request_id), batches as they come; one later than the watermark allows is dropped by Spark, so
    set `late` to how far requests may be behind. Expiry is a timer on the watermark: `at` is then when the lease ran out. The
    requests of one lease within one batch are held together, which the source's batch size bounds. Nulls: a request
    without lease_id is a lease of its own; without `at` it is never late and comes last in its batch. Start the query within `keyed_store`.
    """
    times = {"at_us": F.coalesce(F.unix_micros("at"), F.lit(NEVER)), "expires_us": F.coalesce(F.unix_micros("expires_at"), F.lit(NEVER))}
    marked = requests.withWatermark("at", late).withColumns(times)
    decided = marked.groupBy("lease_id").transformWithStateInPandas(LeaseProcessor(pending_minutes, margin_minutes), DECISIONS, "append", "EventTime")
    return decided.withColumn("at", F.timestamp_micros(F.nullif(F.col("at"), F.lit(NEVER))))
