"""Alerts kept as state per key, with bounded lists and event-time timers.

Beside the forms of ``alerts``: there, batches merge with a stored table, and an interval join
waits for later events. Here a job or an address owns a small state in the state store, and a
batch touches only the keys it brings or whose timers are due.
"""

from __future__ import annotations

import bisect
import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from faultline.functions.times import micros

# State processors travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a session must have when a stream of these operators starts; Spark's default store has no
# lists and timers.
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

# Before every time.
NEVER = -(1 << 63)
FAILURES = T.StructType().add("name", T.StringType()).add("failures", T.LongType())


class LastBuilds(StatefulProcessor):
    """The last ``n`` builds of a job, whatever came before; a job that is silent for ``ttl_ms``
    of processing time is forgotten, if that is set."""

    def __init__(self, n: int, ttl_ms: int | None = None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle) -> None:
        schema = T.StructType().add("at", T.LongType()).add("id", T.StringType()).add(
            "failed", T.BooleanType())
        self.kept = handle.getListState("kept", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        for part in rows:
            new = zip(part["at"].tolist(), part["id"].tolist(), part["failed"].tolist())
            kept = heapq.nlargest(self.n, [*kept, *new], key=lambda r: (
                r[0], r[1] is not None, r[1] or ""))
        self.kept.put(kept)
        yield pd.DataFrame({"name": [key[0]], "failures": [sum(bool(f) for _, _, f in kept)]})

    def close(self) -> None:
        pass


def sequential_failure_updates(builds: DataFrame, n: int = 3, failed: str = "FAILURE",
                               ttl_ms: int | None = None) -> DataFrame:
    """For every job that a batch brings builds of: the failures among its last ``n``. Equals the
    batch report whatever the order of the builds, as the newest are kept by their end; builds without
    an end count as the oldest."""
    ended = F.coalesce(micros(F.col("end_date")), F.lit(NEVER).cast("bigint"))
    rows = builds.select("name", ended.alias("at"), "id",
                         F.coalesce(F.col("result") == failed, F.lit(False)).alias("failed"))
    return rows.groupBy("name").transformWithStateInPandas(
        LastBuilds(n, ttl_ms), FAILURES, "Update", "ProcessingTime" if ttl_ms else "None")


ORPHANED = T.StructType().add("ip", T.StringType()).add("detached_at", T.TimestampNTZType())


class Unattached(StatefulProcessor):
    """The times an address was detached and waits to be attached again.

    A detach event is answered by an attach event after it and within the wait. What is not
    answered is given out by a timer, once the watermark has passed the wait. Attach events are
    kept until the watermark reaches them, since an earlier detach event may still come, so files
    may arrive in any order within the delay. Both lists hold no more than delay and wait span.
    """

    def __init__(self, wait_seconds: int):
        self.wait = wait_seconds * 1_000_000

    def init(self, handle) -> None:
        at = T.StructType().add("at", T.LongType())
        self.handle = handle
        self.detached = handle.getListState("detached", at)
        self.attached = handle.getListState("attached", at)

    def _load(self, state) -> list[int]:
        return [r[0] for r in state.get()] if state.exists() else []

    def _keep(self, state, times: list[int]) -> None:
        if times:
            state.put([(t,) for t in times])
        elif state.exists():
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        detached, attached = self._load(self.detached), self._load(self.attached)
        known = set(detached)
        for part in rows:
            back = part["kind"] == "attach"
            attached += part["at"][back].tolist()
            detached += part["at"][~back].tolist()
        if key[0] is None:
            # Nobody knows whether two events without address are of the same one.
            attached = []
        attached.sort()
        waiting = [d for d in detached if not self._answered(d, attached)]
        for d in set(waiting) - known:
            # The first whole millisecond after the wait.
            self.handle.registerTimer((d + self.wait) // 1000 + 1)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(self.detached, waiting)
        self._keep(self.attached, [a for a in attached if a > mark])
        # Nothing waits for these if no detach event does; a timer clears them.
        for a in attached[-1:]:
            self.handle.registerTimer(a // 1000 + 1)
        return iter(())

    def _answered(self, d: int, attached: list[int]) -> bool:
        i = bisect.bisect_right(attached, d)
        return i < len(attached) and attached[i] <= d + self.wait

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        detached = self._load(self.detached)
        due = sorted(d for d in detached if d + self.wait < mark)
        self._keep(self.detached, [d for d in detached if d + self.wait >= mark])
        self._keep(self.attached, [a for a in self._load(self.attached) if a > mark])
        if due:
            yield pd.DataFrame({"ip": pd.Series([key[0]] * len(due), dtype=object),
                                "detached_at": pd.to_datetime(pd.Series(due), unit="us")})

    def close(self) -> None:
        pass


def orphaned_ip_timers(events: DataFrame, *, wait_seconds: int = 120,
                       delay: str = "10 minutes") -> DataFrame:
    """Addresses that were detached and not attached again within the wait, each row as soon as the
    watermark has passed its wait. No events need be invented at the end of input: a row that is
    not due yet comes with the run that moves the watermark on. An event without time is never due."""
    timed = events.select("ip", "kind", F.col("event_time").cast("timestamp").alias("event_time"),
                          F.unix_micros(F.col("event_time").cast("timestamp")).alias("at"))
    marked = timed.filter("event_time IS NOT NULL").withWatermark("event_time", delay)
    known = marked.filter(F.col("kind").isin("attach", "detach"))
    return (known.groupBy("ip").transformWithStateInPandas(
        Unattached(wait_seconds), ORPHANED, "Append", "EventTime"))
