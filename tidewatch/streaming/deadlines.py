"""Verdicts that change without any event: a source's state keeps its latest load and its coming releases, and a timer goes off at the
next instant at which its verdict can change, a release or a passed deadline.

The state of a source is its latest load, its last verdict and the releases that have not arrived; releases that have are dropped.
A row is given out when a verdict changes. Sources are keys of Spark's own state store, so they are dealt over executors and survive their loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.releases import releases_between

#: The store that timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
VERDICT = "source_id string, at_us long, status string, release_us long, deadline_us long, observed_us long"


class DeadlineWatch(StatefulProcessor):
    """Rows of a source: loaded_us, or release_us with deadline_us."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "us long")
        self.said = handle.getValueState("said", "status string")
        self.releases = handle.getListState("releases", "release_us long, deadline_us long")

    def _add(self, frames: Iterator[pd.DataFrame]) -> None:
        held, latest = set(self.releases.get()), self.latest.get()[0] if self.latest.exists() else None
        for frame in frames:
            loads = frame["loaded_us"].dropna()
            if len(loads):
                latest = max(x for x in (latest, int(loads.max())) if x is not None)
            some = frame.dropna(subset=["release_us"])
            held |= set(zip(some["release_us"].astype("int64").tolist(), some["deadline_us"].astype("int64").tolist()))
        if latest is not None:
            self.latest.update((latest,))
            held = {r for r in held if r[0] > latest}
        if held:
            self.releases.put(sorted(held))
        else:  # a list that is empty can't be kept
            self.releases.clear()

    def _judged(self, key, now_us: int) -> Iterator[pd.DataFrame]:
        latest = self.latest.get()[0] if self.latest.exists() else None
        held = sorted(tuple(map(int, r)) for r in self.releases.get())
        open_ = [r for r in held if r[0] <= now_us]
        status = "NO_DATA" if latest is None else "ON_TIME" if not open_ else "OVERDUE" if any(d < now_us for _, d in open_) else "NOT_DUE"
        if not self.said.exists() or self.said.get()[0] != status:
            self.said.update((status,))
            first = open_[0] if open_ else (None, None)
            yield pd.DataFrame({"source_id": [key[0]], "at_us": [now_us], "status": [status], "release_us": pd.array([first[0]], "Int64"),
                                "deadline_us": pd.array([first[1]], "Int64"), "observed_us": pd.array([latest], "Int64")})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(timer[0] if isinstance(timer, tuple) else timer))
        changes = [r for r, _ in held if r > now_us] + [d + 1 for _, d in held if d >= now_us]
        if changes:
            self.handle.registerTimer(-(-min(changes) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._add(rows)
        yield from self._judged(key, timerValues.getCurrentProcessingTimeInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judged(key, max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._add(iter([initialState]))
        # the first timer goes off at once and gives out the verdict so far, so that a source that stays silent is told of too
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)

    def close(self) -> None:
        pass


def coming_releases(rules: DataFrame, days: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The releases of rules as rows of a watch."""
    micros = lambda c: F.unix_micros(F.expr(c).cast("timestamp"))
    found = releases_between(rules, days, start, end)
    return found.select("source_id", F.lit(None).cast("long").alias("loaded_us"), micros("instant").alias("release_us"), micros("timestampadd(MICROSECOND, grace_us, instant)").alias("deadline_us"))


def watch_deadlines(loads: DataFrame, releases: DataFrame) -> DataFrame:
    """A stream of changed verdicts: source_id, at_us, status, release_us, deadline_us, observed_us (microseconds of UTC).

    loads: a stream of source_id, loaded_us, and release_us with deadline_us where a row brings a further release; releases: a table
    of the same columns, the releases to begin with. The session needs STATE_STORE."""
    columns = ("source_id", "loaded_us", "release_us", "deadline_us")
    return loads.select(*columns).groupBy("source_id").transformWithStateInPandas(
        DeadlineWatch(), VERDICT, "Update", "ProcessingTime", releases.select(*columns).groupBy("source_id"))
