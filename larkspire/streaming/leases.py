"""The job queue as keyed state with timers: a lease that nobody extends expires by itself.

Each job is a key. Its state is status, attempts, owner and the end of its lease; its failures are a list that is kept
for some days (TTL) and bounded. A claim sets a processing-time timer for the end of the lease, a heartbeat of the owner
moves it, and the timer puts the job back to pending, or to dead_lettered once its attempts are used up, without any new
input. Everything is in the state store, so a restart from the checkpoint goes on with the timers that were set
(Spark looks at them from the first event of any job on).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "job_id long, status string, attempts int, owner string, lease_until long, failures int, cause string"
HISTORY, KEPT_MS = 20, 30 * 24 * 3600 * 1000
_NAMES = [c.split()[0] for c in OUT.split(", ")]


class Queue(StatefulProcessor):
    """Events of a job (at, event, worker): enqueue, claim, heartbeat, release, done, fail. What a job's status and its owner don't allow is passed over."""

    def __init__(self, lease_ms: int, max_attempts: int):
        self.lease_ms, self.max_attempts = lease_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, owner string, lease_until long")
        self.failures = handle.getListState("failures", "attempt int, cause string", ttlDurationMs=KEPT_MS)

    def _get(self) -> tuple:
        return tuple(self.job.get()) if self.job.exists() else ("new", 0, None, None)

    def _lease(self, old: int | None, new: int | None) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    def _failed(self, attempts: int, cause: str) -> str:
        kept = [tuple(x) for x in self.failures.get()] if self.failures.exists() else []
        self.failures.put([*kept[-(HISTORY - 1) :], (attempts, cause)])
        return "pending" if attempts < self.max_attempts else "dead_lettered"

    def _row(self, key, state: tuple, cause: str) -> pd.DataFrame:
        n = len(list(self.failures.get())) if self.failures.exists() else 0
        return pd.DataFrame([(key[0], *state, n, cause)], columns=_NAMES).astype({"lease_until": "Int64", "attempts": "int32", "failures": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, owner, until = self._get()
        now, cause = timerValues.getCurrentProcessingTimeInMs(), ""
        events = pd.concat(list(rows)).sort_values(["at", "event"])
        for event, worker in zip(events["event"], events["worker"], strict=True):
            mine, had = status == "running" and owner == worker, until
            if event == "enqueue" and status == "new":
                status = "pending"
            elif event == "claim" and status == "pending":
                status, attempts, owner, until = "running", attempts + 1, worker, now + self.lease_ms
            elif event == "heartbeat" and mine:
                until = now + self.lease_ms
            elif event == "release" and mine:
                status, owner, until = "pending", None, None
            elif event == "done" and mine:
                status, owner, until = "completed", None, None
            elif event == "fail" and mine:
                status, owner, until = self._failed(attempts, "failed"), None, None
            else:
                continue
            cause = event
            if until != had:
                self._lease(had, until)
        self.job.update((status, attempts, owner, until))
        yield self._row(key, (status, attempts, owner, until), cause)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, _, until = self._get()
        if status == "running" and until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            state = (self._failed(attempts, "lease expired"), attempts, None, None)
            self.job.update(state)
            yield self._row(key, state, "expired")

    def close(self) -> None:
        pass


def queue(events: DataFrame, lease_seconds: float = 120, max_attempts: int = 3) -> DataFrame:
    """The queue's changes, a row a job and batch, from a stream of events (job_id, at, event, worker)."""
    stateful(events.sparkSession)
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Queue(int(lease_seconds * 1000), max_attempts), outputStructType=OUT, outputMode="update", timeMode="processingTime")


def stateful(spark: SparkSession) -> None:
    """Timers, lists and TTL need the state store in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
