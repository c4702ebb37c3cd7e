"""The state of every page of a run as its events arrive: pending, ok, failed or skipped, with timers.

A page that is taken up and not heard of in time has failed; a page that failed may be taken up
again; what is done stays done.  States are forgotten when they have been final for the time of
retention.  State lives in the state store and the stream's checkpoint, so a restart goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States that nothing leaves, and those a page can be reported in.
FINAL, KNOWN = ("ok", "skipped"), ("pending", "ok", "failed", "skipped")
#: Times are microseconds here, so that no session's time zone matters.
CHANGES = "run string, page string, status string, us long, attempts int, reason string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageStates(StatefulProcessor):
    """Events (run, page, status, us) of one page to the changes of its state."""

    def __init__(self, patience_ms: int, retention_ms: int):
        self.patience_ms, self.retention_ms = patience_ms, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("page", "status string, us long, attempts int, due long")

    def _set(self, status: str, us: int, attempts: int, from_ms: int) -> None:
        """The new state, and the one timer that belongs to it."""
        if self.state.exists():
            self.handle.deleteTimer(self.state.get()[3])
        due = from_ms + (self.patience_ms if status == "pending" else self.retention_ms)
        self.handle.registerTimer(due)
        self.state.update((status, us, attempts, due))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = sorted((r for r in rows if r["status"] in KNOWN and r["us"] is not None), key=lambda r: (r["us"], KNOWN.index(r["status"])))
        for r in known:
            status, us, attempts, _ = self.state.get() if self.state.exists() else (None, None, 0, 0)
            # What is done stays; older events and repeated ones change nothing.
            if status in FINAL or (us is not None and r["us"] < us) or r["status"] == status:
                continue
            attempts += r["status"] == "pending"
            self._set(r["status"], r["us"], attempts, r["us"] // 1000)
            yield Row(run=key[0], page=key[1], status=r["status"], us=r["us"], attempts=attempts, reason=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.state.exists():
            return
        status, us, attempts, due = self.state.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        if status == "pending":
            self._set("failed", us, attempts, due)
            yield Row(run=key[0], page=key[1], status="failed", us=us, attempts=attempts, reason="no answer in time")
        else:
            self.state.clear()
            yield Row(run=key[0], page=key[1], status="forgotten", us=us, attempts=attempts, reason=None)

    def close(self) -> None:
        pass


def page_states(events: DataFrame, patience: int = 600, retention: int = 90 * 86_400, late: str = "10 minutes") -> DataFrame:
    """Changes of state of every page of a stream of events (run, page, status, at), seconds counted in event time.

    Events later than `late` are dropped; unknown states and events without a time change nothing.
    The session's state store must be STATE_STORE.
    """
    stamped = events.select("run", "page", "status", "at", F.unix_micros("at").alias("us")).withWatermark("at", late)
    changes = stamped.groupBy("run", "page").transformWithState(PageStates(patience * 1000, retention * 1000), CHANGES, "Update", "EventTime")
    return changes.select("run", "page", "status", F.timestamp_micros("us").alias("at"), "attempts", "reason")
