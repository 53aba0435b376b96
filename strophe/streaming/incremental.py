"""Streaming forms of incremental work: resume by key, request rates and polling with a timeout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def process_new(source: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Every new key is worked on once and appended; a restart goes on from the checkpoint."""
    return work(source.dropDuplicates([key])).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def request_windows(log: DataFrame, ts: str = "ts", late: str = "1 minute", by: str | None = None, length: str = "10 seconds", slide: str = "1 second") -> DataFrame:
    """Requests in sliding windows as a streaming aggregate; a window is given out when the watermark has passed it.

    Requests that come later than `late` after newer ones are dropped where their windows are out already.
    """
    keys = [F.window(ts, length, slide), *([F.col(by)] if by else [])]
    return log.withWatermark(ts, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


_FINAL = ("succeeded", "failed")


class _Poll(StatefulProcessor):
    """Status updates of one task, held until the watermark shows that none before a moment is missing."""

    def __init__(self, key: str, timeout_us: int):
        self.key, self.timeout = key, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "us long, status string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r["us"], r["status"]) for r in rows]
        if self.done.exists() or not new:
            return iter(())
        old = [(us, status) for us, status in self.seen.get()]
        self.seen.appendList(new)
        # updates move the end only to an earlier moment, which gets a timer of its own
        if not old or self.end(old + new)[0] != self.end(old)[0]:
            self.handle.registerTimer(self.end(old + new)[0] // 1000 + 1)  # by the millisecond: at its end nothing of it is missing
        return iter(())

    def end(self, seen: list[tuple[int, str]]) -> tuple[int, str]:
        """When and how the task ends by what is known."""
        deadline = min(us for us, _ in seen) + self.timeout
        return min(((us, status) for us, status in seen if status in _FINAL and us <= deadline), default=(deadline, "timeout"))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.done.exists():
            seen = [(us, status) for us, status in self.seen.get()]
            at, outcome = self.end(seen)
            if at < expiredTimerInfo.getExpiryTimeInMs() * 1000:
                self.seen.clear()
                self.done.update((True,))
                yield Row(**{self.key: key[0], "outcome": outcome, "polls": sum(us <= at for us, _ in seen)})

    def close(self) -> None:
        pass


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def poll(events: DataFrame, timeout_ms: int, key: str = "task_id", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """(task_id, ts, status) updates to one outcome for each task: its first final status, or `timeout`, and the polls up to it.

    All by the events' own time: a task times out when `timeout_ms` have passed since its first update and the watermark
    has passed that moment. Of final statuses at one moment `failed` counts.
    """
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("us"), "status")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return rows.groupBy(key).transformWithState(_Poll(key, timeout_ms * 1000), f"{key} {kind}, outcome string, polls long", "append", "eventTime")
