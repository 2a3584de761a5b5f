"""Components that fall silent: a keyed state machine with processing-time timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from triagemill.operators.joins import route_by_prefix
from triagemill.session import scratch_path

CHANGES = "component string, request_count long, last_seen timestamp, status string, since timestamp"
_STATE = "last_seen long, request_count long, due long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Liveness(StatefulProcessor):
    """Per component: the last request, the number of requests, and one timer for the end of its patience.

    A request makes the component ``up`` and moves its timer; a timer that runs out makes it ``down``. Components that
    never asked for anything start with a timer too. A row goes out with every batch that holds requests of the
    component and with every timer.
    """

    def __init__(self, timeout_s: float):
        self.timeout = int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", _STATE)

    def _held(self) -> tuple[int, int, int]:
        """Last request in microseconds (0: none), requests, and when the timer runs out (0: none is set)."""
        return self.state.get() if self.state.exists() else (0, 0, 0)

    def _wait(self, now: int, last: int, count: int, old: int) -> None:
        if old:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + self.timeout)
        self.state.update((last, count, now + self.timeout))

    def _row(self, key, last: int, count: int, status: str, now: int) -> pd.DataFrame:
        seen = pd.Timestamp(last, unit="us") if last else pd.NaT
        return pd.DataFrame({
            "component": [key[0]], "request_count": [count], "last_seen": pd.Series([seen], dtype="datetime64[us]"),
            "status": [status], "since": pd.Series([pd.Timestamp(now, unit="ms")], dtype="datetime64[us]")})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._wait(timerValues.getCurrentProcessingTimeInMs(), 0, 0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, count, old = self._held()
        for part in rows:
            last, count = max(last, int(part["last_seen"].max())), count + int(part["request_count"].sum())
        now = timerValues.getCurrentProcessingTimeInMs()
        self._wait(now, last, count, old)
        yield self._row(key, last, count, "up", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, count, due = self._held()
        if expiredTimerInfo.getExpiryTimeInMs() == due:  # else a request has come in the same batch
            self.state.update((last, count, 0))
            yield self._row(key, last, count, "down", due)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per component and Arrow batch, so that a busy component sends few rows to its task."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("component").aggregate([("micros", "max"), ("micros", "count")])
        yield from t.select(["component", "micros_max", "micros_count"]).rename_columns(["component", "last_seen", "request_count"]).to_batches()


def liveness_changes(requests: DataFrame, components: Sequence[tuple[str, str]], timeout_s: float = 15.0) -> DataFrame:
    """Status changes of all components, as a stream (update mode, RocksDB state store)."""
    spark = requests.sparkSession
    routed = route_by_prefix(requests, components).filter("component is not null and ts is not null")
    seen = routed.selectExpr("component", "unix_micros(ts) AS micros").mapInArrow(
        _merged, "component string, last_seen long, request_count long")
    known = spark.createDataFrame([(name,) for name, _ in components], "component string")  # one row per component
    return seen.groupBy("component").transformWithStateInPandas(
        Liveness(timeout_s), CHANGES, "Update", "ProcessingTime", initialState=known.groupBy("component"))


def watch_components(
    requests: DataFrame, components: Sequence[tuple[str, str]], put: Callable[[DataFrame, int], None],
    timeout_s: float = 15.0, every: str = "1 second", path: str | None = None,
) -> StreamingQuery:
    """Start the watch: ``put`` gets the changes of each batch.

    Batches run every ``every`` also without requests, so that a silent component goes down by itself. For the same
    reason the query has no end of its own; ``read_through`` ends it.
    """
    spark = requests.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # a query takes the store that is named when it starts
    try:
        writer = liveness_changes(requests, components, timeout_s).writeStream.outputMode("update").foreachBatch(put)
        writer = writer.option("checkpointLocation", f"{path or scratch_path(spark, 'liveness')}/_checkpoint")
        return writer.trigger(processingTime=every).start()
    finally:
        spark.conf.set(_STORE, before)


def read_through(query: StreamingQuery) -> None:
    """End a watch when a batch has met no more requests."""
    try:
        while not query.awaitTermination(0.2):
            seen = query.lastProgress
            if seen and seen.numInputRows == 0:
                return
    finally:
        query.stop()
