"""The emission gate as keyed state with timers: an alert key is told once within its window."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keyed state with timers needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Gate(StatefulProcessor):
    """Remembers when a key was told last; a timer forgets it when the watermark has passed the window."""

    def __init__(self, window_us: int, columns: list[str]):
        self.window_us, self.columns = window_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        told = pd.concat(list(rows))
        told.columns = [*self.columns, "gate_us"]  # names that begin with _ arrive changed
        told = told.sort_values("gate_us", kind="stable")
        keep = []
        for us in told["gate_us"].tolist():
            keep.append(last is None or us - last > self.window_us)
            last = us if keep[-1] else last
        self.last.update((int(last),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((int(last) + self.window_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield told.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Within it queries that start keep their state in STATE_STORE."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stateful_gate(alerts: DataFrame, key: str, ts: str, window_us: int, late: str = "1 hour") -> DataFrame:
    """Alerts of a stream whose key hasn't been told within the window before, as ``live.emission_gate``,
    on keyed state with timers: start it within ``keyed_state``. Restarted from its checkpoint it tells
    nothing twice."""
    rows = alerts.withWatermark(ts, late).withColumn("gate_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return rows.groupBy(key).transformWithStateInPandas(Gate(window_us, alerts.columns), alerts.schema, "Append", "EventTime")
