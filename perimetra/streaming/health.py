"""Health of live feeds by the clock on the wall: silence is told although no row comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from perimetra.params import SENSOR, Sensor

HEALTH = "site_id long, sensor string, event string, at_ms long, silent_ms long, failures long"
STATE = "heard long, stale boolean, failures long"


class FeedWatch(StatefulProcessor):
    """One feed: when it last gave a frame, whether its silence was told, and its run of failed reads.

    Every frame sets the timer anew, so an expired timer means silence. Rows about silence come once until the feed is back; a feed that never
    gave a frame is not stale.
    """

    def __init__(self, p: Sensor = SENSOR):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", STATE)

    def _told(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[c.split()[0] for c in HEALTH.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        heard, stale, failures = self.state.get() if self.state.exists() else (None, False, 0)
        told = []
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        for ok in arrived["ok"].tolist():
            failures = 0 if ok else failures + 1
            if ok:
                if stale:
                    told.append(("back", now, now - heard, 0))
                heard, stale = now, False
            elif failures == self.p.warn_after_failures or (
                failures > self.p.warn_after_failures and failures % self.p.warn_every_failures == 0
            ):
                told.append(("failing", now, None if heard is None else now - heard, failures))
        self.state.update((heard, stale, failures))
        if arrived["ok"].any():
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + int(self.p.stale_after_s * 1000))
        return self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        heard, stale, failures = self.state.get()
        if stale or now - heard < int(self.p.stale_after_s * 1000):
            return iter(())
        self.state.update((heard, True, failures))
        return self._told(key, [("stale", now, now - heard, failures)])

    def close(self) -> None:
        pass


def feed_watch(arrivals: DataFrame, p: Sensor = SENSOR) -> DataFrame:
    """Events of ``arrivals(site_id, sensor, ts, ok)``: stale, back, failing. Timers are those of processing time: they fire without any row."""
    keys = ["site_id", "sensor"]
    return arrivals.select(*keys, "ts", "ok").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FeedWatch(p), outputStructType=HEALTH, outputMode="Append", timeMode="ProcessingTime"
    )
