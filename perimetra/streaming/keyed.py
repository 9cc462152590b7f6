"""Stateful streams: the batch state machines, one per key, kept between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from perimetra.operators.machines import Admission, Dwell, HeldNames, LiveAlerts, Machine, NumberBoard, Passage, RequestDesk, Stay, Tracker
from perimetra.operators.blobs import BLOB, MotionDetector
from perimetra.operators.site import ThermalLearner
from perimetra.params import (
    ALERTING,
    DETECT,
    ESCALATE,
    FUSION,
    THERMAL_SITE,
    TRACKING,
    Alerting,
    Detect,
    Escalate,
    Fusion,
    ThermalSite,
    Tracking,
)

WATERMARK = "10 seconds"
STATE = "machine binary, last long"


class MachineStream(StatefulProcessor):
    """Feeds each key's machine in order.

    Rows wait in state until the watermark has passed them, then go to the machine sorted: a frame that comes in parts, or rows that
    come out of order within the watermark's delay, give what the batch gives. Rows later than that are dropped by the engine,
    which counts them in the query's progress. With ``ttl_s`` a key silent for that much event time is closed and its machine dropped; with
    None the machine is kept for good, as for learned models, backgrounds and track numbers.
    """

    def __init__(self, keys: list[str], order: list[str], factory: Callable[[], Machine], names: list[str], event_time: str, ttl_s: float | None):
        self.keys, self.order, self.factory, self.names = keys, order, factory, names
        self.event_time, self.ttl_s = event_time, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", STATE)
        self.waiting = handle.getListState("waiting", "rows binary")

    def _load(self) -> tuple[Machine, int | None]:
        if not self.state.exists():
            return self.factory(), None
        blob, last = self.state.get()
        return pickle.loads(bytes(blob)), last

    def _frame(self, key: tuple, out: dict | None) -> Iterator[pd.DataFrame]:
        if out is None or len(next(iter(out.values()))) == 0:
            return
        pdf = pd.DataFrame({k: list(v) if not isinstance(v, np.ndarray) else v for k, v in out.items()})
        for name, value in zip(self.keys, key):
            pdf[name] = value
        yield pdf[self.names]

    def _micros(self, rows: pd.DataFrame) -> np.ndarray:
        return rows[self.event_time].to_numpy(dtype="datetime64[us]").astype(np.int64)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        self.waiting.appendValue((pickle.dumps(new),))
        self.handle.registerTimer(int(self._micros(new).min()) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        machine, last = self._load()
        parts = [pickle.loads(bytes(r[0])) for r in self.waiting.get()] if self.waiting.exists() else []
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            at = self._micros(rows)
            ready = at <= now * 1000
            if ready.any():
                due = rows[ready].sort_values(self.order, kind="stable")
                yield from self._frame(key, self.step(machine, {c: due[c].to_numpy() for c in due.columns}))
                last = int(at[ready].max()) // 1000
                self.waiting.clear()
                if not ready.all():
                    self.waiting.appendValue((pickle.dumps(rows[~ready]),))
            if not ready.all():
                self.handle.registerTimer(int(at[~ready].min()) // 1000)
        if last is None:
            return
        if self.ttl_s is not None and last + self.ttl_s * 1000 < now:
            yield from self._frame(key, self.expire(machine))
            self.state.clear()
            return
        self.state.update((pickle.dumps(machine), last))
        if self.ttl_s is not None:
            self.handle.registerTimer(last + int(self.ttl_s * 1000) + 1)

    def step(self, machine: Machine, cols: dict) -> dict | None:
        return machine.feed(cols)

    def expire(self, machine: Machine) -> dict | None:
        return machine.close()

    def close(self) -> None:
        pass


class AlertStream(MachineStream):
    """Alert life on a stream: a gap is closed by the next row or, in silence, by a timer."""

    def __init__(self, p: Alerting, *args):
        super().__init__(*args)
        self.p = p

    def step(self, machine: LiveAlerts, cols: dict) -> dict | None:
        gap = int(self.p.close_after_s * 1e6)
        seen = getattr(machine, "seen_us", None)
        closed = np.full(len(cols["t_us"]), np.nan)
        for i, (t, threat) in enumerate(zip(cols["t_us"].tolist(), cols["threat"].tolist())):
            if seen is not None and t - seen >= gap:
                closed[i] = seen + gap
            if threat is not None and threat == threat:
                seen = t
        machine.seen_us = seen
        return machine.feed({**cols, "threat": cols["threat"].astype(float), "closed_us": closed})

    def expire(self, machine: LiveAlerts) -> dict | None:
        if machine.open is not None:
            machine.open["closed_us"] = machine.open["updated_us"] + int(self.p.close_after_s * 1e6)
        return machine.close()


def _both(one: DataFrame, other: DataFrame, event_time: str) -> DataFrame:
    """Two inputs as one; each has its own watermark, and rows wait for the one that is behind."""
    return one.withWatermark(event_time, WATERMARK).unionByName(other.withWatermark(event_time, WATERMARK), allowMissingColumns=True)


def _run(stream: DataFrame, keys: list[str], schema: str, processor: StatefulProcessor, event_time: str, marked: bool = False) -> DataFrame:
    marked = stream if marked else stream.withWatermark(event_time, WATERMARK)
    return marked.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


ALERTS = (
    "site_id long, key string, opened_frame long, opened_us long, updated_us long, closed_us long, frames long, peak_threat double, "
    "threat double, label string, dwell_s double, acked boolean, cleared boolean, event string, at_us long"
)


def alerts(assessed: DataFrame, p: Alerting = ALERTING, event_time: str = "ts") -> DataFrame:
    """Alerts of ``assessed(site_id, key, frame_idx, t_us, ts, threat, label, dwell_s)`` as they live: a record when one opens, one for each
    later batch that it lasts, and one when it closes."""
    keys = ["site_id", "key"]
    proc = AlertStream(p, keys, ["frame_idx"], lambda: LiveAlerts(p), _names(ALERTS), event_time, p.close_after_s)
    return _run(assessed, keys, ALERTS, proc, event_time)


def dwell(tracks: DataFrame, p: Fusion = FUSION, ttl_s: float = 60.0, event_time: str = "ts") -> DataFrame:
    schema = "site_id long, track_id long, frame_idx long, dwell_s double"
    keys = ["site_id", "track_id"]
    return _run(tracks, keys, schema, MachineStream(keys, ["frame_idx"], lambda: Dwell(p), _names(schema), event_time, ttl_s), event_time)


def contact_stays(contacts: DataFrame, actions: DataFrame | None = None, p: Fusion = FUSION, event_time: str = "ts") -> DataFrame:
    """Dwell of ``contacts(site_id, key, frame_idx, t_us, ts)`` at every sighting, while the stay lasts; a contact's record goes after
    ``contact_purge_s`` of silence. ``actions(site_id, key, frame_idx, t_us, ts, action)`` start a contact anew behind their frame."""
    schema = "site_id long, object_key string, frame_idx long, t_us long, dwell_s double"
    seen = contacts.select("site_id", F.col("key").alias("object_key"), "frame_idx", "t_us", event_time, F.lit(0).alias("act"))
    if actions is not None:
        said = actions.select("site_id", F.col("key").alias("object_key"), "frame_idx", "t_us", event_time, F.lit(1).alias("act"), "action")
        seen = _both(seen, said, event_time)
    keys = ["site_id", "object_key"]
    proc = MachineStream(keys, ["frame_idx", "act"], lambda: Stay(p), _names(schema), event_time, p.contact_purge_s)
    return _run(seen, keys, schema, proc, event_time, actions is not None)


def tracked(dets: DataFrame, p: Tracking = TRACKING, event_time: str = "ts") -> DataFrame:
    """Track numbers of ``dets(site_id, frame_idx, t_us, ts, det_id, cx, cy, size_rank)``; a number is never given twice at a site."""
    schema = "site_id long, frame_idx long, det_id long, track_no long"
    keys = ["site_id"]
    proc = MachineStream(keys, ["frame_idx", "size_rank", "det_id"], lambda: Tracker(p), _names(schema), event_time, None)
    return _run(dets, keys, schema, proc, event_time)


def admitted(candidates: DataFrame, p: Escalate = ESCALATE, event_time: str = "ts") -> DataFrame:
    schema = "site_id long, key string, frame_idx long, t_us long"
    keys = ["site_id"]
    source = candidates.withColumnRenamed("key", "object_key")

    class Ask(MachineStream):
        def step(self, machine: Machine, cols: dict) -> dict | None:
            return machine.feed({**cols, "key": cols["object_key"]})

    proc = Ask(keys, ["frame_idx", "object_key"], lambda: Admission(p), _names(schema), event_time, p.cooldown_s)
    return _run(source, keys, schema, proc, event_time)


def request_desk(candidates: DataFrame, replies: DataFrame, p: Escalate = ESCALATE, event_time: str = "ts") -> DataFrame:
    """What happens to requests of ``candidates(site_id, key, t_us, ts)``, given ``replies`` of the same columns; see the batch operator."""
    schema = "site_id long, object_key string, t_us long, event string"
    columns = ["site_id", F.col("key").alias("object_key"), "t_us", event_time]
    both = _both(candidates.select(*columns, F.lit(False).alias("reply")), replies.select(*columns, F.lit(True).alias("reply")), event_time)

    class Ask(MachineStream):
        def step(self, machine: Machine, cols: dict) -> dict | None:
            told = machine.feed({**cols, "key": cols["object_key"]})
            return told and {"object_key": told["key"], "t_us": told["t_us"], "event": told["event"]}

    proc = Ask(["site_id"], ["t_us", "later", "object_key"], lambda: RequestDesk(p), _names(schema), event_time, None)
    return _run(both.withColumn("later", (~F.col("reply")).cast("int")), ["site_id"], schema, proc, event_time, True)


def object_numbers(assessed: DataFrame, p: Alerting = ALERTING, event_time: str = "ts") -> DataFrame:
    """Number of every object in every frame."""
    schema = "site_id long, object_key string, frame_idx long, number long"
    source = assessed.withColumnRenamed("key", "object_key")
    proc = MachineStream(["site_id"], ["frame_idx", "object_key"], lambda: NumberBoard(p), _names(schema), event_time, p.forget_number_s)
    return _run(source, ["site_id"], schema, proc, event_time)


def learned_site(frames: DataFrame, p: ThermalSite = THERMAL_SITE, event_time: str = "ts", actions: DataFrame | None = None) -> DataFrame:
    """Read and learn ``frames(site_id, frame_idx, t_us, ts, rel)`` as they arrive; what a site has learned outlives any silence.

    ``actions(site_id, frame_idx, t_us, ts, act, action, cells)`` is a second stream: what an operator did behind that frame.
    """
    schema = "site_id long, frame_idx long, z array<double>, dev array<double>, persist array<long>, suppressed boolean"
    keys, order = ["site_id"], ["frame_idx"]
    if actions is not None:
        frames = _both(frames.withColumn("act", F.lit(-1)), actions, event_time)
        order = ["frame_idx", "act"]
    proc = MachineStream(keys, order, lambda: ThermalLearner(p), _names(schema), event_time, None)
    return _run(frames, keys, schema, proc, event_time, actions is not None)


def traffic(tracks: DataFrame, alarms: DataFrame, p: ThermalSite = THERMAL_SITE, event_time: str = "ts", ttl_s: float = 60.0) -> DataFrame:
    """Sightings that count as traffic: those of ``tracks(site_id, track_id, frame_idx, t_us, ts, cx, cy, area, hits, speed_px)`` whose track is
    not in ``alarms(site_id, track_id, frame_idx, t_us, ts)`` one frame before. The two streams meet in the state of each track, in frame order."""
    schema = "site_id long, track_id long, frame_idx long, cx double, cy double, area double, speed_px double"
    keys = ["site_id", "track_id"]
    alarmed = alarms.select(*keys, "frame_idx", "t_us", event_time, F.lit(True).alias("alarm"))
    both = _both(tracks.withColumn("alarm", F.lit(False)), alarmed, event_time)
    proc = MachineStream(keys, ["frame_idx", "alarm"], lambda: Passage(p), _names(schema), event_time, ttl_s)
    return _run(both, keys, schema, proc, event_time, True)


def detected(
    frames: DataFrame, rows: int, cols: int, optical: bool = False, p: Detect = DETECT, event_time: str = "ts"
) -> DataFrame:
    """Blobs of ``frames(site_id, frame_idx, t_us, ts, values)`` against a background kept per site."""
    schema = f"site_id long, frame_idx long, blobs array<{BLOB}>, noise double, threshold double"
    keys, names = ["site_id"], ["site_id", "frame_idx", "blobs", "noise", "threshold"]
    proc = MachineStream(keys, ["frame_idx"], lambda: MotionDetector(rows, cols, optical, p), names, event_time, None)
    return _run(frames, keys, schema, proc, event_time)


def held_names(passes: DataFrame, p: Fusion = FUSION, event_time: str = "ts") -> DataFrame:
    """Names in force after each pass; ``found`` is the pass's list of recognitions."""
    schema = (
        "site_id long, model string, frame_idx long, label string, confidence double, x double, y double, w double, h double, seen_us long"
    )
    keys = ["site_id", "model"]
    return _run(passes, keys, schema, MachineStream(keys, ["frame_idx"], lambda: HeldNames(p), _names(schema), event_time, p.hold_s), event_time)
