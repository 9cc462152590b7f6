"""Sequential state machines of one key, used alike by batch scans and by streams.

Each has ``feed(columns) -> columns | None`` for the next rows in order and ``close()``.
Their state is plain attributes, so a stream can store it between batches.
"""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict, deque

import numpy as np

from perimetra.params import ALERTING, ESCALATE, FUSION, THERMAL_SITE, TRACKING, Alerting, Escalate, Fusion, ThermalSite, Tracking


class Machine:
    def close(self) -> dict | None:
        return None


class AlertLife(Machine):
    """Opens after a run above the line, updates at any threat, closes when its key stays away.

    ``closed_us`` on a row is the time of the clock frame that closed whatever was open
    before this row (NaN if none did). Emits one record per finished or still open alert. An alert that an operator
    clears ends at once and stays on record as cleared: it had been opened.
    """

    FIELDS = ("opened_frame", "opened_us", "updated_us", "closed_us", "frames", "peak_threat", "threat", "label", "dwell_s", "acked", "cleared")

    def __init__(self, p: Alerting = ALERTING):
        self.p = p
        self.streak = 0
        self.open: dict | None = None

    def feed(self, c: dict) -> dict | None:
        done = []
        action = c.get("action")
        for i in range(len(c["t_us"])):
            if self.open is not None and not math.isnan(c["closed_us"][i]):
                done.append({**self.open, "closed_us": int(c["closed_us"][i])})
                self.open, self.streak = None, 0
            if action is not None and action[i] is not None:
                if action[i] == "clear":
                    if self.open is not None:
                        done.append({**self.open, "closed_us": int(c["t_us"][i]), "cleared": True})
                    self.open, self.streak = None, 0
                elif action[i] == "ack" and self.open is not None:
                    self.open["acked"] = True
                continue
            if math.isnan(c["threat"][i]):
                continue
            over = c["threat"][i] >= self.p.threshold
            self.streak = self.streak + 1 if over else 0
            if self.open is not None:
                self.open["frames"] += 1
            elif over and self.streak >= self.p.open_after:
                t = int(c["t_us"][i])
                self.open = {
                    "opened_frame": int(c["frame_idx"][i]), "opened_us": t, "closed_us": None, "frames": 2, "peak_threat": 0.0, "acked": False, "cleared": False,
                }
            new = self.open is not None and "updated_us" not in self.open
            if self.open is not None:
                self.open["updated_us"] = int(c["t_us"][i])
                self.open["threat"] = float(c["threat"][i])
                self.open["peak_threat"] = max(self.open["peak_threat"], float(c["threat"][i]))
                self.open["label"] = c["label"][i]
                self.open["dwell_s"] = float(c["dwell_s"][i])
            if new:
                self.opened(self.open)
        return self.records(done)

    def opened(self, alert: dict) -> None:
        """Called with each alert on the row that opens it."""

    def close(self) -> dict | None:
        left, self.open = ([self.open] if self.open is not None else []), None
        return self.records(left)

    def records(self, rows: list[dict]) -> dict | None:
        return {f: [r[f] for r in rows] for f in self.FIELDS} if rows else None


class LiveAlerts(AlertLife):
    """The same life as it is told while it lasts: records of the kinds open, update (once for each feed) and close."""

    FIELDS = (*AlertLife.FIELDS, "event", "at_us")

    def __init__(self, p: Alerting = ALERTING):
        super().__init__(p)
        self.told: list[dict] = []

    def opened(self, alert: dict) -> None:
        self.told.append({**alert, "event": "open", "at_us": alert["opened_us"]})

    def records(self, rows: list[dict]) -> dict | None:
        lasting = self.open is not None and all(t["opened_us"] != self.open["opened_us"] for t in self.told)
        told = self.told + [{**r, "event": "close", "at_us": r["closed_us"]} for r in rows]
        if lasting:
            told.append({**self.open, "event": "update", "at_us": self.open["updated_us"]})
        self.told = []
        told.sort(key=lambda r: r["at_us"])
        return {f: [r[f] for r in told] for f in self.FIELDS} if told else None


class Dwell(Machine):
    """Time inside a small circle; leaving it moves the anchor and starts again one update later."""

    def __init__(self, p: Fusion = FUSION):
        self.p = p
        self.anchor = None
        self.since = None

    def feed(self, c: dict) -> dict:
        out = np.zeros(len(c["t_us"]))
        acts = np.array([isinstance(a, str) for a in c["action"]]) if "action" in c else np.zeros(len(out), bool)
        for i, (x, y, t) in enumerate(zip(c["cx"].tolist(), c["cy"].tolist(), c["t_us"].tolist())):
            if acts[i]:  # an operator took the object for normal: its record goes
                self.anchor = self.since = None
            elif self.anchor is None:
                self.anchor = (x, y)
            elif math.sqrt((x - self.anchor[0]) ** 2 + (y - self.anchor[1]) ** 2) > self.p.settle_radius_px:
                self.anchor, self.since = (x, y), None
            elif self.since is None:
                self.since = t
            if self.since is not None:
                out[i] = (t - self.since) / 1e6
        return {"frame_idx": c["frame_idx"][~acts], "dwell_s": out[~acts]}


class Stay(Machine):
    """How long a contact has been in its place, told at every sighting; a gap over the grace starts again, and so does an operator's accept."""

    def __init__(self, p: Fusion = FUSION):
        self.p = p
        self.since = self.last = None

    def feed(self, c: dict) -> dict | None:
        acts = np.array([isinstance(a, str) for a in c["action"]]) if "action" in c else np.zeros(len(c["t_us"]), bool)
        out = np.zeros(len(acts))
        for i, (t, act) in enumerate(zip(c["t_us"].tolist(), acts)):
            if act:
                self.since = None
                continue
            if self.since is None or t - self.last > self.p.contact_gap_s * 1e6:
                self.since = t
            self.last = t
            out[i] = (t - self.since) / 1e6
        return {"frame_idx": c["frame_idx"][~acts], "t_us": c["t_us"][~acts], "dwell_s": out[~acts]} if not acts.all() else None


class Passage(Machine):
    """Sightings of one track that count as traffic: moving, established, and not under alert in the frame before.

    Rows are sightings and alarms (``alarm`` true), an alarm behind the sighting of its frame.
    """

    def __init__(self, p: ThermalSite = THERMAL_SITE):
        self.p = p
        self.alarmed = None

    def feed(self, c: dict) -> dict | None:
        kept = []
        for i, (frame, alarm) in enumerate(zip(c["frame_idx"].tolist(), c["alarm"].tolist())):
            if alarm:
                self.alarmed = frame
            elif c["hits"][i] >= 2 and c["speed_px"][i] >= self.p.min_traffic_px and self.alarmed != frame - 1:
                kept.append(i)
        return {k: c[k][kept] for k in ("frame_idx", "cx", "cy", "area", "speed_px")} if kept else None


class Numbers(Machine):
    """The lowest free number for each stay of a key; a stay gives its number back when it ends."""

    def __init__(self):
        self.free: list[int] = []
        self.top = 0
        self.held: list[tuple] = []

    def feed(self, c: dict) -> dict:
        out = np.zeros(len(c["start_frame"]), np.int64)
        for i, (start, end) in enumerate(zip(c["start_frame"].tolist(), c["release_frame"].tolist())):
            while self.held and self.held[0][0] < start:
                heapq.heappush(self.free, heapq.heappop(self.held)[1])
            if self.free:
                n = heapq.heappop(self.free)
            else:
                self.top += 1
                n = self.top
            out[i] = n
            heapq.heappush(self.held, (math.inf if math.isnan(end) else end, n))
        return {"key": list(c["key"]), "start_frame": c["start_frame"], "number": out}


class NumberBoard(Machine):
    """Live numbers of one site: lowest free on first sight, given back after a long absence.

    Keys are kept in the order they were last seen, so those that stayed away stand in front.
    """

    def __init__(self, p: Alerting = ALERTING):
        self.limit = p.forget_number_s * 1e6
        self.holders: OrderedDict[str, tuple[int, int]] = OrderedDict()
        self.free: list[int] = []

    def feed(self, c: dict) -> dict:
        frames, times, keys = c["frame_idx"], c["t_us"].tolist(), list(c["object_key"])
        ends = [*(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(keys)]
        numbers = np.zeros(len(keys), np.int64)
        begin = 0
        for end in ends:
            for i in range(begin, end):
                numbers[i] = self._number(keys[i], times[i])
            if end > begin:
                self._release(times[end - 1])
            begin = end
        return {"object_key": keys, "frame_idx": frames, "number": numbers}

    def _number(self, key: str, now: int) -> int:
        if key in self.holders:
            n = self.holders[key][0]
        else:
            n = heapq.heappop(self.free) if self.free else len(self.holders) + 1
        self.holders[key] = (n, now)
        self.holders.move_to_end(key)
        return n

    def _release(self, now: int) -> None:
        while self.holders:
            n, seen = next(iter(self.holders.values()))
            if now - seen <= self.limit:
                break
            self.holders.popitem(last=False)
            heapq.heappush(self.free, n)
        # with no holder above it, a free number is the next to be minted anyway
        if not self.holders:
            self.free = []


class Admission(Machine):
    """Which requests may go out: one per key per cooldown, and never two close together."""

    def __init__(self, p: Escalate = ESCALATE):
        self.p = p
        self.last = -math.inf
        self.asked: dict[str, float] = {}

    def feed(self, c: dict) -> dict:
        kept = []
        for i, (key, t) in enumerate(zip(c["key"], c["t_us"].tolist())):
            s = t / 1e6
            if s - self.asked.get(key, -math.inf) < self.p.cooldown_s or s - self.last < self.p.min_gap_s:
                continue
            self.asked[key] = self.last = s
            kept.append(i)
        return {"key": [c["key"][i] for i in kept], "frame_idx": c["frame_idx"][kept], "t_us": c["t_us"][kept]}


class RequestDesk(Machine):
    """Requests of one site to a single answering service: one on its way, some waiting, each key once.

    Rows are candidates and replies (``reply`` true). A request is made if its key has none open, was not asked within the cooldown and no other
    was just made. With the queue full it is turned away, and still counts as asked. A reply to the request on its way sends the next one;
    any other reply is none of this desk's.
    """

    def __init__(self, p: Escalate = ESCALATE):
        self.p = p
        self.last = -math.inf
        self.asked: dict[str, float] = {}
        self.away: str | None = None
        self.waiting: deque[str] = deque()

    def feed(self, c: dict) -> dict | None:
        told: list[tuple[str, int, str]] = []
        for key, t, reply in zip(c["key"], c["t_us"].tolist(), c["reply"].tolist()):
            if reply:
                if key == self.away and key is not None:
                    told.append((key, t, "answered"))
                    self.away = self.waiting.popleft() if self.waiting else None
                    if self.away is not None:
                        told.append((self.away, t, "sent"))
                continue
            s = t / 1e6
            if key == self.away or key in self.waiting:
                continue
            if s - self.asked.get(key, -math.inf) < self.p.cooldown_s or s - self.last < self.p.min_gap_s:
                continue
            self.asked[key] = self.last = s
            if self.away is None:
                self.away = key
                told.append((key, t, "sent"))
            elif len(self.waiting) < self.p.max_queue:
                self.waiting.append(key)
                told.append((key, t, "queued"))
            else:
                told.append((key, t, "turned away"))
        # what is over its cooldown says nothing any more
        self.asked = {k: s for k, s in self.asked.items() if self.last - s < self.p.cooldown_s}
        return {k: [r[i] for r in told] for i, k in enumerate(("key", "t_us", "event"))} if told else None


class HeldNames(Machine):
    """Names stay for a while after a pass that did not repeat them; a repeat refreshes its box.

    Boxes are held by label: one array of ``x, y, w, h, confidence, seen, turn`` for each, where ``turn`` tells which came first.
    """

    def __init__(self, p: Fusion = FUSION):
        self.p = p
        self.boxes: dict[str, np.ndarray] = {}
        self.turn = 0

    def _repeats(self, held: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Which held boxes the new one covers, or is covered by, for the most part."""
        x, y, w, h = held[:, 0], held[:, 1], held[:, 2], held[:, 3]
        across = np.maximum(np.minimum(x + w, box[0] + box[2]) - np.maximum(x, box[0]), 0.0)
        down = np.maximum(np.minimum(y + h, box[1] + box[3]) - np.maximum(y, box[1]), 0.0)
        return np.flatnonzero(across * down >= self.p.held_cover * np.minimum(w * h, box[2] * box[3]))

    def feed(self, c: dict) -> dict:
        """One row is one pass: ``found`` lists its recognitions as (label, confidence, x, y, w, h)."""
        told: list[tuple] = []
        for frame, now, found in zip(c["frame_idx"].tolist(), c["t_us"].tolist(), c["found"]):
            if found is None:  # an operator asked for a fresh look
                self.boxes = {}
                continue
            for label, rows in list(self.boxes.items()):
                stays = now - rows[:, 5] <= self.p.hold_s * 1e6
                if not stays.any():
                    del self.boxes[label]
                elif not stays.all():
                    self.boxes[label] = rows[stays]
            for f in found:
                self._take(f["label"], np.array([f[n] for n in ("x", "y", "w", "h", "confidence")], float), now)
            if self.boxes:
                rows = np.concatenate(list(self.boxes.values()))
                labels = np.repeat(np.array(list(self.boxes), object), [len(v) for v in self.boxes.values()])
                by = np.lexsort((rows[:, 6], -rows[:, 4]))
                told.append((np.full(len(by), frame, np.int64), labels[by], rows[by]))
        none = (np.zeros(0, np.int64), np.zeros(0, object), np.zeros((0, 7)))
        frames, labels, rows = (np.concatenate(parts) for parts in zip(none, *told))
        values = {n: rows[:, i] for i, n in enumerate(("x", "y", "w", "h"))}
        return {"frame_idx": frames, "label": labels, "confidence": rows[:, 4], **values, "seen_us": rows[:, 5].astype(np.int64)}

    def _take(self, label: str, box: np.ndarray, now: int) -> None:
        held = self.boxes.get(label, np.zeros((0, 7)))
        again = self._repeats(held, box)
        if len(again):
            held[again[0], :6] = [*box, now]
        else:
            held = np.concatenate([held, [[*box, now, self.turn]]])
            self.turn += 1
        self.boxes[label] = held


class RegionNames(Machine):
    """A settled region keeps the name of the region it overlaps in the tick before."""

    def __init__(self):
        self.tick = None
        self.before: list[tuple] = []

    def feed(self, c: dict) -> dict:
        """One row is one tick: ``regions`` lists (key, x, y, w, h, dwell_s), longest first."""
        ticks, minted, names = [], [], []
        for tick, regions in zip(c["tick"].tolist(), c["regions"]):
            if self.tick is not None and tick != self.tick + 1:
                self.before = []
            now = []
            for r in regions:
                b = (r["x"], r["y"], r["w"], r["h"])
                name = next(
                    (n for o, n in self.before if b[0] < o[0] + o[2] and o[0] < b[0] + b[2] and b[1] < o[1] + o[3] and o[1] < b[1] + b[3]),
                    r["key"],
                )
                now.append((b, name))
                ticks.append(tick)
                minted.append(r["key"])
                names.append(name)
            self.tick, self.before = tick, now
        return {"tick": np.asarray(ticks, np.int64), "minted": minted, "key": names}


class Places(Machine):
    """Stays in the places of one site, told apart where none can ever reach another.

    A stay is a run of sightings in one place; two belong together if their places touch (or are one) while both last, ``gap`` frames more.
    Each stay is told at once with the label of what it joins; when two labels meet, the younger one is told later with the label it became,
    when nothing of theirs lasts any more. What is kept is what still lasts.
    """

    def __init__(self, gap: int):
        self.gap = gap
        self.made = 0
        self.lasting: dict[tuple[int, int], tuple[int, int]] = {}
        self.ends: list[tuple[int, int, int]] = []
        self.head: dict[int, int] = {}
        self.members: dict[int, list[int]] = {}
        self.alive: dict[int, int] = {}

    def feed(self, c: dict) -> dict:
        told: list[tuple] = []
        for gx, gy, start, end in zip(*(c[k].tolist() for k in ("gx", "gy", "start", "end"))):
            self._expire(start, told)
            near = {self._root(self.lasting[k][1]) for k in ((gx + a, gy + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if k in self.lasting}
            if near:
                label = min(near)
                for other in near - {label}:
                    self.head[other] = label
                    self.members[label] += self.members.pop(other)
                    self.alive[label] += self.alive.pop(other)
            else:
                self.made += 1
                label = self.made
                self.members[label], self.alive[label], self.head[label] = [label], 0, label
            self.alive[label] += 1
            self.lasting[gx, gy] = (end, label)
            heapq.heappush(self.ends, (end, gx, gy))
            told.append((gx, gy, start, label, None))
        return self._told(told)

    def _root(self, label: int) -> int:
        while self.head[label] != label:
            label = self.head[label]
        return label

    def _expire(self, now: int | None, told: list[tuple]) -> None:
        while self.ends and (now is None or self.ends[0][0] + self.gap < now):
            _, gx, gy = heapq.heappop(self.ends)
            root = self._root(self.lasting.pop((gx, gy))[1])
            self.alive[root] -= 1
            if not self.alive[root]:
                told += [(None, None, None, m, root) for m in self.members[root] if m != root]
                for m in self.members.pop(root):
                    del self.head[m]
                del self.alive[root]

    @staticmethod
    def _told(rows: list[tuple]) -> dict | None:
        return {k: [r[i] for r in rows] for i, k in enumerate(("gx", "gy", "_since", "label", "became"))} if rows else None

    def close(self) -> dict | None:
        told: list[tuple] = []
        self._expire(None, told)
        return self._told(told)


class Tracker(Machine):
    """Nearest detection keeps the track, closest pairs first; a track ends after too many misses."""

    def __init__(self, p: Tracking = TRACKING):
        self.p = p
        self.next_id = 1
        self.live: dict[int, list] = {}
        self.frame = None

    def feed(self, c: dict) -> dict:
        frames, x, y, ids = c["frame_idx"], c["cx"].astype(float), c["cy"].astype(float), c["det_id"]
        out = np.zeros(len(frames), np.int64)
        cuts = np.flatnonzero(np.diff(frames)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frames)]):
            out[a:b] = self._frame(int(frames[a]), x[a:b], y[a:b])
        return {"frame_idx": frames, "det_id": ids, "track_no": out}

    def _frame(self, frame: int, x: np.ndarray, y: np.ndarray) -> list[int]:
        if self.frame is not None and frame > self.frame + 1:
            empty = frame - self.frame - 1
            self.live = {t: [px, py, miss + empty] for t, (px, py, miss) in self.live.items() if miss + empty <= self.p.max_misses}
        self.frame = frame
        tracks = list(self.live.items())
        got: dict[int, int] = {}
        if tracks:
            px = np.array([t[1][0] for t in tracks])[:, None]
            py = np.array([t[1][1] for t in tracks])[:, None]
            d = np.sqrt((px - x) ** 2 + (py - y) ** 2)
            ti, di = np.nonzero(d <= self.p.max_step_px)
            used = set()
            for k in np.argsort(d[ti, di], kind="stable"):
                t, j = int(ti[k]), int(di[k])
                if t not in used and j not in got:
                    used.add(t)
                    got[j] = tracks[t][0]
        out = []
        seen = set()
        for j in range(len(x)):
            t = got.get(j)
            if t is None:
                t = self.next_id
                self.next_id += 1
            self.live[t] = [float(x[j]), float(y[j]), 0]
            seen.add(t)
            out.append(t)
        for t in [t for t in self.live if t not in seen]:
            self.live[t][2] += 1
            if self.live[t][2] > self.p.max_misses:
                del self.live[t]
        return out
