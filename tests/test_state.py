"""Alerts, dwell, numbers and tracks against plain loops."""

import math
import random

import numpy as np
import pytest

from perimetra.operators import alerts, tracks
from perimetra.params import Alerting, Tracking

A = "site_id long, key string, frame_idx long, t_us long, threat double, label string, dwell_s double"


def loop(rows, clock, p):
    """One site, frame by frame."""
    by_frame = {}
    for r in rows:
        by_frame.setdefault(r[2], []).append(r)
    streak, live, done = {}, {}, []
    for frame, t in clock:
        seen = set()
        for _, key, _, _, threat, _, _ in by_frame.get(frame, []):
            over = threat >= p.threshold
            streak[key] = streak.get(key, 0) + 1 if over else 0
            if key in live:
                seen.add(key)
                live[key].update(updated=t, frames=live[key]["frames"] + 1, peak=max(live[key]["peak"], threat))
            elif over and streak[key] >= p.open_after:
                seen.add(key)
                live[key] = dict(key=key, opened=t, updated=t, frames=2, peak=threat)
        for key in list(live):
            if key not in seen and t - live[key]["updated"] >= p.close_after_s * 1e6:
                done.append({**live.pop(key), "closed": t})
                streak.pop(key, None)
    done += [{**a, "closed": None} for a in live.values()]
    return sorted((a["key"], a["opened"], a["updated"], a["closed"] or 0, a["frames"], round(a["peak"], 9)) for a in done)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_alert_life(spark, seed):
    rng = random.Random(seed)
    clock = [(f, f * 1_000_000) for f in range(1, 160)]
    rows = []
    for key in ("a", "b", "c"):
        here = True
        for f, t in clock:
            if rng.random() < 0.12:
                here = not here
            if here:
                rows.append((1, key, f, t, rng.choice([0.2, 0.8, 0.9, 0.95]), "drone", 0.0))
    p = Alerting(open_after=3, close_after_s=5.0)
    df = spark.createDataFrame(rows, A)
    ticks = spark.createDataFrame([(1, f, t) for f, t in clock], "site_id long, frame_idx long, t_us long")
    for span, span_us in ((None, None), (20, 15_000_000)):
        got = alerts.alert_intervals(df, ticks, p, span, span_us).collect()
        made = sorted((r.key, r.opened_us, r.updated_us, r.closed_us or 0, r.frames, round(r.peak_threat, 9)) for r in got)
        assert made == loop(rows, clock, p)


def test_settled_object_is_one_alert(spark):
    rows = [(1, "static:3:4", f, f * 40_000, 0.84, "settled object", f / 25) for f in range(500)]
    clock = spark.createDataFrame([(1, f, f * 40_000) for f in range(700)], "site_id long, frame_idx long, t_us long")
    got = alerts.alert_intervals(spark.createDataFrame(rows, A), clock).collect()
    assert len(got) == 1
    assert got[0].closed_us == 499 * 40_000 + 5_000_000
    events = alerts.alert_events(alerts.with_level(alerts.with_alert_ids(alerts.alert_intervals(spark.createDataFrame(rows, A), clock))))
    assert sorted(r.event for r in events.collect()) == ["close", "open"]


def test_operator_actions(spark):
    rows = [(1, "k", f, f * 40_000, 0.9, "drone", 0.0, None) for f in range(0, 40, 2)]
    rows += [(1, "k", 21, 21 * 40_000, None, None, None, "ack"), (1, "k", 31, 31 * 40_000, None, None, None, "clear")]
    clock = spark.createDataFrame([(1, f, f * 40_000) for f in range(60)], "site_id long, frame_idx long, t_us long")
    df = spark.createDataFrame(rows, A + ", action string")
    gone = alerts.alert_intervals(df, clock, Alerting(open_after=8)).collect()
    assert [(r.opened_us, r.closed_us, r.cleared, r.acked) for r in gone] == [(14 * 40_000, 31 * 40_000, True, True)]
    kept = alerts.alert_intervals(df.filter("action IS NULL OR action = 'ack'"), clock, Alerting(open_after=8)).collect()
    assert [r.acked for r in kept] == [True]


def test_an_action_during_an_absence_changes_nothing_already_closed(spark):
    rows = [(1, "k", f, f * 1_000_000, 0.9, "drone", 0.0, None) for f in [*range(1, 12), *range(30, 33)]]
    rows.append((1, "k", 20, 20_000_000, None, None, None, "clear"))
    clock = spark.createDataFrame([(1, f, f * 1_000_000) for f in range(1, 60)], "site_id long, frame_idx long, t_us long")
    df = spark.createDataFrame(rows, A + ", action string")
    for span, span_us in ((None, None), (7, 5_000_000)):
        got = alerts.alert_intervals(df, clock, Alerting(open_after=8), span, span_us).collect()
        assert [(r.opened_us, r.closed_us) for r in got] == [(8_000_000, 16_000_000)]


def test_dwell_parts_give_the_loop(spark):
    rng = random.Random(8)
    rows, x, y = [], 50.0, 50.0
    for f in range(1, 200):
        if rng.random() < 0.05:
            x, y = x + rng.uniform(-30, 30), y + rng.uniform(-30, 30)
        x, y = x + rng.uniform(-0.7, 0.7), y + rng.uniform(-0.7, 0.7)
        rows.append((1, 1, f, f * 40_000, x, y, 10.0))
    df = spark.createDataFrame(rows, "site_id long, track_id long, frame_idx long, t_us long, cx double, cy double, area double")
    anchor = since = None
    want = {}
    for _, _, f, t, cx, cy, _ in rows[3:]:
        if anchor is None:
            anchor = (cx, cy)
        elif math.dist(anchor, (cx, cy)) > 3.0:
            anchor, since = (cx, cy), None
        elif since is None:
            since = t
        want[f] = (t - since) / 1e6 if since is not None else 0.0
    for span in (None, 16):
        got = alerts.dwell(tracks.kinematics(df, span=span), span=span).collect()
        assert {r.frame_idx: r.dwell_s for r in got} == pytest.approx(want)


def test_numbers_are_reused_after_a_long_absence(spark):
    def on(key, frames):
        return [(1, key, f, f * 1_000_000, 0.1, "bird", 0.0) for f in frames]

    rows = on("a", range(1, 4)) + on("b", range(2, 40)) + on("c", range(8, 40)) + on("d", range(20, 40)) + on("a", range(30, 40))
    clock = spark.createDataFrame([(1, f, f * 1_000_000) for f in range(1, 41)], "site_id long, frame_idx long, t_us long")
    got = sorted((r.key, r.start_frame, r.number) for r in alerts.object_numbers(spark.createDataFrame(rows, A), clock).collect())
    assert got == [("a", 1, 1), ("a", 30, 4), ("b", 2, 2), ("c", 8, 3), ("d", 20, 1)]


def test_tracker_parts_match_one_run(spark):
    rng = random.Random(11)
    rows, det = [], 0
    for f in range(200):
        if f % 50 > 30:
            continue
        for k in range(3):
            if rng.random() < 0.8:
                rows.append((1, f, det, 40.0 * k + (f % 50) * 0.9 + rng.uniform(-1, 1), 30.0 * k + rng.uniform(-1, 1), 10.0 + k))
                det += 1
    df = spark.createDataFrame(rows, "site_id long, frame_idx long, det_id long, cx double, cy double, area double")
    p = Tracking(max_step_px=12.0, max_misses=4)
    from perimetra.operators.machines import Tracker

    import numpy as np

    ordered = sorted(rows, key=lambda r: (r[1], -r[5], r[2]))
    cols = {n: np.array([r[i] for r in ordered]) for n, i in (("frame_idx", 1), ("det_id", 2), ("cx", 3), ("cy", 4))}
    whole = Tracker(p).feed(cols)
    want = dict(zip(whole["det_id"].tolist(), whole["track_no"].tolist()))
    assert {r.det_id: r.track_id for r in alerts.tracked(df, p, None).collect()} == want


def test_tracks_of_a_busy_site_run_in_parts(spark):
    from perimetra.operators.machines import Tracker

    rng = random.Random(8)
    rows = []
    for f in range(1, 400):
        for k in range(9):  # nine objects that wander about corners of the frame, some of which meet
            if rng.random() < 0.9:
                x, y = 80 * (k % 3) + 20 * math.sin(f / 17 + k) + rng.random(), 70 * (k // 3) + 25 * math.cos(f / 23) + rng.random()
                rows.append((1 + (f % 97 == 0), f, len(rows), x, y, rng.choice([5.0, 9.0])))
        if f % 40 == 0:
            rows.append((1, f, len(rows), 120.0 + f / 4, 100.0, 7.0))
    p = Tracking(max_step_px=12.0, max_misses=3)
    df = spark.createDataFrame(rows, "site_id long, frame_idx long, det_id long, cx double, cy double, area double")
    want = {}
    for site in (1, 2):
        mine = sorted((r for r in rows if r[0] == site), key=lambda r: (r[1], -r[5], r[2]))
        cols = {k: np.array([r[i] for r in mine]) for i, k in enumerate(("site_id", "frame_idx", "det_id", "cx", "cy", "area"))}
        told = Tracker(p).feed(cols)
        want |= {(site, int(d)): int(t) for d, t in zip(told["det_id"], told["track_no"])}
    assert {(r.site_id, r.det_id): r.track_id for r in alerts.tracked(df, p, None).collect()} == want
    parts = alerts.tracking_parts(df, p, None)
    assert parts.count() == len(rows) and parts.filter("site_id = 1").select("_part").distinct().count() >= 6
    # nothing of one part is ever within reach of another
    seen = [tuple(r) for r in parts.select("site_id", "frame_idx", "cx", "cy", "_part").collect()]
    for a in seen:
        for b in seen:
            if a[0] == b[0] and a[4] < b[4] and abs(a[1] - b[1]) <= 4:
                assert math.hypot(a[2] - b[2], a[3] - b[3]) > 12
    assert alerts.tracked(df.filter("false"), p, None).collect() == []
