"""What operators do reaches every state that has to know, in the order of frames, on streams as in batch."""

import random

from pyspark.sql import functions as F
from test_streaming import as_stream, drain, ticking

from perimetra.operators import alerts, controls, site
from perimetra.params import Alerting, Fusion, OpticalSite, ThermalSite
from perimetra.queries.controls import ACTION_COLUMNS
from perimetra.streaming import keyed

P = ThermalSite(min_learned=12, adapt_s=1.6, grid_rows=4, grid_cols=5, cell_px=8)
O = OpticalSite(min_learned=10, grid_rows=4, grid_cols=5, cell_px=32)


def acted(spark, *rows):
    names = [c.split()[0] for c in ACTION_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ACTION_COLUMNS)


def scene(spark, n=80, seed=2):
    r = random.Random(seed)
    rows = [(1, f, f * 40_000, [r.gauss(0, 0.2) + (6.0 if f > 40 and k == 7 else 0) for k in range(20)]) for f in range(1, n + 1)]
    return spark.createDataFrame(rows, "site_id long, frame_idx long, t_us long, rel array<double>")


def literally(frames, acts, p=P):
    """The learner as plain loops over cells, variance kept apart."""
    mean, var, n, streak, out = [0.0] * 20, [0.0] * 20, [0.0] * 20, [0] * 20, {}
    for f, rel in frames:
        z = [abs(v - m) / max(s**0.5, 0.35) if k >= p.min_learned else 0.0 for v, m, s, k in zip(rel, mean, var, n)]
        odd = [a > p.z_enter and abs(v - m) > 1.0 for a, v, m in zip(z, rel, mean)]
        if sum(odd) / 20 > 0.10:
            odd = [False] * 20
        for i in range(20):
            streak[i] = streak[i] + 1 if odd[i] else max(streak[i] - 3, 0)
            n[i] += not odd[i]
            a = p.alpha_floor / 40 if odd[i] else max(1 / max(n[i], 1), p.alpha_floor)
            d = rel[i] - mean[i]
            mean[i] += a * d
            var[i] = (1 - a) * (var[i] + a * d * d)
        out[f] = (max(z), list(streak))
        for action, cells in acts.get(f, []):
            if action == "reset":
                mean, var, n, streak = [0.0] * 20, [0.0] * 20, [0.0] * 20, [0] * 20
            for i in cells or []:
                mean[i], var[i], n[i], streak[i] = rel[i], max(var[i], 0.35**2), max(n[i], 10.0), 0
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for f, (z, streak) in want.items():
        assert abs(got[f][0] - z) < 1e-9 and got[f][1] == streak, f


def test_learning_with_actions_in_batch_and_on_a_stream(spark, tmp_path):
    frames = scene(spark)
    acts = acted(
        spark,
        {"site_id": 1, "frame_idx": 50, "t_us": 50 * 40_000, "action": "accept", "sensor": "thermal", "x": 17.0, "y": 9.0, "w": 2.0, "h": 3.0},
        {"site_id": 1, "frame_idx": 60, "t_us": 60 * 40_000, "action": "start_learning", "reset": True},
        {"site_id": 1, "frame_idx": 63, "t_us": 63 * 40_000, "action": "accept", "sensor": "thermal", "x": 0.0, "y": 0.0, "w": 4.0, "h": 4.0},
        {"site_id": 1, "frame_idx": 70, "t_us": 70 * 40_000, "action": "start_learning", "reset": False},
        {"site_id": 1, "frame_idx": 71, "t_us": 71 * 40_000, "action": "ack", "alert_id": 1},
    )
    rows = controls.for_thermal(acts, p=P)
    dealt = {r.frame_idx: (r.action, r.cells) for r in rows.collect()}
    assert dealt == {50: ("accept", [7]), 60: ("reset", None), 63: ("accept", [0])}
    want = literally([(r.frame_idx, r.rel) for r in frames.orderBy("frame_idx").collect()], {f: [a] for f, a in dealt.items()})
    assert want[50][1][7] > 8 and want[51][1][7] == 0
    same({r.frame_idx: (max(r.z), r.persist) for r in site.learn_frames(frames, P, rows).collect()}, want)
    model = site.learn_model(frames, P, rows).first()
    assert model.frames == 20 and model.ref_n[0] > 20  # an accepted cell counts ten readings at least, on its fourth frame

    ts = F.timestamp_micros("t_us")
    stream = keyed.learned_site(
        as_stream(frames.withColumn("ts", ts), tmp_path, "frames", 4), P, actions=as_stream(rows.withColumn("ts", ts).select("site_id", "frame_idx", "t_us", "ts", "act", "action", "cells"), tmp_path, "acts", 1)
    )
    got = drain(stream, "controlled", tmp_path).filter("site_id = 1").collect()
    same({r.frame_idx: (max(r.z), r.persist) for r in got}, want)


def test_a_box_goes_to_the_models_of_both_sensors(spark):
    by_two = spark.createDataFrame([(1, [4.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 1.0]), (2, [0.0] * 9)], "site_id long, h array<double>")
    box = {"action": "accept", "sensor": "optical", "t_us": 0, "frame_idx": 5, "x": 70.0, "y": 33.0, "w": 20.0, "h": 20.0}
    acts = acted(spark, {"site_id": 1, **box}, {"site_id": 2, **box}, {"site_id": 3, **box}, {"site_id": 1, **box, "sensor": "thermal", "x": 33.0, "y": 1.0, "w": 1.0, "h": 1.0})
    assert {(r.site_id, tuple(r.cells)) for r in controls.for_optical(acts, O).collect()} == {(s, (7,)) for s in (1, 2, 3)}
    # 70..90 x 33..53 optical pixels are 18..22 x 8..13 thermal ones; sites 2 and 3 have no way back
    assert {(r.site_id, tuple(r.cells)) for r in controls.for_thermal(acts, by_two, P).collect()} == {(1, (7,)), (1, (4,))}
    assert {(r.site_id, tuple(r.cells)) for r in controls.for_thermal(acts, None, P).collect()} == {(1, (4,))}


def test_optical_learning_with_actions(spark):
    r = random.Random(3)
    rows = [(1, f, [r.gauss(0, 0.02) + (2.0 if f > 30 and k == 7 else 0) for k in range(20)], [0.0] * 20) for f in range(1, 61)]
    frames = spark.createDataFrame(rows, "site_id long, frame_idx long, structure array<double>, tone array<double>")
    acts = acted(
        spark,
        {"site_id": 1, "frame_idx": 40, "t_us": 0, "action": "accept", "sensor": "optical", "x": 70.0, "y": 40.0, "w": 4.0, "h": 4.0},
        {"site_id": 1, "frame_idx": 50, "t_us": 0, "action": "start_learning"},
    )
    told = site.optical_cells(site.learn_optical(frames, 6, O, controls.for_optical(acts, O)), 6)
    cell = {r.frame_idx: r for r in told.filter("pos = 7").collect()}
    plain = {r.frame_idx: r for r in site.optical_cells(site.learn_optical(frames, 6, O), 6).filter("pos = 7").collect()}
    assert cell[40].persist == plain[40].persist == 10 and cell[41].persist == 0 and plain[41].persist == 11
    assert cell[41].z < 1 < plain[41].z and cell[51].ref_n == 1.0 and cell[51].z == 0.0
    assert len(told.filter("frame_idx = 51 AND ref_n = 1").collect()) == 20


def test_accepting_ends_the_alert_and_the_dwell_of_its_track(spark):
    rows = [(1, "track:4", f, f * 1_000_000, 0.9, "drone", 1.0, 4, 9, 10.0, 10.0) for f in range(1, 31)]
    a = spark.createDataFrame(rows, "site_id long, key string, frame_idx long, t_us long, threat double, label string, dwell_s double, track_id long, hits int, cx double, cy double")
    acts = acted(spark, {"site_id": 1, "frame_idx": 12, "t_us": 12_000_000, "action": "accept", "key": "track:4", "sensor": "thermal", "x": 1.0, "y": 1.0, "w": 1.0, "h": 1.0})
    clock = a.select("site_id", "frame_idx", "t_us")
    p = Alerting(open_after=8)
    out = alerts.alert_intervals(controls.for_alerts(a, acts), clock, p, None, None).orderBy("opened_frame").collect()
    assert [(r.opened_frame, r.closed_us, r.cleared) for r in out] == [(8, 12_000_000, True), (20, None, False)]
    d = {r.frame_idx: r.dwell_s for r in alerts.dwell(a, Fusion(), None, controls.for_dwell(acts)).collect()}
    assert d[12] == 10.0 and d[13] == 0.0 and d[14] == 0.0 and d[15] == 1.0


def test_acknowledging_open_and_closed_alerts(spark):
    told = spark.createDataFrame([(1, 1, 100, 200, False), (1, 2, 150, None, False), (1, 3, 400, None, False), (2, 1, 100, None, False)], "site_id long, alert_id long, opened_us long, closed_us long, acked boolean")
    acts = acted(spark, *[{"site_id": s, "frame_idx": 1, "t_us": t, "action": "ack", "alert_id": i} for s, i, t in ((1, 1, 300), (1, 2, 160), (1, 3, 300), (1, 9, 300))])
    got = {(r.site_id, r.alert_id): r.acked for r in alerts.acknowledged(told, controls.acks(acts)).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False}


def test_forgetting_names(spark):
    rows = [(1, m, f, f * 1_000_000, "chair", 0.9, 1.0, 1.0, 5.0, 5.0) for m in ("a", "b") for f in (1,)]
    rows += [(1, m, f, f * 1_000_000, "person", 0.8, 50.0, 1.0, 5.0, 5.0) for m in ("a", "b") for f in (3, 5)]
    found = spark.createDataFrame(rows, "site_id long, model string, frame_idx long, t_us long, label string, confidence double, x double, y double, w double, h double")
    acts = acted(spark, {"site_id": 1, "frame_idx": 3, "t_us": 3_000_000, "action": "forget_names"}, {"site_id": 2, "frame_idx": 1, "t_us": 1, "action": "forget_names"})
    names = lambda out, f: sorted((r.model, r.label) for r in out if r.frame_idx == f)
    out = alerts.held_names(found, Fusion(), None, controls.forgets(acts)).collect()
    assert names(out, 3) == [("a", "chair"), ("a", "person"), ("b", "chair"), ("b", "person")]
    assert names(out, 5) == [("a", "person"), ("b", "person")]
    assert names(alerts.held_names(found, Fusion(), None).collect(), 5) == names(out, 3)


def test_an_alerting_track_leaves_no_traffic(spark, tmp_path):
    rows = [(1, t, f, f * 1_000_000, 8.0 * f, 4.0, 20.0, f, 2.0) for t in (5, 6) for f in range(1, 21)]
    seen = spark.createDataFrame(rows, "site_id long, track_id long, frame_idx long, t_us long, cx double, cy double, area double, hits long, speed_px double")
    alarms = seen.filter("track_id = 5 AND frame_idx BETWEEN 6 AND 12").select("site_id", "track_id", "frame_idx", "t_us")
    batch = site.traffic(site.alarming_before(seen, alarms), alerting=F.col("alarming"))
    want = sorted((r.track_id, r.frame_idx) for r in batch.collect())
    assert want == sorted([(6, f) for f in range(2, 21)] + [(5, f) for f in range(2, 21) if not 7 <= f <= 13])
    ts = F.timestamp_micros("t_us")
    one = as_stream(seen.withColumn("ts", ts), tmp_path, "seen", 4)
    path = str(tmp_path / "alarms")
    alarms.withColumn("ts", ts).coalesce(1).write.parquet(path)
    told = drain(keyed.traffic(one, ticking(alarms.withColumn("ts", ts), path)), "traffic_out", tmp_path).filter("site_id = 1").collect()
    assert sorted((r.track_id, r.frame_idx) for r in told) == want
