"""State machines and pixel helpers on small known inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perimetra.operators import alerts, blobs, fusion, site
from perimetra.operators.machines import HeldNames, NumberBoard, RegionNames
from perimetra.params import Alerting, Fusion, OpticalSite


def test_names_are_held_then_forgotten(spark):
    rows = [
        (1, "m", 1, 0, "chair", 0.5, 0.0, 0.0, 10.0, 10.0),
        (1, "m", 2, 5_000_000, "cup", 0.4, 50.0, 50.0, 5.0, 5.0),
        (1, "m", 3, 10_000_000, "chair", 0.6, 2.0, 1.0, 10.0, 10.0),
        (1, "m", 4, 18_000_000, "tv", 0.9, 80.0, 80.0, 9.0, 9.0),
        (1, "m", 5, 40_000_000, "tv", 0.9, 80.0, 80.0, 9.0, 9.0),
    ]
    df = spark.createDataFrame(rows, "site_id long, model string, frame_idx long, t_us long, label string, confidence double, x double, y double, w double, h double")
    for span in (None, 2):
        got = {}
        for r in alerts.held_names(df, Fusion(), span).collect():
            got.setdefault(r.frame_idx, set()).add((r.label, r.x))
        assert got == {
            1: {("chair", 0.0)}, 2: {("chair", 0.0), ("cup", 50.0)}, 3: {("chair", 2.0), ("cup", 50.0)}, 4: {("chair", 2.0), ("tv", 80.0)}, 5: {("tv", 80.0)},
        }


def test_region_keeps_its_name_while_it_overlaps(spark):
    rows = [(1, 1, "a", 0, 0, 64, 64, 9.0), (1, 2, "b", 32, 0, 64, 64, 9.1), (1, 3, "c", 64, 0, 64, 64, 9.2), (1, 5, "d", 64, 0, 64, 64, 9.3)]
    df = spark.createDataFrame(rows, "site_id long, tick long, key string, x int, y int, w int, h int, dwell_s double")
    for span in (None, 2):
        assert {r.tick: r.key for r in alerts.region_names(df, span).collect()} == {1: "a", 2: "a", 3: "a", 5: "d"}


def test_first_overlapping_region_gives_the_name():
    m = RegionNames()
    m.feed({"tick": np.array([1]), "regions": [[dict(key="p", x=0, y=0, w=10, h=10, dwell_s=3), dict(key="q", x=5, y=5, w=10, h=10, dwell_s=2)]]})
    out = m.feed({"tick": np.array([2]), "regions": [[dict(key="r", x=6, y=6, w=2, h=2, dwell_s=4)]]})
    assert out["key"] == ["p"]


def test_number_board_reuses_released_numbers():
    m = NumberBoard(Alerting())
    out = m.feed(
        {
            "object_key": ["a", "b", "b", "c"], "frame_idx": np.array([1, 1, 2, 3]),
            "t_us": np.array([0, 0, 9_000_000, 9_500_000]),
        }
    )
    assert out["number"].tolist() == [1, 2, 2, 1]


def test_outline_of_a_square_and_of_a_cross():
    grey = np.full((30, 30), 200.0)
    grey[8:20, 8:20] = 40.0
    area, w, h, solidity = blobs.largest_outline(grey)
    assert (area, w, h, solidity) == (121.0, 12.0, 12.0, 1.0)
    cross = np.zeros((30, 30))
    cross[14:16, 4:26] = 255.0
    cross[4:26, 14:16] = 255.0
    assert blobs.largest_outline(cross)[3] < 0.5


def test_shape_checks_name_a_compact_dark_object(spark):
    g = np.full((60, 80), 180.0)
    g[20:42, 30:54] = 30.0
    frames = spark.createDataFrame([(1, 1, g.ravel().tolist())], "site_id long, frame_idx long, grey array<double>")
    boxes = spark.createDataFrame(
        [(1, 1, 1, 30.0, 20.0, 24.0, 22.0), (1, 1, 2, 500.0, 500.0, 5.0, 5.0)], "site_id long, frame_idx long, det_id long, x double, y double, w double, h double"
    )
    got = {r.det_id: r for r in fusion.shape_checks(boxes, frames, 60, 80).collect()}
    assert (got[1].o_label, got[1].o_pixels, got[1].o_confidence) == ("drone", 483.0, 0.9)
    assert (got[2].o_found, got[2].o_reason) == (False, "thermal detection maps outside the optical frame")


def test_heat_check_of_a_warm_core(spark):
    c = np.full((40, 50), 10.0)
    c[10:16, 10:16] = 14.0
    c[12, 12] = 30.0
    frames = spark.createDataFrame([(1, 1, c.ravel().tolist())], "site_id long, frame_idx long, celsius array<double>")
    boxes = spark.createDataFrame([(1, 1, 1, 10.0, 10.0, 6.0, 6.0), (1, 1, 2, 30.0, 30.0, 4.0, 4.0)], "site_id long, frame_idx long, det_id long, x double, y double, w double, h double")
    got = {r.det_id: r for r in fusion.heat_checks(boxes, frames, 40, 50).collect()}
    assert got[1].warm and got[1].confidence == 0.85 and got[1].peak_c == 30.0
    assert not got[2].warm and got[2].reason == "no heat signature (+0.0 C) - clutter, or cold-soaked"


def test_crowded_frames_are_bundled_in_parts(spark):
    boxes = spark.range(1000).selectExpr("1L AS site_id", "1L AS frame_idx", "id AS det_id", "0D AS x", "0D AS y", "1D AS w", "1D AS h")
    sizes = [len(r["_boxes"]) for r in fusion.bundled(boxes, 100).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 200


def test_optical_model_reads_frozen_and_accepts(spark):
    p = OpticalSite(grid_rows=1, grid_cols=4, cell_px=32, min_learned=20)
    rng = np.random.default_rng(3)
    rows = [(1, f, (1 + rng.normal(0, 0.02, 4)).tolist(), rng.normal(0, 0.03, 4).tolist()) for f in range(60)]
    ddl = "site_id long, frame_idx long, structure array<double>, tone array<double>"
    model = site.learn_optical_model(spark.createDataFrame(rows, ddl), 2, p)
    assert site.optical_maturity(model, p).first().optical_learned
    odd = spark.createDataFrame([(1, 99, [1.0, 3.0, 1.0, 1.0], [0.0] * 4)], ddl)
    z = site.read_optical(odd, model, p).first().z
    assert z[1] > 15 and max(z[0], z[2], z[3]) < 1
    act = spark.createDataFrame([(1, 40, 5, 10, 10)], "site_id long, x int, y int, w int, h int")
    taken = site.accept_optical(model, odd, act, p)
    assert taken.first().accepted_cells == 1
    assert max(site.read_optical(odd, taken.drop("accepted_cells"), p).first().z) < 1


def test_blocks_of_optical_cells_do_not_change_the_result(spark):
    rng = np.random.default_rng(4)
    rows = [(1, f, (1 + rng.normal(0, 0.3, 10)).tolist(), rng.normal(0, 1, 10).tolist()) for f in range(50)]
    df = spark.createDataFrame(rows, "site_id long, frame_idx long, structure array<double>, tone array<double>")

    def cells(block):
        c = site.optical_cells(site.learn_optical(df, block), block).orderBy("frame_idx", "pos").collect()
        return [(r.frame_idx, r.pos, r.z, r.persist) for r in c]

    assert cells(3) == cells(16)


def test_learning_sessions(spark):
    ddl = "site_id long, frame_idx long, t_us long, action string, seconds double, reset boolean"
    rows = [(1, 1, 0, "start_learning", 90.0, True), (1, 50, 95_000_000, "stop_learning", None, None), (1, 60, 100_000_000, "start_learning", None, False)]
    got = site.learning_sessions(spark.createDataFrame(rows, ddl), None).orderBy("started_us").collect()
    assert [(r.ended_us, r.target_s, r.reset, r.done) for r in got] == [(95_000_000, 90.0, True, True), (None, 90.0, False, False)]


def test_traffic_leaves_out_still_and_alerting_objects(spark):
    rows = [(1, 5, 2.0, 40.0, 10.0, False), (1, 5, 0.1, 40.0, 10.0, False), (1, 1, 2.0, 40.0, 10.0, False), (1, 5, 2.0, 40.0, 10.0, True)]
    df = spark.createDataFrame(rows, "site_id long, hits int, speed_px double, cx double, cy double, alerting boolean")
    got = site.activity_cells(site.traffic(df, alerting=F.col("alerting"))).collect()
    assert [(r.gy, r.gx, r.activity) for r in got] == [(1, 5, 1)]


def test_neighbourhood_mirrors_the_border(spark):
    g = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 5.0])], "site_id long, g array<double>")
    got = g.select(site.neighbourhood(F.col("g"), 3, 3, 1).alias("n")).first().n
    pad = np.pad(np.array([[1, 0, 0], [0, 0, 0], [0, 0, 5.0]]), 1, mode="reflect")
    want = [pad[y : y + 3, x : x + 3].sum() for y in range(3) for x in range(3)]
    assert got == pytest.approx(want)


def test_names_come_by_confidence_and_lapse():
    m = HeldNames(Fusion(hold_s=10.0))
    box = lambda label, conf, x: {"label": label, "confidence": conf, "x": x, "y": 0.0, "w": 10.0, "h": 10.0}
    told = m.feed({
        "frame_idx": np.array([1, 2, 3, 4]), "t_us": np.array([0, 5_000_000, 11_000_000, 60_000_000]),
        "found": [[box("cup", 0.5, 0.0), box("cup", 0.9, 50.0)], [box("dog", 0.7, 0.0), box("cup", 0.6, 52.0)], [], []],
    })
    got = [tuple(told[k][i] for k in ("frame_idx", "label", "confidence", "x", "seen_us")) for i in range(len(told["frame_idx"]))]
    assert got == [(1, "cup", 0.9, 50.0, 0), (1, "cup", 0.5, 0.0, 0), (2, "dog", 0.7, 0.0, 5_000_000), (2, "cup", 0.6, 52.0, 5_000_000), (2, "cup", 0.5, 0.0, 0),
                   (3, "dog", 0.7, 0.0, 5_000_000), (3, "cup", 0.6, 52.0, 5_000_000)]
    assert all(isinstance(told[k], np.ndarray) for k in told) and len(m.feed({"frame_idx": np.array([5]), "t_us": np.array([61_000_000]), "found": [[]]})["label"]) == 0
