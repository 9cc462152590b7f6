"""Steps whose work must grow with the rows: same results as the plain way, and no more of them than needed."""

import numpy as np
import pytest

from perimetra.operators import blobs, calibration, fusion, site
from perimetra.params import OpticalSite


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_box_novelty_of_repeated_boxes_and_missing_cells(spark):
    p = OpticalSite(grid_rows=3, grid_cols=4, cell_px=10, persist_s=0.04, fps=25.0, z_anomalous=2.0, z_full=4.0)
    rng = np.random.default_rng(3)
    cells = [(1, f, pos, None if pos == 5 else float(rng.integers(0, 50)) / 10, int(rng.integers(0, 3))) for f in (1, 2) for pos in range(12) if pos != 7]
    cells += [(1, 1, 0, 9.0, 0), (1, 2, None, 9.0, 9)]
    boxes = [(1, f, int(b), int(x), int(y), int(w), 8) for f in (1, 2, 3) for b, x, y, w in zip(range(12), rng.integers(-9, 50, 12), rng.integers(-9, 35, 12), rng.integers(1, 25, 12))]
    boxes += [(1, 1, 0, 0, 0, 5, 5), (1, 1, None, 0, 0, 5, 5), (1, 1, 70, 31, 11, 2, 2), (None, 1, 71, 0, 0, 5, 5)]
    want = {}
    for s, f, b, x, y, w, h in boxes:
        spots = [gy * 4 + gx for gy in range(max(0, y // 10), min(3, (y + h) // 10 + 1)) for gx in range(max(0, x // 10), min(4, (x + w) // 10 + 1))]
        met = [c for c in cells if c[:2] == (s, f) and c[2] in spots]
        if met:
            want.setdefault((f, b), []).extend(met)
    told = {}
    for key, met in want.items():
        z = [c[3] for c in met if c[3] is not None]
        peak = max(z) if z else None
        ramp = 0.0 if peak is None else max(0.0, min(1.0, (peak - 2.0) / 2.0))
        told[key] = (peak, any(c[4] >= p.persist_frames for c in met), ramp)
    b = spark.createDataFrame(boxes, "site_id long, frame_idx long, box_id long, x int, y int, w int, h int")
    c = spark.createDataFrame(cells, "site_id long, frame_idx long, pos int, z double, persist long")
    df = site.optical_box_novelty(b, c, p)
    got = {(r.frame_idx, r.box_id): r for r in df.collect()}
    assert got.keys() == told.keys()
    for key, (peak, settled, ramp) in told.items():
        assert got[key].peak_z == peak
        if peak is not None:
            assert got[key].optical_novelty == pytest.approx(max(ramp, p.settled_novelty) if settled else ramp)
    assert "explode" not in _plan(df)  # boxes are not multiplied by the cells they cover


def test_outlines_of_many_crops_are_those_of_each():
    rng = np.random.default_rng(5)
    crops = [None]
    for k in range(400):
        shape = rng.integers(1, 9, 2)
        crops.append(rng.integers(0, 256, shape).astype(float) if k % 2 else (rng.random(shape) < 0.2 + 0.2 * (k % 4)) * 200.0)
    crops += [(rng.random((20, 31)) < 0.6) * 90.0, (rng.random((40, 40)) < 0.5) * 90.0, np.full((3, 3), 7.0), np.array([[np.nan, 9.0], [9.0, 200.0]])]
    got = blobs.largest_outlines(crops)
    for c, g in zip(crops, got):
        want = None if c is None else blobs.largest_outline(c)
        assert np.isnan(g).all() if want is None else tuple(g) == tuple(want)


def test_shape_checks_are_dealt_to_a_fixed_count_of_tasks(spark):
    boxes = spark.createDataFrame([(1, 1, d, 1.0, 1.0, 3.0, 3.0) for d in range(40)], "site_id long, frame_idx long, det_id long, x double, y double, w double, h double")
    frames = spark.createDataFrame([(1, 1, [float(v % 7 * 30) for v in range(64)])], "site_id long, frame_idx long, grey array<double>")
    df = fusion.shape_checks(boxes, frames, 8, 8)
    assert df.count() == 40
    assert "RepartitionByExpression" in _plan(df)


def test_few_fragments_join_as_many_do(monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(300):
        n = int(rng.integers(1, 14))
        x, y, w, h = rng.integers(0, 90, n), rng.integers(0, 90, n), rng.integers(0, 16, n), rng.integers(0, 16, n)
        area = w * h * rng.random(n)
        few = blobs.joined_fragments(x, y, w, h, area, 256, 192)
        with monkeypatch.context() as m:
            m.setattr(blobs, "FEW_FRAGMENTS", 0)
            assert blobs.joined_fragments(x, y, w, h, area, 256, 192) == few
    assert blobs.joined_fragments([0, None], [0, 0], [5, 5], [5, 5], [9.0, 9.0], 256, 192) == [[0], [1]]


def test_heat_of_small_frames_is_that_of_lists_of_boxes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    frames = [(s, 1, [None if s == 2 and i % 9 == 4 else float(v) for i, v in enumerate(rng.integers(100, 300, 48) / 10)]) for s in (1, 2)]
    frames += [(3, 1, None), (4, 1, [20.0] * 48), (4, 1, [21.0] * 48)]
    boxes = [(s, 1, d, float(x), float(y), float(w), 2.5) for s in (1, 2, 3, 4, 5) for d, x, y, w in zip(range(40), rng.integers(-4, 10, 40), rng.integers(-4, 8, 40), rng.integers(0, 9, 40))]
    boxes += [(1, 1, 0, 1.0, 1.0, 2.0, 2.0), (1, 1, None, 1.0, 1.0, 2.0, 2.0), (1, 1, 90, None, 1.0, 2.0, 2.0), (None, 1, 91, 1.0, 1.0, 2.0, 2.0)]
    b = spark.createDataFrame(boxes, "site_id long, frame_idx long, det_id long, x double, y double, w double, h double")
    f = spark.createDataFrame(frames, "site_id long, frame_idx long, celsius array<double>")
    few = fusion.heat_checks(b, f, 6, 8)
    got = sorted(map(repr, few.collect()))
    assert "collect_list" not in _plan(few)  # boxes are shuffled for no list
    monkeypatch.setattr(fusion, "BESIDE_PX", 0, raising=False)
    many = fusion.heat_checks(b, f, 6, 8)
    assert "collect_list" in _plan(many) and few.columns == many.columns and few.dtypes == many.dtypes
    assert got == sorted(map(repr, many.collect())) and len(got) == 40 * 5 + 3


def test_mover_pairs_meet_in_one_shuffle(spark):
    rng = np.random.default_rng(13)
    made = {c: [(int(s), int(t), None if k == 7 else float(k), float(k) / 2) for k, (s, t) in enumerate(zip(rng.integers(1, 4, 60), rng.integers(0, 12, 60)))] for c in "to"}
    for c in "to":
        made[c] += [(None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (9, 1, 1.0, 2.0), (9, 1, 1.0, 2.0)] + [(8, c == "t", 1.0, float(k)) for k in range(50)]
    want = []
    for s, t, x, y in made["t"]:
        at = [[r for r in made[c] if r[:2] == (s, t)] for c in "to"]
        if s is not None and t is not None and len(at[0]) <= 2 and len(at[1]) <= 3:
            want += [(s, t, x, y, *r[2:]) for r in at[1]]
    t, o = (spark.createDataFrame([(s, None if k is None else int(k), x, y) for s, k, x, y in made[c]], "site_id long, tick long, cx double, cy double") for c in "to")
    df = calibration.mover_pairs(t, o)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and len(want) > 20
    assert df.columns == ["site_id", "tick", "tx", "ty", "ox", "oy"]
    assert "Join" not in _plan(df)
