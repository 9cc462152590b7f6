"""Outlines of blobs: holes, what lies in them, corners that touch, thin lines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perimetra.operators import blobs
from perimetra.params import Detect, Sensor


def grid(*lines):
    return np.array([[c == "#" for c in line] for line in lines])


def told(mask, values=None):
    v = np.arange(mask.size, dtype=float).reshape(mask.shape) if values is None else values
    return {(b["x"], b["y"], b["w"], b["h"]): b for b in blobs.frame_blobs(mask, v, v)}


def test_a_ring_is_measured_with_its_hole():
    got = told(grid(".......", ".#####.", ".#...#.", ".#...#.", ".#####.", "......."))
    b = got[(1, 1, 5, 4)]
    assert len(got) == 1 and b["area"] == 4 * 3 and (b["cx"], b["cy"]) == (3.0, 2.5) and not b["thin"]
    assert b["mean"] == np.mean([7 * y + x for y in range(1, 5) for x in range(1, 6)]) and b["peak"] == 7 * 4 + 5


def test_nested_rings_are_one_outline():
    mask = np.zeros((13, 13), bool)
    for lo, hi in ((1, 11), (4, 8)):
        mask[lo : hi + 1, lo : hi + 1] = True
        mask[lo + 1 : hi, lo + 1 : hi] = False
    got = told(mask)
    assert list(got) == [(1, 1, 11, 11)] and got[(1, 1, 11, 11)]["area"] == 100.0
    mask[6, 0] = True  # a bump that touches by an edge moves the outline out by one
    assert told(mask)[(0, 1, 12, 11)]["area"] == 101.0


def test_touching_corners_and_a_gap():
    two = grid("###...", "###...", "###...", "...###", "...###", "...###")
    assert list(told(two)) == [(0, 0, 6, 6)] and told(two)[(0, 0, 6, 6)]["area"] == 8.0
    cup = grid("#.###", "#...#", "#####")
    assert told(cup)[(0, 0, 5, 3)]["area"] == 1.5  # open at the top: three corners of half a square
    diamond = grid(".#.", "#.#", ".#.")
    assert told(diamond)[(0, 0, 3, 3)]["area"] == 2.0 and told(diamond)[(0, 0, 3, 3)]["mean"] == 4.0


@pytest.mark.parametrize("lines,points", [(["#"], 1), (["##"], 2), (["#####"], 2), (["#..", ".#.", "..#"], 2), (["##.", "..#"], 4), (["##", "#."], 3), (["#.#", ".#."], 4), (["#.#", ".#.", "#.#"], 8)])
def test_thin_blobs_count_corners(lines, points):
    (b,) = blobs.frame_blobs(grid(*lines), grid(*lines).astype(float), grid(*lines).astype(float))
    assert b["thin"] and b["area"] == points


def test_labels_equal_a_flood():
    r = np.random.default_rng(5)
    for share in (0.3, 0.5, 0.65, 0.9):
        mask = r.random((23, 31)) < share
        for corners in (True, False):
            got, want = blobs.label_mask(mask, corners), np.full(mask.shape, -1)
            for start in map(tuple, np.argwhere(mask)):
                if want[start] >= 0:
                    continue
                stack = [start]
                while stack:
                    y, x = stack.pop()
                    if not (0 <= y < 23 and 0 <= x < 31) or not mask[y, x] or want[y, x] >= 0:
                        continue
                    want[y, x] = start[0] * 31 + start[1]
                    stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if corners or not (dy and dx)]
            assert (got == want).all()


def traced(mask):
    """Area and centre of the outline walked around pixel by pixel, by the shoelace formula."""
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    p = np.pad(mask, 1)
    at = start = tuple(np.argwhere(p)[0])
    way, path, first = 4, [], None
    while True:
        for k in range(1, 9):
            d = (way + k) % 8
            if p[at[0] + around[d][0], at[1] + around[d][1]]:
                break
        if (at, d) == first:
            break
        first = first or (at, d)
        path.append(at)
        at, way = (at[0] + around[d][0], at[1] + around[d][1]), (d + 4) % 8
    pairs = list(zip(path, path[1:] + path[:1]))
    area = sum(a[1] * b[0] - b[1] * a[0] for a, b in pairs) / 2
    cx = sum((a[1] + b[1]) * (a[1] * b[0] - b[1] * a[0]) for a, b in pairs) / (6 * area) - 1 if area else None
    cy = sum((a[0] + b[0]) * (a[1] * b[0] - b[1] * a[0]) for a, b in pairs) / (6 * area) - 1 if area else None
    return area, cx, cy


def test_areas_and_centres_equal_the_walk_around_the_outline():
    r = np.random.default_rng(7)
    seen = 0
    for _ in range(40):
        mask = blobs._window(r.random((20, 26)) < 0.12, 3, True) & (r.random((20, 26)) < 0.93)
        full = blobs.without_holes(mask)
        lab = blobs.label_mask(full)
        for b in blobs.frame_blobs(mask, mask.astype(float), mask.astype(float)):
            area, cx, cy = traced(lab == b["blob"])
            assert abs(area) == (b["area"] if not b["thin"] else abs(area))
            if not b["thin"]:
                assert b["cx"] == pytest.approx(cx) and b["cy"] == pytest.approx(cy)
                seen += 1
    assert seen > 100


def test_motion_only_inside_the_footprint(spark):
    rng = random.Random(3)
    small = Sensor(rows=10, cols=15, optical_rows=40, optical_cols=60)
    rows = []
    for site in (1, 2, 3):
        for f in range(1, 31):
            v = [100 + rng.gauss(0, 1) for _ in range(2400)]
            if f > 24:
                for y0, x0 in ((5, 6), (20, 30)):
                    for y in range(y0, y0 + 6):
                        for x in range(x0, x0 + 6):
                            v[y * 60 + x] -= 60
            rows.append((site, f, v))
    frames = spark.createDataFrame(rows, "site_id long, frame_idx long, values array<double>")
    # site 1 sees the lower right part, site 2 has no map, site 3 looks past the frame
    h = [(1, [3.0, 0.0, 15.0, 0.0, 2.4, 16.0, 0.0, 0.0, 1.0]), (3, [1.0, 0.0, 900.0, 0.0, 1.0, 900.0, 0.0, 0.0, 1.0])]
    maps = spark.createDataFrame(h, "site_id long, h array<double>")
    seen = blobs.within_footprint(frames, maps, small, Detect(roi_pad_px=2))
    roi = {r.site_id: r.roi and tuple(r.roi) for r in seen.select("site_id", "roi").distinct().collect()}
    assert roi == {1: (13.0, 14.0, 47.0, 26.0), 2: None, 3: None}
    found = blobs.detect_adaptive(seen, 40, 60, optical=True).filter("frame_idx = 30").collect()
    assert sorted((r.site_id, r.x, r.y, r.w, r.h, r.area, r.darker) for r in found) == [
        (1, 30, 20, 6, 6, 25, True), (2, 6, 5, 6, 6, 25, True), (2, 30, 20, 6, 6, 25, True), (3, 6, 5, 6, 6, 25, True), (3, 30, 20, 6, 6, 25, True),
    ]
    again = blobs.detect_frozen(seen.withColumn("background", F.transform("values", lambda v: F.lit(100.0))).filter("frame_idx = 30"), 40, 60, 20.0, True)
    assert sorted((r.site_id, r.x, r.blob) for r in again.collect()) == sorted((r.site_id, r.x, r.blob) for r in found)
