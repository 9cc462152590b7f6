"""Matching and grouping agree with plain loops."""

import math
import random

import pytest

from perimetra.operators import blobs
from perimetra.operators.matching import box_groups, greedy_pairs

L = "site_id long, frame_idx long, l_id long, l_ord long, lx double, ly double, radius double"
R = "site_id long, frame_idx long, r_id long, r_ord long, rx double, ry double"


def points(seed, frames=4, n=25):
    rng = random.Random(seed)
    left = [(1, f, i, i, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(5, 30)) for f in range(frames) for i in range(n)]
    right = [(1, f, i, i, rng.uniform(0, 100), rng.uniform(0, 100)) for f in range(frames) for i in range(n)]
    return left, right


def in_turn(left, right):
    out = set()
    for f in {r[1] for r in left}:
        free = [r for r in right if r[1] == f]
        for l in sorted((x for x in left if x[1] == f), key=lambda x: x[3]):
            best = min(((math.dist(l[4:6], r[4:6]), r[3], r) for r in free), default=None)
            if best and best[0] < l[6]:
                out.add((f, l[2], best[2][2]))
                free.remove(best[2])
    return out


def closest(left, right):
    out = set()
    for f in {r[1] for r in left}:
        pairs = sorted((math.dist(l[4:6], r[4:6]), l[3], r[3], l[2], r[2], l[6]) for l in left if l[1] == f for r in right if r[1] == f)
        ls, rs = set(), set()
        for d, _, _, l, r, rad in pairs:
            if d <= rad and l not in ls and r not in rs:
                ls.add(l)
                rs.add(r)
                out.add((f, l, r))
    return out


@pytest.mark.parametrize("nearest_first", [False, True])
def test_matching(spark, nearest_first):
    left, right = points(7)
    got = greedy_pairs(spark.createDataFrame(left, L), spark.createDataFrame(right, R), closest_first=nearest_first)
    assert {(r.frame_idx, r.l_id, r.r_id) for r in got.collect()} == (closest if nearest_first else in_turn)(left, right)


@pytest.mark.parametrize("grain", [1.0, 0.1])
def test_box_groups(spark, grain):
    rng = random.Random(4)
    part = lambda lo, hi: rng.randint(int(lo / grain), int(hi / grain)) * grain
    data = [(1, f, i, part(0, 150), part(0, 150), part(2, 12), part(2, 12)) for f in range(2) for i in range(30)]
    df = spark.createDataFrame(data, "site_id long, frame_idx long, det_id long, x double, y double, w double, h double")
    got = {(r.frame_idx, r.det_id): r.group for r in box_groups(df, 6).collect()}
    for f in range(2):
        boxes = [b for b in data if b[1] == f]
        label = {b[2]: b[2] for b in boxes}
        changed = True
        while changed:
            changed = False
            for a in boxes:
                for b in boxes:
                    gap = max(b[3] - a[3] - a[5], a[3] - b[3] - b[5], b[4] - a[4] - a[6], a[4] - b[4] - b[6], 0)
                    if gap <= 6 and label[a[2]] > label[b[2]]:
                        label[a[2]] = label[b[2]]
                        changed = True
        assert {d: got[(f, d)] for d in label} == label


def test_fragments_join_only_into_plausible_objects(spark):
    data = [
        (1, 1, 1, 10.0, 10.0, 10.0, 10.0, 15.0, 15.0, 60.0),
        (1, 1, 2, 23.0, 10.0, 10.0, 10.0, 28.0, 15.0, 50.0),
        (1, 1, 3, 100.0, 100.0, 8.0, 8.0, 104.0, 104.0, 40.0),
        (1, 2, 1, 0.0, 0.0, 60.0, 8.0, 30.0, 4.0, 300.0),
        (1, 2, 2, 62.0, 0.0, 60.0, 8.0, 92.0, 4.0, 300.0),
    ]
    df = spark.createDataFrame(data, "site_id long, frame_idx long, det_id long, x double, y double, w double, h double, cx double, cy double, area double")
    got = sorted((r.frame_idx, r.det_id, r.w, r.area, r.fragments) for r in blobs.merged_fragments(df, 256, 192).collect())
    assert got == [(1, 1, 23.0, 110.0, 2), (1, 3, 8.0, 40.0, 1), (2, 1, 60.0, 300.0, 1), (2, 2, 60.0, 300.0, 1)]


def test_box_groups_on_parts_of_pixels(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 1.5, 1.0), (1, 1, 2, 7.9, 0.0, 1.0, 1.0), (1, 2, 1, 0.0, 0.0, 1.5, 1.0), (1, 2, 2, 7.5, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "site_id long, frame_idx long, det_id long, x double, y double, w double, h double")
    assert {(r.frame_idx, r.det_id): r.group for r in box_groups(df, 6).collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 1}
