"""Camera-to-camera fits and their acceptance."""

import random

import pytest
from pyspark.sql import functions as F

from perimetra.operators import calibration
from perimetra.params import Rig

H = (2.1, 0.05, 30.0, -0.03, 2.2, 20.0, 1e-4, 2e-4, 1.0)
DDL = "site_id long, tick long, pair_id long, tx double, ty double, ox double, oy double"


def mapped(x, y):
    d = H[6] * x + H[7] * y + H[8]
    return (H[0] * x + H[1] * y + H[2]) / d, (H[3] * x + H[4] * y + H[5]) / d


def pairs(n, wrong, jitter=0.3, seed=1, x=(0, 250), y=(0, 190)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tx, ty = rng.uniform(*x), rng.uniform(*y)
        ox, oy = mapped(tx, ty)
        if rng.random() < wrong:
            ox, oy = rng.uniform(0, 640), rng.uniform(0, 480)
        out.append((1, i // 2, i, tx, ty, ox + rng.uniform(-jitter, jitter), oy + rng.uniform(-jitter, jitter)))
    return out


def truth():
    return F.array(*[F.lit(v) for v in H])


def test_fit_survives_wrong_pairs(spark):
    fits = calibration.accepted(calibration.fit(spark.createDataFrame(pairs(200, 0.5), DDL), Rig(ransac_iters=3200)))
    r = fits.withColumn("gap", calibration.corner_disagreement(F.col("h"), truth(), 192, 256)).first()
    assert r.accepted and r.gap < 1.5 and 80 <= r.inliers <= 125


def test_four_pairs_are_solved_exactly(spark):
    corners = [(1, i, i, float(x), float(y), *mapped(x, y)) for i, (x, y) in enumerate(((10, 10), (240, 15), (230, 180), (20, 170)))]
    fits = calibration.fit(spark.createDataFrame(corners, DDL)).withColumn("gap", calibration.corner_disagreement(F.col("h"), truth(), 192, 256))
    assert fits.first().gap == pytest.approx(0.0, abs=1e-6)


def test_line_of_points_is_not_accepted(spark):
    line = [(1, i, i, 10.0 + i, 50.0 + i * 0.5, *mapped(10.0 + i, 50.0 + i * 0.5)) for i in range(120)]
    s = calibration.spread(spark.createDataFrame(line, DDL)).first()
    assert not s.spread_ok and s.minor < 0.05
    assert not calibration.accepted(calibration.fit(spark.createDataFrame(line, DDL), Rig(ransac_iters=320))).first().accepted


def test_scenery_is_dropped(spark):
    rows = [(1, t, 1, 100.0, 100.0) for t in range(1, 61)] + [(1, t, 2, 3.0 * t, 20.0) for t in range(1, 61)]
    df = spark.createDataFrame(rows, "site_id long, tick long, det long, cx double, cy double")
    for span in (None, 25):
        kept = calibration.without_scenery(df, 8, span=span).groupBy("det").count().collect()
        assert {r["det"]: r["count"] for r in kept} == {1: 29, 2: 60}


def test_settled_pairs_count_once(spark):
    s = spark.createDataFrame([(1, t, "a", 5.0, 5.0) for t in range(5)], "site_id long, tick long, key string, cx double, cy double")
    o = spark.createDataFrame([(1, t, k, 9.0, 9.0) for t in range(2, 5) for k in ("x", "y")], "site_id long, tick long, key string, cx double, cy double")
    got = sorted((r.t_key, r.o_key, r.tick) for r in calibration.settled_pairs(s, o).collect())
    assert got == [("a", "x", 2), ("a", "y", 2)]


def test_same_place_gives_no_new_sample(spark):
    d = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 6.0, 5.0), (1, 3, 40.0, 5.0)], "site_id long, tick long, cx double, cy double")
    assert sorted(r.tick for r in calibration.fresh_samples(d).collect()) == [1, 3]


def test_slow_movers_are_compared_with_the_last_sample_taken(spark):
    apart = Rig().dedupe_px
    d = spark.createDataFrame([(1, t, float(t), 5.0) for t in range(1, 31)], "site_id long, tick long, cx double, cy double")
    want, last = [], None
    for t in range(1, 31):
        if last is None or t - last >= apart:
            want.append(t)
            last = t
    assert len(want) > 2
    assert sorted(r.tick for r in calibration.fresh_samples(d).collect()) == want
