import numpy as np
import pandas as pd
import pytest

from perimetra.operators import intime, site
from perimetra.params import ThermalSite

P = ThermalSite(min_learned=12, adapt_s=1.6, grid_rows=4, grid_cols=5)


def scene(spark, n, events, seed=1, sites=(1,), start=0):
    """Noise on 20 cells with objects that stay: (site, from, to, cell, degrees); cell None is all of them."""
    r = np.random.default_rng(seed)
    rows = []
    for s in sites:
        x = r.normal(0, 0.3, (n, 20)) + np.linspace(0, 1, 20)
        for of, a, b, cell, by in events:
            if of == s:
                x[a:b, slice(None) if cell is None else cell] += by
        rows += [(s, start + k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["site_id", "frame_idx", "rel"]), "site_id long, frame_idx long, rel array<double>")


def same_as_fold(frames, span):
    want = {(r.site_id, r.frame_idx): r for r in site.learn_frames(frames, P).collect()}
    got = {(r.site_id, r.frame_idx): r for r in intime.learn_frames(frames, P, span).collect()}
    assert want.keys() == got.keys()
    for k, w in want.items():
        g = got[k]
        assert g.persist == w.persist and g.suppressed == w.suppressed
        np.testing.assert_allclose(g.z, w.z, atol=1e-9)
        np.testing.assert_allclose(g.dev, w.dev, atol=1e-9)
    for g, w in zip(intime.learn_model(frames, P, span).orderBy("site_id").collect(), site.learn_model(frames, P).orderBy("site_id").collect()):
        assert (g.site_id, g.frames) == (w.site_id, w.frames)
        for k in ("ref_mean", "ref_var", "ref_n"):
            np.testing.assert_allclose(g[k], w[k], atol=1e-9)
    return {r.suppressed for r in want.values()}, max(max(r.persist) for r in want.values())


@pytest.mark.parametrize("span", [7, 16, 1000])
def test_equals_the_fold(spark, span):
    # one cell settles for long, two come and go, one whole frame jumps, and a site that starts late
    events = [(1, 60, 130, 3, 5.0), (1, 20, 24, 9, -4.0), (1, 90, 95, None, 6.0), (2, 14, 150, 0, 3.0), (2, 80, 81, 1, 2.0)]
    both = scene(spark, 150, events, sites=(1, 2)).unionByName(scene(spark, 40, [], seed=4, sites=(3,), start=1005))
    suppressed, longest = same_as_fold(both, span)
    assert suppressed == {True, False} and longest >= 40


def test_a_clean_scene_needs_no_second_look(spark):
    frames = scene(spark, 200, [])
    quiet = frames.withColumn("rel", site.F.transform("rel", lambda v: v / 5))
    assert intime.rounds_needed(quiet, P, 16) == [13, 0]
    same_as_fold(quiet, 16)


def test_only_chunks_that_may_decide_otherwise_are_worked_again(spark):
    frames = scene(spark, 400, [(1, 200, 400, 3, 8.0)]).withColumn("rel", site.F.transform("rel", lambda v: v / 3))
    rounds = intime.rounds_needed(frames, P, 20)
    assert rounds[0] == 20 and rounds[1] <= 10 and rounds[-1] == 0 and len(rounds) <= 6  # what was before the object came is done
    same_as_fold(frames, 20)


def test_a_change_near_the_threshold_travels_on(spark):
    # every odd reading shifts what the next ones are held against
    r = np.random.default_rng(8)
    x = np.cumsum(r.normal(0, 0.35, (240, 20)), axis=0)
    frames = spark.createDataFrame([(1, k, v.tolist()) for k, v in enumerate(x)], "site_id long, frame_idx long, rel array<double>")
    same_as_fold(frames, 9)
    assert intime.learn_frames(frames.where("false"), P, 9).collect() == []


def test_frames_of_one_site_go_to_many_tasks(spark):
    frames = scene(spark, 200, [])
    plan = intime.learn_frames(frames, P, 16)
    used = plan.select("frame_idx", site.F.spark_partition_id().alias("task")).groupBy("task").count().collect()
    assert len(used) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_scenes_that_never_settle_take_few_rounds(spark):
    # most decisions hang on the ones before, so rounds that only close a chunk each would be as many as chunks
    r = np.random.default_rng(3)
    small = ThermalSite(min_learned=10, z_enter=2.0, min_dev_c=1.0, persist_s=0.08, adapt_s=1.2)
    rows = [(s, 10 * k + s, v.tolist()) for s in (1, 2) for k, v in enumerate(r.normal(0, 1.25, (400, 20)))]
    frames = spark.createDataFrame(rows, "site_id long, frame_idx long, rel array<double>")
    rounds = intime.rounds_needed(frames, small, 8)
    assert rounds[0] == 100 and rounds[-1] == 0 and len(rounds) <= 6  # a chunk holds 8 frames, though the clock makes ten steps a frame
    want = {(x.site_id, x.frame_idx): x for x in site.learn_frames(frames, small).collect()}
    got = {(x.site_id, x.frame_idx): x for x in intime.learn_frames(frames, small, 8).collect()}
    assert got.keys() == want.keys() and all(got[k].persist == w.persist for k, w in want.items())
