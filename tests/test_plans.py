"""Commission a site, then watch it: clean traffic is quiet, a parked object is one alert."""

import random

import pytest
from pyspark.sql import functions as F

from perimetra.operators import blobs, site
from perimetra.params import ThermalSite
from perimetra.plans import jobs
from perimetra.sources import stores

P = ThermalSite(grid_rows=6, grid_cols=8, scene_frames=200, min_learned=125, persist_s=1.0)


def cells(rng, hot=None):
    v = [15.0 + rng.gauss(0, 0.05) for _ in range(48)]
    if hot is not None:
        v[hot] += 6.0
    return v


def walkers(rng, frames, start=0):
    out = []
    for f in range(frames):
        x, y = 2.0 + (f % 50), 12.0 + 2.0 * ((f // 50) % 3)
        out.append((1, 1 + f // 50, start + f, (start + f) * 40_000, x, y, 12.0 + 6 * (f % 3), 21.0, 20.0, 2.0, 1.0, 0.5, 1, x - 2, y - 2, 4.0, 4.0))
    return out


OBS = (
    "site_id long, track_id long, frame_idx long, t_us long, cx double, cy double, area double, peak_c double, mean_c double, contrast_c double, "
    "aspect double, extent double, parts int, x double, y double, w double, h double"
)
FRAMES = "site_id long, frame_idx long, t_us long, cells array<double>"


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    rng = random.Random(1)
    frames = spark.createDataFrame([(1, f, f * 40_000, cells(rng)) for f in range(300)], FRAMES)
    obs = spark.createDataFrame(walkers(rng, 300), OBS)
    k = jobs.commission(frames, obs, P, None)
    path = str(tmp_path_factory.mktemp("models"))
    stores.save_site_models(k.model, path)
    k.model = stores.load_site_models(spark, path)
    return k


def test_clean_scene_is_quiet(spark, known):
    rng = random.Random(2)
    frames = spark.createDataFrame([(1, f, f * 40_000, cells(rng)) for f in range(200)], FRAMES)
    got = jobs.watch(frames, spark.createDataFrame(walkers(rng, 200), OBS), known, p=P, span=None)
    assert got.filter("kind = 'static'").count() == 0
    assert jobs.raise_alerts(got, frames.select("site_id", "frame_idx", "t_us"), span=None).count() == 0


def test_parked_object_without_a_track_is_one_alert(spark, known):
    rng = random.Random(3)
    frames = spark.createDataFrame([(1, f, f * 40_000, cells(rng, hot=44)) for f in range(900)], FRAMES)
    got = jobs.watch(frames, spark.createDataFrame(walkers(rng, 50), OBS), known, p=P, span=None).cache()
    per_frame = got.groupBy("frame_idx", "key").count().filter("count > 1")
    assert per_frame.count() == 0
    opened = jobs.raise_alerts(got, frames.select("site_id", "frame_idx", "t_us"), span=None).collect()
    assert [(r.key, r.label) for r in opened] == [("static:2:2", "settled object")]
    assert opened[0].peak_threat > 0.9


def test_model_round_trip_scores_the_same(spark, known):
    rng = random.Random(4)
    frames = spark.createDataFrame([(1, f, f * 40_000, cells(rng, hot=10)) for f in range(20)], FRAMES)
    rel = frames.select("site_id", "frame_idx", site.relative(F.col("cells")).alias("rel"))
    z = site.read_against(rel, known.model, P).agg(F.min(F.array_max("z"))).first()[0]
    assert z > 10


def test_learning_fold_equals_the_closed_form_while_nothing_is_odd(spark):
    rng = random.Random(5)
    frames = spark.createDataFrame([(1, f, cells(rng)) for f in range(140)], "site_id long, frame_idx long, cells array<double>")
    rel = frames.select("site_id", "frame_idx", site.relative(F.col("cells")).alias("rel"))
    a, b = site.fit_site_model(rel, P, None).first(), site.learn_model(rel, P).first()
    assert list(a.ref_mean) == pytest.approx(list(b.ref_mean))
    assert list(a.ref_var) == pytest.approx(list(b.ref_var))
    assert a.frames == b.frames == 140


def test_motion_detector_finds_the_mover_after_warm_up(spark):
    rows = []
    for f in range(40):
        v = [10.0] * (40 * 60)
        if f >= 25:
            for y in range(10, 15):
                for x in range(f, f + 6):
                    v[y * 60 + x] = 20.0
        rows.append((1, f, v))
    df = spark.createDataFrame(rows, "site_id long, frame_idx long, values array<double>")
    got = blobs.detect_adaptive(df, 40, 60).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == list(range(25, 40))
    assert (got[0].x, got[0].y, got[0].w, got[0].h, got[0].area) == (25.0, 10.0, 6.0, 5.0, 20.0)
    frozen = df.withColumn("background", F.transform("values", lambda v: F.lit(10.0)))
    again = blobs.detect_frozen(frozen, 40, 60).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.x, r.area) for r in again] == [(r.frame_idx, r.x, r.area) for r in got]


SEEN = "site_id long, frame_idx long, det_id long, x double, y double, w double, h double, cx double, cy double, area double"
H = [2.5, 0.0, 0.0, 0.0, 2.5, 0.0, 0.0, 0.0, 1.0]


def optics(spark, contacts, hot=None, **more):
    """The optical half of site 1, mapped at 2.5 pixels a thermal pixel; ``contacts`` are (site, frame, x, y) of 20 x 20 boxes."""
    from perimetra.params import OpticalSite, Sensor

    seen = [(s, f, k, x, y, 20.0, 20.0, x + 10, y + 10, 300.0) for k, (s, f, x, y) in enumerate(contacts)]
    warm = [20.0 + (9.0 if hot and hot[0] <= i % 64 < hot[0] + 8 and hot[1] <= i // 64 < hot[1] + 8 else 0) for i in range(48 * 64)]
    frames = {(s, f) for s, f, _, _ in contacts}
    return jobs.Optics(
        spark.createDataFrame(seen, SEEN),
        spark.createDataFrame([(1, H)], "site_id long, h array<double>"),
        celsius=spark.createDataFrame([(s, f) for s, f in sorted(frames)], "site_id long, frame_idx long").crossJoin(spark.createDataFrame([(warm,)], "celsius array<double>")),
        sensor=Sensor(rows=48, cols=64, optical_rows=120, optical_cols=160),
        site=OpticalSite(grid_rows=4, grid_cols=5, persist_s=0.2, min_region_cells=1, fps=25.0),
        **more,
    )


def seconds(spark, n, sites=(1,)):
    rng = random.Random(9)
    return spark.createDataFrame([(s, f, f * 1_000_000, cells(rng)) for s in sites for f in range(n)], FRAMES)


def walker(spark, frames=30, at=None):
    rows = [(1, 7, f, f * 1_000_000, *((10.0 + f, 20.0) if at is None else at), 14.0, 21.0, 20.0, 2.0, 1.0, 0.5, 1, (10.0 + f if at is None else at[0]) - 4, (20.0 if at is None else at[1]) - 4, 8.0, 8.0) for f in range(frames)]
    return spark.createDataFrame(rows, OBS)


def test_one_object_in_both_sensors_is_one_verdict(spark, known):
    obs = walker(spark)
    o = optics(spark, [(1, f, 2.5 * (10 + f) - 10, 40.0) for f in range(30)])
    got = jobs.watch(seconds(spark, 30), obs, known, p=P, span=None, optics=o)
    assert {(r.kind, r.n) for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("track", 30)}
    assert got.groupBy("frame_idx", "key").count().filter("count > 1").count() == 0


def test_a_cold_contact_climbs_to_watch_and_no_further(spark, known):
    o = optics(spark, [(1, f, 100.0, 60.0) for f in range(70)] + [(2, f, 100.0, 60.0) for f in range(70)])
    got = jobs.watch(seconds(spark, 70, (1, 2)), walker(spark, 15), known, p=P, span=None, optics=o).filter("kind = 'optical'")
    seen = {r.frame_idx: r for r in got.collect()}
    assert len(seen) == 70 and {r.site_id for r in seen.values()} == {1} and {r.key for r in seen.values()} == {"optical:2:4"}
    assert [round(seen[f].threat, 2) for f in (5, 21, 37, 69)] == [0.17, 0.32, 0.48, 0.7]
    assert {r.level for r in seen.values()} == {"nominal", "watch"} and seen[40].label == "cold contact" and seen[40].dwell_s == 40.0


def test_a_warm_contact_and_its_name(spark, known):
    names = spark.createDataFrame([(1, 3, 0, "person", 0.8, 98.0, 58.0, 24.0, 24.0)], "site_id long, frame_idx long, name_id long, label string, confidence double, nx double, ny double, nw double, nh double")
    o = optics(spark, [(1, f, 100.0, 60.0) for f in range(6)], hot=(40, 24), names=names)
    got = {r.frame_idx: r for r in jobs.watch(seconds(spark, 6), walker(spark, 6), known, p=P, span=None, optics=o).filter("kind = 'optical'").collect()}
    assert got[2].threat >= 0.55 and "optical found it first, thermal confirmed heat" in got[2].reasons
    assert got[3].label == "person" and got[3].reasons[-1] == "optical recognises it as a person (0.80)" and got[2].label != "person"


def changed_scene(spark, n, sites=(1, 2)):
    """Cells of which two by two are off from frame 10 on, and a model that knows better."""
    odd = [8, 9, 13, 14]
    rows = [(s, f, [5.0 if f >= 10 and k in odd else 0.0 for k in range(20)], [0.0] * 20) for s in sites for f in range(n)]
    model = [(s, *[[v] * 20 for v in (0.0, 0.0, 1e-4, 1e-4, 200.0)]) for s in sites]
    names = ("structure_mean", "tone_mean", "structure_var", "tone_var", "ref_n")
    return {
        "cells": spark.createDataFrame(rows, "site_id long, frame_idx long, structure array<double>, tone array<double>"),
        "model": spark.createDataFrame(model, "site_id long, " + ", ".join(f"{k} array<double>" for k in names)),
    }


def test_patches_of_the_optical_scene_are_judged_unless_an_object_is_there(spark, known):
    both = known.model.unionByName(known.model.withColumn("site_id", F.lit(2).cast("long")))
    k = jobs.SiteKnowledge(both, known.traffic, known.features)
    o = optics(spark, [(1, 0, 0.0, 0.0)], **changed_scene(spark, 40))
    here = walker(spark, 40, at=(45.0, 30.0)).filter("frame_idx < 25")  # under the patch of cells 8, 9, 13, 14: optical 96..160 x 32..96
    got = jobs.watch(seconds(spark, 40, (1, 2)), here, k, p=P, span=None, optics=o).cache()
    patches = got.filter("key LIKE 'optical-static%'")
    frames = {s: sorted(r.frame_idx for r in patches.collect() if r.site_id == s) for s in (1, 2)}
    assert frames == {1: list(range(25, 40)), 2: list(range(14, 40))}
    by_map = {r.site_id: r for r in patches.filter("frame_idx = 39").collect()}
    assert by_map[2].reasons == ["optical-only contact, outside the thermal field of view", "cannot be cross-checked on a fixed mount"]
    # the track in front of it is told that the scene there is not as learned
    told = got.filter("kind = 'track' AND frame_idx = 20").first()
    assert any("sigma off what this camera has learned" in r for r in told.reasons)


def test_nothing_is_settled_during_a_session_or_before_both_models_are_learned(spark, known):
    scene = changed_scene(spark, 40, (1,))
    o = optics(spark, [(1, 0, 0.0, 0.0)], **scene)
    sessions = spark.createDataFrame([(1, 20_000_000, 30_000_000)], "site_id long, started_us long, ended_us long")
    patches = lambda **kw: sorted(r.frame_idx for r in jobs.watch(seconds(spark, 40), walker(spark, 1), known, p=P, span=None, **kw).filter("key LIKE 'optical-static%'").collect())
    assert patches(optics=o, sessions=sessions) == [*range(14, 20), *range(30, 40)]
    open_end = sessions.withColumn("ended_us", F.lit(None).cast("long"))
    assert patches(optics=o, sessions=open_end) == list(range(14, 20))
    o.model = scene["model"].withColumn("ref_n", F.array_repeat(F.lit(10.0), 20))
    assert patches(optics=o) == []
    rng = random.Random(3)
    hot = spark.createDataFrame([(1, f, f * 40_000, cells(rng, hot=44)) for f in range(100)], FRAMES)
    statics = lambda **kw: jobs.watch(hot, spark.createDataFrame(walkers(rng, 10), OBS), known, p=P, span=None, **kw).filter("kind = 'static'").count()
    assert statics() > 50 and statics(optics=o) == 0
    assert statics(sessions=spark.createDataFrame([(1, 0, 10**12)], "site_id long, started_us long, ended_us long")) == 0


def test_shape_of_objects_worth_a_look(spark, known):
    grey = [100.0] * (120 * 160)
    for y in range(35, 65):
        for x in range(60, 92):
            grey[y * 160 + x] = 220.0
    o = optics(spark, [(1, 0, 0.0, 0.0)])
    o.grey = spark.createDataFrame([(1, f, grey) for f in range(12)], "site_id long, frame_idx long, grey array<double>")
    got = {r.frame_idx: r for r in jobs.watch(seconds(spark, 12), walker(spark, 12, at=(30.0, 20.0)), known, p=P, span=None, optics=o).filter("kind = 'track'").collect()}
    assert got[11].sensors == "thermal+optical" and any(r.startswith("optical led: compact solid outline") for r in got[11].reasons) and got[11].label == "drone"
    assert got[1].sensors == "thermal"  # too young to be asked about
