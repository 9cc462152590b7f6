"""Golden values of the scalar operators."""

import pytest
from pyspark.sql import functions as F

from perimetra.functions import classify as C
from perimetra.functions import geometry as G
from perimetra.functions import schedule as S
from perimetra.functions import threat as T
from perimetra.functions.text import num
from perimetra.functions.thermal import calibrated_c
from perimetra.operators import replies


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def lit(v):
    return F.lit(v)


def test_calibration_is_continuous_at_the_knee(spark):
    r = one(spark, at=calibrated_c(lit(150.0)), over=calibrated_c(lit(150.0 + 1e-9)))
    assert r.at == pytest.approx(1.0157 * 100.08 + 3.37)
    assert r.over == pytest.approx(r.at, abs=1e-6)


def test_optical_only_ramp(spark):
    got = [one(spark, t=T.optical_threat(lit(True), lit(False), lit(0.0), lit(float(d)))).t for d in (5, 21, 37, 69)]
    assert [round(v, 2) for v in got] == [0.17, 0.32, 0.48, 0.70]


def test_settled_object(spark):
    assert one(spark, t=T.static_threat(lit(20.0), lit(4.0))).t == pytest.approx(0.8417, abs=1e-3)


def test_levels_include_their_edges(spark):
    r = one(spark, a=T.level(lit(0.75)), w=T.level(lit(0.45)), n=T.level(lit(0.4499)))
    assert tuple(r) == ("alert", "watch", "nominal")


def test_fused_identity(spark):
    f = lambda *a: one(spark, f=T.fused_identity(*[lit(v) for v in a])).f
    agree = f("drone", 0.6, "drone", 0.5, "r")
    assert (agree.label, agree.confidence) == ("drone", pytest.approx(0.8))
    split = f("drone", 0.8, "bird", 0.6, "r")
    assert (split.label, split.confidence) == ("drone", pytest.approx(0.4))
    led = f("unknown", 0.0, "bird", 0.5, "r")
    assert (led.label, led.confidence) == ("bird", pytest.approx(0.4))
    assert f("bird", 0.7, "drone", 0.0, "small").note == "thermal only (small)"


def test_policy_never_lowers_identity_risk(spark):
    r = one(spark, a=T.track_threat(lit(0.8), lit(0.9), lit(0.0), lit(True)), b=T.track_threat(lit(0.8), lit(0.0), lit(0.0), lit(False)))
    assert r.a > r.b == pytest.approx(0.8)


def test_missing_channel_has_no_vote(spark):
    none = F.lit(None).cast("double")
    r = one(spark, four=T.combined_novelty(lit(0.4), lit(0.0), lit(0.0), lit(0.0), none), five=T.combined_novelty(*[lit(v) for v in (0.4, 0.0, 0.0, 0.0, 0.0)]))
    assert r.four == pytest.approx(0.34)
    assert r.five == pytest.approx(0.336)


def test_numbers_round_half_to_even_and_keep_their_sign(spark):
    r = one(spark, a=num(lit(2.5)), b=num(lit(-0.04), 1, signed=True), c=num(lit(1.25), 1, signed=True))
    assert tuple(r) == ("2", "-0.0", "+1.2")


def test_inverse_homography_and_singular_one(spark):
    h = F.array(*[lit(v) for v in (2.1, 0.05, 30.0, -0.03, 2.2, 20.0, 1e-4, 2e-4, 1.0)])
    x, y = G.map_x(h, lit(100.0), lit(50.0)), G.map_y(h, lit(100.0), lit(50.0))
    inv = G.inverse(h)
    flat = F.array(*[lit(v) for v in (1.0, 2.0, 0.0, 2.0, 4.0, 0.0, 0.0, 0.0, 1.0)])
    r = one(spark, x=G.map_x(inv, x, y), y=G.map_y(inv, x, y), none=G.inverse(flat))
    assert (r.x, r.y) == (pytest.approx(100.0), pytest.approx(50.0))
    assert r.none is None


def test_four_quarter_turns_are_none(spark):
    b = G.Box(lit(3.0), lit(5.0), lit(7.0), lit(2.0))
    once = G.turned_box(b, 256, 192, 1)
    back = G.turned_box(once, 192, 256, 3)
    r = one(spark, x=back.x, y=back.y, w=back.w, h=back.h)
    assert tuple(r) == (3.0, 5.0, 7.0, 2.0)


def test_zone_without_polygon_holds_every_point(spark):
    empty = F.array().cast("array<struct<x:double,y:double>>")
    square = F.array(*[F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    r = one(spark, e=G.inside(lit(5.0), lit(5.0), empty), i=G.inside(lit(5.0), lit(5.0), square), o=G.inside(lit(15.0), lit(5.0), square))
    assert tuple(r) == (True, True, False)


def test_hours_may_wrap_midnight(spark):
    night = F.struct(lit(22.0).alias("start"), lit(6.0).alias("end"))
    days = F.lit(None).cast("array<int>")
    got = [one(spark, v=S.in_window(night, days, lit(h), lit(0))).v for h in (23.0, 5.5, 6.0, 12.0)]
    assert got == [True, True, False, False]


def test_local_clock_of_a_zone(spark):
    ts = F.timestamp_micros(lit(1_719_828_000_000_000))  # 2024-07-01 10:00 UTC, a Monday
    r = one(spark, h=S.local_hour(ts, lit("Europe/Berlin")), d=S.local_weekday(ts, lit("Europe/Berlin")))
    assert tuple(r) == (12.0, 0)


def test_landed_shortcut_and_young_tracks(spark):
    def label(hits, travel):
        is_landed = C.landed(lit(1.0), lit(0.5), lit(3), lit(7.0), lit(0.0))
        why = C.grounded_reason(lit(hits), lit(travel), lit(30.0), is_landed)
        return one(spark, v=C.verdict(lit(hits), lit(travel), why, is_landed, lit(3), lit(0.5), lit(0.1))).v

    assert label(7, 0.0).label == "unknown"
    assert label(9, 0.0).confidence == pytest.approx(0.80)
    assert label(9, 50.0).label == "drone"


def test_optical_names_overrule_or_only_annotate(spark):
    v = lambda n, c: one(spark, v=C.overruled(lit("bird"), lit(0.6), lit(n), lit(c))).v
    assert (v("uav", 0.13).label, v("uav", 0.13).confidence) == ("drone", 0.6)
    assert v("chair", 0.49).label == "bird"
    assert v("chair", 0.5).label == "chair"
    assert (v("bowl", 0.9).label, v("bowl", 0.9).optical_guess) == ("bird", "bowl 0.90")


def test_reply_extraction(spark):
    texts = ['```json\n{"class": "bird"}\n```', 'well {"a": {"b": 1}} and {"c": 2}', "none", "{broken"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    first = [r.f for r in df.select("i", replies.first_object(F.col("text")).alias("f")).orderBy("i").collect()]
    assert first == ['{"class": "bird"}', '{"a": {"b": 1}}', None, None]
    ok = [r.ok for r in replies.parsed(df).orderBy("i").collect()]
    assert ok[0] and not ok[2] and not ok[3]


def test_targets_in_the_thermal_frame(spark):
    from perimetra.operators import evaluate

    maps = spark.createDataFrame([(1, [2.0, 0.0, 10.0, 0.0, 2.0, -4.0, 0.0, 0.0, 1.0]), (2, [0.0] * 9)], "site_id long, h array<double>")
    rows = [(1, 0, 1, 3.0, 5.0), (1, 0, 2, 123.0, 5.0), (1, 0, 3, 1.0, 1.0), (2, 0, 4, 3.0, 5.0), (3, 0, 5, 3.0, 5.0)]
    world = spark.createDataFrame(rows, "site_id long, frame_idx long, truth_id long, x double, y double")
    seen = evaluate.projected(world, maps)
    assert {r.truth_id: (r.x, r.y) for r in seen.collect()} == {1: (16.0, 6.0), 2: (256.0, 6.0), 3: (12.0, -2.0), 4: (None, None)}
    assert [r.truth_id for r in evaluate.visible(seen).collect()] == [1]


def test_request_about_something_only_the_optical_sensor_has(spark):
    import json

    from perimetra.operators import replies

    row = spark.createDataFrame([(10.0, 20.0, 30.0, 20.0, 61.25, 0.70049, "NOT warm")], "x double, y double, w double, h double, dwell_s double, threat double, thermal_says string")
    got = json.loads(row.select(replies.optical_request(F.lit("settled optical patch")).alias("j")).first().j)
    assert got["sensor"].startswith("optical only") and got["why_asked"] == "settled optical patch" and got["box"] == [10.0, 20.0, 30.0, 20.0]
    assert (got["area_px"], got["aspect"], got["dwell_s"], got["threat"], got["thermal_says"]) == (600, 1.5, 61.2, 0.7, "NOT warm")
