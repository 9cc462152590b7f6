"""Streams end with what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from perimetra.operators import alerts, tracks
from perimetra.params import Alerting, Tracking
from perimetra.sources import stores
from perimetra.streaming import flows, keyed


def drain(stream, name, tmp_path, mode="append"):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def as_stream(df, tmp_path, name, cuts):
    """Write rows as files in clock order and read them back one file per trigger."""
    path = str(tmp_path / name)
    lo, hi = df.agg(F.min("frame_idx"), F.max("frame_idx")).first()
    step = (hi - lo) // cuts + 1
    for i in range(cuts):
        part = df.filter((F.col("frame_idx") >= lo + i * step) & (F.col("frame_idx") < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(path)
    return ticking(df, path)


def ticking(df, path):
    """The files at ``path`` as a stream, after which a row of another site moves the clock on, so that all rows before it are due."""
    spark = df.sparkSession
    end = df.agg(F.max("frame_idx") + 100_000, F.max("t_us") + 10**9).first()
    tick = {"site_id": 99, "track_id": 0, "frame_idx": end[0], "t_us": end[1]}
    row = spark.createDataFrame([tuple(tick.get(f.name) for f in df.schema if f.name != "ts")], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "ts"))
    row.withColumn("ts", F.timestamp_micros("t_us")).select(df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_alert_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for key in ("a", "b"):
        here = True
        for f in range(1, 120):
            if rng.random() < 0.1:
                here = not here
            if here:
                rows.append((1, key, f, f * 1_000_000, rng.choice([0.2, 0.8, 0.9]), "drone", 1.0))
    rows.append((1, "z", 400, 400_000_000, 0.1, "bird", 0.0))
    df = spark.createDataFrame(rows, "site_id long, key string, frame_idx long, t_us long, threat double, label string, dwell_s double")
    p = Alerting(open_after=3)
    clock = spark.createDataFrame([(1, f, f * 1_000_000) for f in range(1, 401)], "site_id long, frame_idx long, t_us long")
    want = sorted((r.key, r.opened_us, r.updated_us, r.closed_us, r.frames) for r in alerts.alert_intervals(df, clock, p, None, None).collect())
    stream = as_stream(df.withColumn("ts", F.timestamp_micros("t_us")), tmp_path, "assessed", 5)
    told = drain(keyed.alerts(stream, p), "alerts_out", tmp_path).collect()
    assert sorted((r.key, r.opened_us, r.updated_us, r.closed_us, r.frames) for r in told if r.event == "close") == want
    # every alert was told when it opened, with what was known then
    opened = sorted((r.key, r.opened_us, r.updated_us, r.closed_us, r.frames) for r in told if r.event == "open")
    assert opened == sorted((k, o, o, None, 2) for k, o, *_ in want)
    assert all(o <= r.at_us <= u for r in told if r.event == "update" for k, o, u, *_ in want if (k, o) == (r.key, r.opened_us))


def test_dwell_and_track_streams(spark, tmp_path):
    rng = random.Random(9)
    rows, det = [], 0
    for f in range(1, 121):
        for k in range(2):
            rows.append((1, f, f * 40_000, det, 60.0 * k + rng.uniform(-0.5, 0.5), 20.0 + rng.uniform(-0.5, 0.5), 10.0 - k, k))
            det += 1
    df = spark.createDataFrame(rows, "site_id long, frame_idx long, t_us long, det_id long, cx double, cy double, area double, size_rank int")
    p = Tracking(max_step_px=10.0)
    want = {r.det_id: r.track_id for r in alerts.tracked(df, p, None).collect()}
    stream = as_stream(df.withColumn("ts", F.timestamp_micros("t_us")), tmp_path, "dets", 4)
    got = drain(keyed.tracked(stream, p), "tracks_out", tmp_path)
    assert {r.det_id: r.track_no for r in got.collect()} == want

    obs = df.withColumn("track_id", F.col("size_rank").cast("long"))
    k = tracks.kinematics(obs, span=None)
    want_dwell = {(r.track_id, r.frame_idx): r.dwell_s for r in alerts.dwell(k, span=None).collect()}
    moving = k.filter("hits >= 4").select("site_id", "track_id", "frame_idx", "t_us", "cx", "cy").withColumn("ts", F.timestamp_micros("t_us"))
    got = drain(keyed.dwell(as_stream(moving, tmp_path, "obs", 3)), "dwell_out", tmp_path)
    assert {(r.track_id, r.frame_idx): r.dwell_s for r in got.collect()} == pytest.approx(want_dwell)


def test_parts_of_frames_shuffled_rows_and_long_silence(spark, tmp_path):
    rng = random.Random(10)
    rows, det = [], 0
    for f in [*range(1, 40), *range(200_000, 200_040)]:
        for k in range(3):
            rows.append((1, f, f * 40_000, det, 60.0 * k + rng.uniform(-0.5, 0.5), 20.0 + rng.uniform(-0.5, 0.5), 10.0 - k, k))
            det += 1
    schema = "site_id long, frame_idx long, t_us long, det_id long, cx double, cy double, area double, size_rank int"
    df = spark.createDataFrame(rows, schema)
    p = Tracking(max_step_px=10.0)
    want = {r.det_id: r.track_id for r in alerts.tracked(df, p, None).collect()}
    # another site keeps the clock going while this one is silent for over two hours; frames are cut in two and rows come shuffled
    other = [(2, f, f * 40_000, 10_000 + f, 0.0, 0.0, 1.0, 0) for f in range(50, 200_000, 10_000)]
    path = str(tmp_path / "parts")
    early, late = [r for r in rows if r[1] < 100], [r for r in rows if r[1] > 100]
    rng.shuffle(early)
    rng.shuffle(late)
    for part in (early[:50], early[50:], other, late[:70], late[70:]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(path)
    stream = ticking(df.withColumn("ts", F.timestamp_micros("t_us")), path)
    got = drain(keyed.tracked(stream, p), "parts_out", tmp_path).filter("site_id = 1").collect()
    assert len(got) == len(rows)
    assert {r.det_id: r.track_no for r in got} == want


def test_contact_sessions_stream(spark, tmp_path):
    rows = [(1, "optical:1:1", f, f * 500_000) for f in [*range(1, 11), *range(30, 35), 200]]
    df = spark.createDataFrame(rows, "site_id long, key string, frame_idx long, t_us long").withColumn("ts", F.timestamp_micros("t_us"))
    got = drain(flows.contact_sessions(as_stream(df, tmp_path, "contacts", 2)), "contacts_out", tmp_path)
    assert sorted((r.frames, r.dwell_s) for r in got.collect()) == [(1, 0.0), (5, 2.0), (10, 4.5)]


def test_paired_stream(spark, tmp_path):
    def feed(offset, name):
        df = spark.createDataFrame([(1, f, f * 100_000 + offset) for f in range(1, 51)], "site_id long, frame_idx long, t_us long")
        return as_stream(df.withColumn("ts", F.timestamp_micros("t_us")), tmp_path, name, 1)

    got = drain(flows.paired(feed(0, "opt"), feed(30_000, "thm")), "paired_out", tmp_path)
    assert sorted((r.frame_idx, r.thermal_frame) for r in got.filter("site_id = 1").collect()) == [(f, f) for f in range(1, 51)]


def test_alert_log_sink(spark, tmp_path):
    rows = [(1, "a", f, f * 1_000_000, 0.9, "drone", 1.0) for f in range(1, 30)] + [(1, "z", 100, 100_000_000, 0.1, "bird", 0.0)]
    df = spark.createDataFrame(rows, "site_id long, key string, frame_idx long, t_us long, threat double, label string, dwell_s double")
    stream = as_stream(df.withColumn("ts", F.timestamp_micros("t_us")), tmp_path, "in", 2)
    flows.log_alerts(keyed.alerts(stream), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(90)
    assert sorted(r.event for r in spark.read.json(str(tmp_path / "log")).collect()) == ["close", "open"]
    log = spark.read.json(str(tmp_path / "log"))
    batch_id = log.first().batch_id
    again = spark.createDataFrame(log.filter(F.col("batch_id") == batch_id).drop("batch_id").collect(), log.drop("batch_id").schema)
    stores.write_alert_batch(again, str(tmp_path / "log"), batch_id)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_learning_and_detection_streams(spark, tmp_path):
    from perimetra.operators import blobs, site
    from perimetra.params import ThermalSite

    rng = random.Random(12)
    rows = []
    for f in range(1, 61):
        v = [rng.gauss(0, 0.1) for _ in range(20 * 20)]
        if f > 40:
            for y in range(4, 9):
                for x in range(5, 10):
                    v[y * 20 + x] += 9.0
        rows.append((1, f, f * 40_000, v))
    df = spark.createDataFrame(rows, "site_id long, frame_idx long, t_us long, values array<double>").withColumn("ts", F.timestamp_micros("t_us"))
    want = [(r.frame_idx, r.x, r.y, r.area) for r in blobs.detect_adaptive(df, 20, 20).orderBy("frame_idx").collect()]
    assert want
    got = drain(keyed.detected(as_stream(df, tmp_path, "pix", 3), 20, 20), "blobs_out", tmp_path).orderBy("frame_idx").collect()
    assert [(r.frame_idx, b.x, b.y, b.area) for r in got for b in r.blobs] == want

    p = ThermalSite(min_learned=20, persist_s=0.2)
    rel = df.select("site_id", "frame_idx", "t_us", "ts", F.slice("values", 80, 40).alias("rel"))
    want = {r.frame_idx: (max(r.z), sum(r.persist)) for r in site.learn_frames(rel, p).collect()}
    got = drain(keyed.learned_site(as_stream(rel, tmp_path, "cells", 3), p), "learned_out", tmp_path)
    assert {r.frame_idx: (max(r.z), sum(r.persist)) for r in got.collect()} == want


def test_number_stream(spark, tmp_path):
    rows = [(1, k, f, f * 1_000_000) for k, fs in (("a", range(1, 4)), ("b", range(2, 40)), ("d", range(20, 40)), ("a", range(30, 40))) for f in fs]
    df = spark.createDataFrame(rows, "site_id long, key string, frame_idx long, t_us long").withColumn("ts", F.timestamp_micros("t_us"))
    got = drain(keyed.object_numbers(as_stream(df, tmp_path, "keys", 3)), "numbers_out", tmp_path)
    first = {(r.object_key, r.number) for r in got.collect()}
    assert first == {("a", 1), ("b", 2), ("d", 1), ("a", 3)}
