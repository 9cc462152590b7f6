"""Files in and out."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from perimetra.operators import feeds, policy
from perimetra.params import Sensor
from perimetra.sources import config, frames, stores

TINY = Sensor(rows=4, cols=10, frame_rows=6, frame_bytes=12, slack_bytes=4)


def frame(raw, ambient=2150):
    a = np.full((6, 10), raw, "<u2")
    a[4, 0], a[4, 8], a[4, 9] = ambient, 4, 10
    return a


@pytest.fixture()
def folder(tmp_path):
    for site in ("north", "south"):
        (tmp_path / site).mkdir()
        for i in range(5):
            np.save(tmp_path / site / f"f{i:03d}.npy", frame(4850 + 31 * i))
    return str(tmp_path)


def test_stored_frames_are_numbered_and_decoded(spark, folder):
    got = frames.calibrated(frames.read_frames(spark, folder, TINY), TINY).orderBy("site_id", "frame_idx").collect()
    assert [(r.site_id, r.frame_idx) for r in got] == [(s, i) for s in ("north", "south") for i in range(5)]
    assert (got[0].ambient_c, got[0].rows, got[0].cols, len(got[0].celsius)) == (21.5, 4, 10, 40)
    t = 21.5 + 2
    assert got[2].celsius[0] == pytest.approx(1.0157 * (-0.00294 * t * t + 1.129 * t - 3.12) + 3.37)


def test_frame_stream_reads_the_same_files(spark, folder, tmp_path):
    q = (
        frames.stream_frames(spark, folder, 3, TINY).writeStream.format("memory").queryName("frames_in")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(60)
    assert spark.table("frames_in").count() == 10


def test_packets_become_frames(spark):
    def p(seq, flags, body, session=1):
        return (1, session, seq, 2, flags, bytes([2, flags]) + body)

    data = [
        p(1, 0, b"abcdef"), p(2, 2, b"ghijkl"),  # good, 12 bytes
        p(3, 1, b"xx"), p(4, 0, b"abcdef"), p(5, 2, b"ghijklm"),  # torn by the flip, then good with slack
        p(6, 1 | 0x40, b"abcdef"), p(7, 3, b"ghijkl"),  # flagged
        p(8, 2, b"abc"),  # short
        p(9, 3, b"a" * 30),  # too long
        p(10, 0, b"tail"),  # still open
    ]
    df = spark.createDataFrame(data, "site_id long, session long, seq long, header_len int, flags int, payload binary")
    for span in (None, 3):
        got = feeds.packet_frames(df, TINY, span).orderBy("first_seq").collect()
        assert [r.state for r in got] == ["good", "torn", "good", "error", "short", "mismatched", "open"]
        assert bytes(got[0].frame) == b"abcdefghijkl" == bytes(got[2].frame)
    h = feeds.feed_health(feeds.packet_frames(df, TINY, None)).first()
    assert (h.frames, h.short, h.torn, h.errors, h.mismatched, h.good_pct) == (2, 1, 1, 1, 1, 33.3)


def test_policy_files_round_trip(spark, tmp_path):
    doc = {
        "site": "n",
        "zones": [{"name": "Main Yard", "polygon": [[0, 0], [10, 0], [10, 10]], "description": "d"}, {"name": "", "polygon": []}],
        "rules": [{"zone": "Main Yard", "hours": [22, 6]}, {"id": "x", "classes": ["Bird"], "verdict": "permitted", "severity": 0}],
    }
    (tmp_path / "north.json").write_text(json.dumps(doc))
    pol = config.read_policies(spark, str(tmp_path))
    zones, rules = config.zone_table(pol), config.rule_table(pol)
    assert [(r.site_id, r.name) for r in zones.collect()] == [("north", "main_yard")]
    r = rules.orderBy("ord").collect()
    assert (r[0].id, r[0].zone, r[0].classes, r[0].verdict, r[0].severity, tuple(r[0].hours)) == ("rule-1", "main_yard", ["*"], "prohibited", 0.8, (22.0, 6.0))
    assert (r[1].zone, r[1].classes, r[1].severity) == ("*", ["bird"], 0.0)
    text = config.policy_documents(zones, rules, pol.select("site_id", "site")).first().value
    again = config.parse_policies(spark.createDataFrame([("north", text)], "site_id string, text string"))
    assert sorted(config.rule_table(again).collect()) == sorted(rules.collect())


def test_homography_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"H": [[1, 0, 2], [0, 1, 3], [0, 0, 1]], "n_points": 9, "reprojection_mean_px": 0.5}))
    r = config.read_homographies(spark, str(tmp_path)).first()
    assert (r.site_id, r.h, r.n_points) == ("a", [1, 0, 2, 0, 1, 3, 0, 0, 1], 9)
    out = str(tmp_path / "out")
    config.write_homographies(spark.createDataFrame([("a", r.h)], "site_id string, h array<double>"), out)
    assert spark.read.json(out).first().H == [[1, 0, 2], [0, 1, 3], [0, 0, 1]]


def test_class_names(spark, tmp_path):
    (tmp_path / "m.names").write_text("person\ndrone\n\nbowl\nbird\n")
    got = [(r.id, r.label, r.aircraft, r.can_overrule, r.furniture, r.airborne) for r in config.class_names(spark, str(tmp_path / "m.names")).collect()]
    assert got == [
        (0, "person", False, True, False, False), (1, "drone", True, False, False, False),
        (2, "bowl", False, False, True, False), (3, "bird", False, False, False, True),
    ]


def test_model_store_replaces_only_the_given_sites(spark, tmp_path):
    path = str(tmp_path / "models")
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "site_id long, ref_mean array<double>")
    stores.save_site_models(df, path)
    stores.save_site_models(spark.createDataFrame([(2, [9.0])], df.schema), path)
    assert sorted((r.site_id, r.ref_mean) for r in stores.load_site_models(spark, path).collect()) == [(1, [1.0]), (2, [9.0])]
    assert stores.exists(spark, path) and not stores.exists(spark, str(tmp_path / "none"))


def test_alert_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    e = spark.createDataFrame([(1, "k", "open", 1_700_000_000_000_000)], "site_id long, key string, event string, at_us long")
    stores.append_alert_log(e, path)
    stores.append_alert_log(e.withColumn("event", F.lit("close")), path)
    assert sorted(r.event for r in stores.read_alert_log(spark, path, "site_id long, key string, event string, at_us long").collect()) == ["close", "open"]


def test_worked_policy_examples(spark):
    doc = {
        "zones": [{"name": "apron", "polygon": [[0, 0], [100, 0], [100, 100], [0, 100]]}, {"name": "lane", "polygon": [[100, 0], [200, 0], [200, 100], [100, 100]]}],
        "rules": [
            {"id": "cars", "zone": "lane", "classes": ["vehicle"], "verdict": "permitted", "severity": 0.4, "hours": [6, 22]},
            {"id": "stay", "zone": "apron", "verdict": "restricted", "severity": 0.8, "max_dwell_s": 120},
        ],
    }
    pol = config.parse_policies(spark.createDataFrame([(1, json.dumps(doc))], "site_id long, text string"))
    obj = "site_id long, label string, cx double, cy double, dwell_s double, speed_px double, hour double, weekday int"
    data = [(1, "vehicle", 150.0, 50.0, 0.0, 3.0, 12.0, 0), (1, "vehicle", 150.0, 50.0, 0.0, 3.0, 3.0, 0), (1, "unknown", 50.0, 50.0, 300.0, 0.0, 12.0, 0)]
    got = policy.judge(spark.createDataFrame(data, obj), config.zone_table(pol), config.rule_table(pol)).orderBy("dwell_s", F.desc("hour")).collect()
    assert [(r.policy.verdict, r.policy.risk) for r in got] == [("permitted", 0.0), ("prohibited", 0.2), ("prohibited", 0.8)]
    assert got[1].policy.reasons == ["vehicle in lane outside permitted hours 06:00-22:00"]
    assert got[2].policy.reasons == ["unknown in apron stationary 300 s, over the 120 s limit"]


def test_array_file_format_is_the_plain_one():
    buf = io.BytesIO()
    np.save(buf, frame(5000))
    assert buf.getvalue()[:6] == b"\x93NUMPY"
