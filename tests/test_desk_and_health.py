"""Requests with a queue, and silence of feeds told by the wall clock."""

import random
import time

from pyspark.sql import functions as F
from test_streaming import as_stream, drain

from perimetra.operators import alerts
from perimetra.params import Escalate, Sensor
from perimetra.streaming import health, keyed

P = Escalate(cooldown_s=60.0, min_gap_s=6.0, max_queue=2)
ROW = "site_id long, key string, frame_idx long, t_us long"


def test_the_desk_by_hand(spark):
    s = 1_000_000
    asks = [(1, "a", 0), (1, "a", 3), (1, "b", 5), (1, "b", 6), (1, "c", 12), (1, "d", 18), (1, "d", 30), (1, "a", 61), (1, "d", 79)]
    replies = [(1, "b", 7), (1, "a", 20), (1, "b", 20), (1, "z", 21)]
    frame = lambda rows: spark.createDataFrame([(w, k, t, t * s) for w, k, t in rows], ROW)
    got = [(r.t_us // s, r.key, r.event) for r in alerts.request_desk(frame(asks), frame(replies), P).collect()]
    # at 5 the gap is too short; at 7 the reply is about a request that still waits; at 18 the queue is full, and d was asked all the same
    assert sorted(got) == sorted([
        (0, "a", "sent"), (6, "b", "queued"), (12, "c", "queued"), (18, "d", "turned away"), (20, "a", "answered"), (20, "b", "sent"),
        (20, "b", "answered"), (20, "c", "sent"), (61, "a", "queued"), (79, "d", "queued"),
    ])
    assert alerts.request_desk(frame(asks).filter("false"), frame(replies), P).collect() == []


def test_desk_on_a_stream(spark, tmp_path):
    r = random.Random(4)
    asks = [(w, r.choice("abcdefgh"), t, t * 1_000_000) for w in (1, 2) for t in range(1, 300) if r.random() < 0.5]
    replies = [(w, r.choice("abcdefgh"), t, t * 1_000_000) for w in (1, 2) for t in range(1, 300) if r.random() < 0.4]
    a, b = (spark.createDataFrame(x, ROW).withColumn("ts", F.timestamp_micros("t_us")) for x in (asks, replies))
    want = sorted((q.site_id, q.t_us, q.key, q.event) for q in alerts.request_desk(a, b, P).collect())
    assert {q[3] for q in want} == {"sent", "queued", "turned away", "answered"}
    out = drain(keyed.request_desk(as_stream(a, tmp_path, "asks", 3), as_stream(b, tmp_path, "replies", 4), P), "desk_out", tmp_path)
    assert sorted((q.site_id, q.t_us, q.object_key, q.event) for q in out.filter("site_id < 9").collect()) == want


def test_silence_is_told_once_without_any_row(spark, tmp_path):
    path = str(tmp_path / "arrivals")
    schema = "site_id long, sensor string, ts timestamp, ok boolean"

    def arrive(*rows):
        now = time.time()
        spark.createDataFrame([(s, k, ok) for s, k, ok in rows], "site_id long, sensor string, ok boolean").withColumn(
            "ts", F.timestamp_seconds(F.lit(now) + F.monotonically_increasing_id() / 1000)
        ).select("site_id", "sensor", "ts", "ok").coalesce(1).write.mode("append").parquet(path)

    arrive((1, "thermal", True), (1, "optical", True), (2, "thermal", False))
    p = Sensor(stale_after_s=2.0, warn_after_failures=3, warn_every_failures=4)
    stream = health.feed_watch(spark.readStream.schema(schema).parquet(path), p)
    q = stream.writeStream.format("memory").queryName("health_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    told = lambda: sorted((r.site_id, r.sensor, r.event, r.failures) for r in spark.table("health_out").collect())

    def until(want, limit=60):
        end = time.time() + limit
        while told() != sorted(want) and time.time() < end and q.isActive:
            time.sleep(0.3)
        assert q.exception() is None and told() == sorted(want)

    try:
        both = [(1, "thermal", "stale", 0), (1, "optical", "stale", 0)]
        until(both)  # all feeds silent: no row comes, and both are told
        arrive((1, "optical", True), *[(2, "thermal", False)] * 2, *[(1, "thermal", False)] * 8)
        more = [(1, "optical", "back", 0), (2, "thermal", "failing", 3), (1, "thermal", "failing", 3), (1, "thermal", "failing", 4), (1, "thermal", "failing", 8)]
        again = [(1, "optical", "stale", 0)]
        until(both + more + again)  # site 2 never gave a frame, the thermal feed of site 1 was told already
        time.sleep(3)
        assert told() == sorted(both + more + again)
        assert all(r.silent_ms >= 2000 for r in spark.table("health_out").filter("event = 'stale'").collect())
    finally:
        q.stop()


def test_stays_are_told_while_they_last_and_records_are_purged(spark, tmp_path):
    from test_controls import acted

    from perimetra.operators import controls, tracks
    from perimetra.operators.machines import Stay

    r = random.Random(5)
    rows, t = [], dict.fromkeys(("optical:1:1", "optical:2:5"), 0)
    for key in t:
        for _ in range(80):
            t[key] += r.choice([1, 1, 1, 2, 3, 15])
            rows.append((1, key, t[key], t[key] * 1_000_000))
    df = spark.createDataFrame(rows, "site_id long, key string, frame_idx long, t_us long")
    # in the middle of a stay, on its frame and on the one behind it
    lasting = [a for a, b, c in zip(rows, rows[1:], rows[2:]) if a[1] == c[1] and b[2] - a[2] == 2 and c[2] - b[2] <= 2]
    picked = ((lasting[0][1], lasting[0][2]), (lasting[-1][1], lasting[-1][2] + 1), ("track:1", 7))
    acts = acted(spark, *[{"site_id": 1, "frame_idx": f, "t_us": f * 1_000_000, "action": "accept", "sensor": "optical", "key": k} for k, f in picked])
    said = controls.for_contacts(acts)
    want = {}
    for key in t:
        since = last = None
        for _, k, f, us in sorted(r for r in rows if r[1] == key):
            accepted = any(a.key == key and (last is not None and last // 1_000_000 <= a.frame_idx < f) for a in said.collect())
            if since is None or us - last > 2_000_000 or accepted:
                since = us
            last = us
            want[key, f] = (us - since) / 1e6
    batch = tracks.contact_stays(df, said, span=None)
    assert {(q.key, q.frame_idx): q.dwell_s for q in batch.collect()} == want
    plain = {(q.key, q.frame_idx): q.dwell_s for q in tracks.contact_dwell(df, span=None).collect()}
    assert plain != want
    ts = F.timestamp_micros("t_us")
    out = drain(keyed.contact_stays(as_stream(df.withColumn("ts", ts), tmp_path, "seen", 4), as_stream(said.withColumn("ts", ts), tmp_path, "said", 1)), "stays_out", tmp_path)
    assert {(q.object_key, q.frame_idx): q.dwell_s for q in out.filter("site_id = 1").collect()} == want
    told = []
    watch = keyed.MachineStream(["site_id", "object_key"], ["frame_idx"], Stay, ["site_id", "object_key", "frame_idx", "t_us", "dwell_s"], "ts", 10.0)

    class State:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    import pickle

    watch.handle = type("H", (), {"registerTimer": lambda self, at: told.append(at)})()
    watch.state, watch.waiting = State(), State()
    clock = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    watch.state.update((pickle.dumps(Stay()), 5_000))
    list(watch.handleExpiredTimer((1, "k"), clock(15_000), None))
    assert watch.state.exists() and told == [15_001]
    list(watch.handleExpiredTimer((1, "k"), clock(15_001), None))
    assert not watch.state.exists()
