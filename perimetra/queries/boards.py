"""Queries for the lists people read, raw feeds, outside replies and camera calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions import threat as T
from perimetra.functions.classify import class_hue
from perimetra.operators import assess, calibration, feeds, replies, site
from perimetra.operators.scans import chunk_span
from perimetra.params import Rig, Sensor
from perimetra.queries import REGISTRY

from perimetra.queries.boxes import H, h_col, map_sql
from perimetra.queries.site import r6
from perimetra.sources.adapters import BOXES_SQL, assessments, assessments_sql, boxes, table

DAY = 86400 * 10**6


@REGISTRY.add(
    "assessment_union",
    "WITH " + assessments_sql() + """
, u AS (
  SELECT site_id, frame_idx, key, 'track' AS kind, label, CASE label WHEN 'drone' THEN confidence WHEN 'bird' THEN 0 ELSE 0.15 END::DOUBLE AS ident, threat AS site, dwell_s FROM assessments WHERE kind = 'track'
  UNION ALL SELECT site_id, frame_idx, key, 'static', 'settled object', 0, 0, dwell_s FROM assessments WHERE kind = 'static'
  UNION ALL SELECT site_id, frame_idx, key, 'optical', CASE WHEN label = 'bird' AND least(1, dwell_s / 60.0) > 0.25 THEN 'cold contact' ELSE 'unverified contact' END,
    CASE WHEN label = 'drone' THEN 0.55 + 0.25 * least(1, threat * 10 / 8.0) WHEN label = 'bird' THEN 0.12 + 0.58 * least(1, dwell_s / 60.0) ELSE 0.20 + 0.45 * least(1, dwell_s / 60.0) END, 0, dwell_s
    FROM assessments WHERE kind = 'optical'
), t AS (
  SELECT *, CASE WHEN kind = 'static' THEN 0.60 + 0.25 * least(1, dwell_s / 30.0) + 0.15 * 0.5 ELSE 1 - (1 - ident) * (1 - site) END AS th FROM u
)
SELECT site_id, frame_idx, key, kind, label, round(th, 6) AS threat, CASE WHEN th >= 0.75 THEN 'alert' WHEN th >= 0.45 THEN 'watch' ELSE 'nominal' END AS level FROM t""",
)
def assessment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = united(assessments(spark, sf_dir))
    return u.select("site_id", "frame_idx", "key", "kind", "label", F.round("threat", 6).alias("threat"), "level")


def united(a: DataFrame) -> DataFrame:
    c, text, texts = F.col, F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    no_policy = F.struct(F.lit(0.0).alias("risk"), text.alias("verdict"), texts.alias("reasons"), F.lit(False).alias("suppresses_novelty"))
    tracks = assess.track_assessments(
        a.filter(c("kind") == "track").withColumns(
            {
                "site_risk": c("threat"), "novelty_reasons": texts, "policy": no_policy, "not_airborne": text,
                "o_label": text, "o_confidence": F.lit(None).cast("double"), "o_reason": text,
            }
        )
    )
    statics = assess.static_assessments(a.filter(c("kind") == "static").withColumns({"peak_dev_c": F.lit(4.0), "cells": F.lit(6)}))
    optical = assess.optical_assessments(
        a.filter(c("kind") == "optical").withColumns(
            {
                "found": c("label").isin("drone", "bird"), "warm": c("label") == "drone", "hotspot_c": c("threat") * 10, "answer": F.lit("seen"),
                "name": text, "name_confidence": F.lit(None).cast("double"),
            }
        )
    )
    return assess.union(tracks, statics, optical)


@REGISTRY.add(
    "watch_list",
    "WITH " + assessments_sql() + """
, r AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY threat DESC, dwell_s DESC, key, frame_idx)::INTEGER AS rank
  FROM assessments WHERE kind IN ('static', 'optical') AND dwell_s >= 6
)
SELECT site_id, rank, key, frame_idx, kind, round(threat, 6) AS threat, dwell_s FROM r WHERE rank <= 12""",
)
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = assess.watch_list(assessments(spark, sf_dir))
    return w.select("site_id", "rank", "key", "frame_idx", "kind", F.round("threat", 6).alias("threat"), "dwell_s")


@REGISTRY.add(
    "top_contacts",
    "WITH " + BOXES_SQL + """
, r AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, frame_idx ORDER BY area DESC, det_id)::INTEGER AS rank, count(*) OVER (PARTITION BY site_id, frame_idx) AS n
  FROM boxes WHERE sensor = 'optical'
)
SELECT site_id, frame_idx, det_id, rank, greatest(n - 2, 0) AS hidden FROM r WHERE rank <= 2""",
)
def top_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = assess.top_contacts(boxes(spark, sf_dir).filter(F.col("sensor") == "optical"), 2)
    return top.select("site_id", "frame_idx", "det_id", "rank", F.col("hidden").cast("long").alias("hidden"))


CLOSED_SQL = """
, closed AS (
  SELECT site_id, key, t_us AS opened_us, t_us + (dwell_s * 1000000)::BIGINT AS closed_us, threat,
         CASE WHEN threat >= 0.75 THEN 'alert' WHEN threat >= 0.45 THEN 'watch' ELSE 'nominal' END AS level, label = 'bird' AS still FROM assessments
)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return assessments(spark, sf_dir).select(
        "site_id", "key", c("t_us").alias("opened_us"), F.when(c("label") != "bird", c("t_us") + (c("dwell_s") * 1000000).cast("long")).alias("closed_us"),
        "threat", T.level(c("threat")).alias("level"),
    )


@REGISTRY.add(
    "alert_history",
    "WITH " + assessments_sql() + CLOSED_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY closed_us DESC, opened_us DESC, key)::INTEGER AS rank FROM closed WHERE NOT still)
SELECT site_id, rank, key, opened_us, closed_us FROM r WHERE rank <= 20""",
)
def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.alert_history(intervals(spark, sf_dir)).select("site_id", "rank", "key", "opened_us", "closed_us")


@REGISTRY.add(
    "alert_board",
    "WITH " + assessments_sql() + CLOSED_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY site_id, level ORDER BY opened_us DESC, key)::INTEGER AS rank, count(*) OVER (PARTITION BY site_id, level) AS n FROM closed)
SELECT site_id, level, rank, key, opened_us, n AS of_level FROM r WHERE rank <= 3""",
)
def alert_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.alert_board(intervals(spark, sf_dir)).select("site_id", "level", "rank", "key", "opened_us", "of_level")


@REGISTRY.add(
    "active_alerts",
    "WITH " + assessments_sql() + CLOSED_SQL + """
SELECT site_id, key, opened_us, round(threat, 6) AS threat FROM closed WHERE still""",
)
def active_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.active_alerts(intervals(spark, sf_dir)).select("site_id", "key", "opened_us", F.round("threat", 6).alias("threat"))


@REGISTRY.add(
    "cross_trail",
    "WITH " + assessments_sql() + """
, r AS (
  SELECT site_id, key, frame_idx, CASE kind WHEN 'track' THEN 'thermal asks optical' ELSE 'optical asks thermal' END AS dir,
         row_number() OVER (PARTITION BY site_id ORDER BY frame_idx DESC, key) AS rank FROM assessments
)
SELECT site_id, key, frame_idx, dir FROM r WHERE rank <= 14""",
)
def cross_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir)

    def asked(kind: str, text: str) -> DataFrame:
        return a.filter(F.col("kind") == kind).select("site_id", "key", "frame_idx", F.lit(text).alias("dir"))

    back = "optical asks thermal"
    return assess.cross_trail(asked("track", "thermal asks optical"), asked("optical", back), asked("static", back)).drop("rank")


@REGISTRY.add(
    "current_state",
    "WITH " + assessments_sql() + """
SELECT site_id, key, max(frame_idx) AS frame_idx, arg_max(label, frame_idx) AS label, round(arg_max(threat, frame_idx), 6) AS threat FROM assessments GROUP BY ALL""",
)
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = assess.current_state(assessments(spark, sf_dir), ["site_id", "key"], "frame_idx", ["frame_idx", "label", "threat"])
    return s.select("site_id", "key", "frame_idx", "label", F.round("threat", 6).alias("threat"))


@REGISTRY.add(
    "site_levels",
    "WITH " + assessments_sql() + CLOSED_SQL + " SELECT site_id, level, count(*) AS objects, round(max(threat), 6) AS peak FROM closed WHERE level <> 'nominal' GROUP BY ALL",
)
def site_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assess.worth_showing(assessments(spark, sf_dir).withColumn("level", T.level(F.col("threat"))))
    return assess.site_levels(a).select("site_id", "level", "objects", *r6("peak"))


@REGISTRY.add(
    "class_hues",
    """
SELECT event_type, count(*) AS seen, hue FROM events
JOIN (VALUES ('click', 88), ('error', 165), ('purchase', 163), ('signup', 75), ('view', 70)) AS known(event_type, hue) USING (event_type) GROUP BY ALL""",
)
def class_hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("seen")).withColumn("hue", class_hue(F.col("event_type")))


PACKETS_SQL = """
packets AS (
  SELECT user_id % 10 AS site_id, user_id AS session, event_id AS seq, k, (CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN k % 13 = 5 THEN 64 ELSE 0 END) + (k // 50)::BIGINT % 2 AS flags,
         greatest(2 + k - 2, 0)::BIGINT AS body
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), marked AS (
  SELECT *, (flags & 2) <> 0 AS eof, (flags & 64) <> 0 AS err, flags & 1 AS fid,
         lag((flags & 2) <> 0) OVER w AS was_eof, lag(flags & 1) OVER w AS was_fid
  FROM packets WINDOW w AS (PARTITION BY session ORDER BY seq)
), cut AS (
  SELECT *, sum(CASE WHEN coalesce(was_eof, true) OR was_fid <> fid THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS frame_no FROM marked
), framed AS (
  SELECT site_id, session, frame_no, min(seq) AS first_seq, count(*) AS packets, sum(body)::BIGINT AS bytes, count(*) FILTER (err) AS errors, bool_or(eof) AS ended,
         frame_no = max(frame_no) OVER (PARTITION BY session) AS newest
  FROM cut GROUP BY site_id, session, frame_no
), classed AS (
  SELECT *, CASE WHEN NOT ended THEN CASE WHEN newest THEN 'open' WHEN bytes > 0 THEN 'torn' ELSE 'empty' END WHEN errors > 0 THEN 'error'
                 WHEN bytes < 80 THEN 'short' WHEN bytes - 80 > 120 THEN 'mismatched' ELSE 'good' END AS state FROM framed
)"""
TINY = Sensor(frame_bytes=80, slack_bytes=120)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    flags = F.when(k % 3 == 0, 2).otherwise(0) + F.when(k % 13 == 5, 64).otherwise(0) + F.floor(k / 50).cast("int") % 2
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(10)).cast("long").alias("site_id"), F.col("user_id").alias("session"), F.col("event_id").alias("seq"),
        F.lit(2).alias("header_len"), flags.alias("flags"), F.encode(F.repeat(F.lit("a"), k + 2), "utf-8").alias("payload"),
    )


@REGISTRY.add("packet_frames", "WITH " + PACKETS_SQL + " SELECT site_id, session, first_seq, packets, bytes, errors, state, CASE WHEN state = 'good' THEN 80 END::INTEGER AS frame_bytes FROM classed")
def packet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    f = feeds.packet_frames(p, TINY, chunk_span(p, "seq"))
    return f.select("site_id", "session", "first_seq", "packets", "bytes", "errors", "state", F.length("frame").alias("frame_bytes"))


@REGISTRY.add(
    "feed_health",
    "WITH " + PACKETS_SQL + """
, h AS (SELECT site_id, count(*) FILTER (state = 'good') AS frames, count(*) FILTER (state = 'short') AS short, count(*) FILTER (state = 'torn') AS torn,
  sum(errors)::BIGINT AS errors, count(*) FILTER (state = 'mismatched') AS mismatched FROM classed GROUP BY 1)
SELECT *, round(100.0 * frames / (frames + short + torn + errors + mismatched), 1)::DOUBLE AS good_pct FROM h""",
)
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return feeds.feed_health(feeds.packet_frames(p, TINY, chunk_span(p, "seq"), payload=False))


@REGISTRY.add(
    "feed_gaps",
    "WITH " + assessments_sql() + """
, g AS (SELECT site_id, key, frame_idx, (t_us - lag(t_us) OVER (PARTITION BY site_id, key ORDER BY frame_idx)) / 1000000.0 AS gap FROM assessments)
SELECT site_id, key, frame_idx, round(gap, 6)::DOUBLE AS gap_s, coalesce(gap >= 36000, false) AS stale FROM g""",
)
def feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir)
    g = feeds.feed_gaps(a, ["site_id", "key"], Sensor(stale_after_s=36000.0), chunk_span(a))
    return g.select("site_id", "key", "frame_idx", F.round("gap_s", 6).alias("gap_s"), "stale")


@REGISTRY.add(
    "read_failures",
    "WITH " + assessments_sql() + """
, n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY frame_idx) AS i FROM assessments
), f AS (SELECT *, i - coalesce(max(CASE WHEN threat >= 0.9 THEN i END) OVER (PARTITION BY site_id ORDER BY frame_idx), 0) AS failures FROM n)
SELECT site_id, frame_idx, failures, failures = 5 OR (failures > 5 AND failures % 10 = 0) AS warn FROM f""",
)
def read_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir).withColumn("ok", F.col("threat") >= 0.9)
    r = feeds.read_failures(a, ["site_id"], Sensor(warn_after_failures=5, warn_every_failures=10), chunk_span(a))
    return r.select("site_id", "frame_idx", "failures", "warn")


@REGISTRY.add(
    "asof_pairs",
    "WITH " + assessments_sql() + """
SELECT o.site_id, o.frame_idx, t.frame_idx AS thermal_frame, round((o.t_us - t.t_us) / 1000000.0, 6)::DOUBLE AS age_s
FROM (SELECT * FROM assessments WHERE kind = 'optical') o ASOF LEFT JOIN (SELECT * FROM assessments WHERE kind <> 'optical') t
  ON t.site_id = o.site_id AND o.t_us >= t.t_us""",
)
def asof_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir).select("site_id", "frame_idx", "t_us", "kind")
    span = chunk_span(a, "t_us", 60 * DAY)
    p = feeds.paired(a.filter(F.col("kind") == "optical"), a.filter(F.col("kind") != "optical"), span)
    return p.select("site_id", "frame_idx", "thermal_frame", F.round("age_s", 6).alias("age_s"))


REPLY_SQL = """
r AS (
  SELECT conv_id, turn, conv_id % 4 AS c, turn AS t, length(text) AS n FROM conversations
)"""


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns dressed as model replies: fenced, between the turn's own words, bare or broken."""
    n, c = F.length("text"), F.col("conv_id") % 4
    doc = F.format_string(
        '{"class": "%s", "rotors": %d, "size_class": "small", "payload": "possible", "candidate_models": ["m%d", "n"], "confidence": %.2f}',
        F.when(F.col("turn") % 2 == 0, "multirotor").otherwise("bird"), n % 5, n % 9, (n % 100) / 100.0,
    )
    said = F.translate("text", "{}", "()")
    text = (
        F.when(c == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
        .when(c == 1, F.concat(said, F.lit("\n"), doc, said))
        .when(c == 2, doc)
        .when(F.col("turn") % 2 == 0, said)
        .otherwise(F.concat(said, F.lit("{not json}")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


@REGISTRY.add(
    "reply_parse",
    "WITH " + REPLY_SQL + """
SELECT conv_id, turn, c < 3 AS ok, CASE WHEN c < 3 THEN NULL WHEN t % 2 = 0 THEN 'no JSON object in reply' ELSE 'malformed JSON' END AS error,
  CASE WHEN c < 3 THEN (CASE WHEN t % 2 = 0 THEN 'multirotor' ELSE 'bird' END) || CASE WHEN n % 5 > 0 THEN ', ' || n % 5 || ' rotors' ELSE '' END
    || ', small, payload possible - possibly m' || n % 9 || ', n (remote model, ' || printf('%.2f', (n % 100) / 100.0) || ')'
  WHEN t % 2 = 0 THEN 'identification unavailable (no JSON object in reply)' ELSE 'identification unavailable (malformed JSON)' END AS summary
FROM r""",
)
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = replies.parsed(model_replies(spark, sf_dir))
    return p.select("conv_id", "turn", "ok", "error", replies.summary().alias("summary"))


@REGISTRY.add(
    "first_objects",
    "WITH " + REPLY_SQL + " SELECT conv_id, turn, CASE WHEN c < 3 OR t % 2 = 1 THEN true ELSE false END AS has_object FROM r",
)
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("text").contains("{"), F.concat(F.col("text"), F.lit(" then {\"b\": {}}"))).otherwise(F.col("text"))
    m = model_replies(spark, sf_dir)
    return m.select("conv_id", "turn", replies.first_object(text).isNotNull().alias("has_object"))


@REGISTRY.add(
    "service_counters",
    "WITH " + assessments_sql() + """
, r AS (SELECT conv_id % 10 AS site_id, conv_id % 4 < 3 AS ok FROM conversations)
SELECT w.site_id, wanted, coalesce(sent, 0) AS sent, coalesce(calls, 0) AS calls, coalesce(failures, 0) AS failures,
  greatest(coalesce(sent, 0) - coalesce(calls, 0) - coalesce(failures, 0), 0) AS pending
FROM (SELECT site_id, count(*) AS wanted FROM assessments WHERE threat >= 0.5 GROUP BY 1) w
LEFT JOIN (SELECT site_id, count(*) AS sent FROM assessments WHERE threat >= 0.75 GROUP BY 1) s ON s.site_id = w.site_id
LEFT JOIN (SELECT site_id, count(*) FILTER (ok) AS calls, count(*) FILTER (NOT ok) AS failures FROM r GROUP BY 1) a ON a.site_id = w.site_id""",
)
def service_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir)
    r = replies.parsed(model_replies(spark, sf_dir)).withColumn("site_id", F.col("conv_id") % 10)
    return assess.service_counters(a.filter(F.col("threat") >= 0.5), a.filter(F.col("threat") >= 0.75), r)


def rig_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stand-ins as point pairs under the known map, one in five of them wrong."""
    e = F.col("event_id")
    tx = F.get_json_object("props", "$.k").cast("double") * 2.56
    ty = F.pmod("value", F.lit(192.0))
    rows = table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(10)).cast("long").alias("site_id"), F.floor(e / 4).cast("long").alias("tick"), e.alias("pair_id"),
        tx.alias("tx"), ty.alias("ty"), (F.pmod(e, F.lit(7)) - 3).alias("jitter"), (F.pmod(e, F.lit(5)) == 0).alias("wrong"),
    )
    x, y = F.col("tx"), F.col("ty")
    d = H[6] * x + H[7] * y + H[8]
    off = F.col("jitter") * 0.1
    far = F.when(F.col("wrong"), 40.0 + F.pmod("pair_id", F.lit(31)).cast("double")).otherwise(0.0)
    return rows.select(
        "site_id", "tick", "pair_id", "tx", "ty", ((H[0] * x + H[1] * y + H[2]) / d + off + far).alias("ox"), ((H[3] * x + H[4] * y + H[5]) / d - off).alias("oy")
    )


MX, MY = map_sql("x", "y")
ERR_X, ERR_Y = map_sql("tx", "ty")
PAIRS_SQL = f"""
base AS (
  SELECT user_id % 10 AS site_id, event_id // 4 AS tick, event_id AS pair_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2.56 AS x, value % 192.0::DOUBLE AS y,
         (event_id % 7 - 3) * 0.1::DOUBLE AS jit, CASE WHEN event_id % 5 = 0 THEN 40.0::DOUBLE + event_id % 31 ELSE 0 END AS far FROM events
), pairs AS (
  SELECT site_id, tick, pair_id, x AS tx, y AS ty, {MX} + jit + far AS ox, {MY} - jit AS oy FROM base
)"""


@REGISTRY.add(
    "reprojection",
    "WITH " + PAIRS_SQL + f", err AS (SELECT site_id, sqrt(pow({ERR_X} - ox, 2) + pow({ERR_Y} - oy, 2)) AS e FROM pairs)" + """
SELECT site_id, count(*) AS pairs, round(avg(e), 6) AS mean_px, round(max(e), 6) AS max_px FROM err GROUP BY 1""",
)
def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rig_pairs(spark, sf_dir)
    maps = pairs.select("site_id").distinct().withColumn("h", h_col())
    return calibration.reprojection(pairs, maps).select("site_id", "pairs", *r6("mean_px", "max_px"))


@REGISTRY.add(
    "spread_check",
    "WITH " + PAIRS_SQL + """
, a AS (SELECT site_id, count(*) AS points, (max(tx) - min(tx)) / 256 AS across, (max(ty) - min(ty)) / 192 AS down, var_samp(tx) AS vx, var_samp(ty) AS vy, covar_samp(tx, ty) AS cxy FROM pairs GROUP BY 1
), m AS (SELECT *, sqrt(greatest((vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + cxy * cxy), 0)) / 192 AS minor FROM a)
SELECT site_id, points, round(across, 6) AS across, round(down, 6) AS down, round(minor, 6) AS minor, points >= 4 AND across >= 0.25 AND down >= 0.25 AND minor >= 0.05 AS spread_ok FROM m""",
)
def spread_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.spread(rig_pairs(spark, sf_dir)).select("site_id", "points", *r6("across", "down", "minor"), "spread_ok")


SCENERY = Rig(scenery_window=20, scenery_share=0.35, scenery_warmup=10)


@REGISTRY.add(
    "scenery_mask",
    "WITH " + PAIRS_SQL + """
, d AS (SELECT site_id, dense_rank() OVER (PARTITION BY site_id ORDER BY tick) AS tick, pair_id, tx AS cx, ty AS cy, floor(trunc(tx) / 64)::BIGINT AS gx, floor(trunc(ty) / 64)::BIGINT AS gy FROM pairs
), o AS (SELECT DISTINCT site_id, tick, gx, gy FROM d
), c AS (SELECT *, count(*) OVER (PARTITION BY site_id, gx, gy ORDER BY tick RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS seen FROM o)
SELECT d.site_id, d.tick, d.pair_id FROM d JOIN c USING (site_id, tick, gx, gy) WHERE NOT (least(tick, 20) >= 10 AND seen >= 0.35 * least(tick, 20))""",
)
def scenery_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = rig_pairs(spark, sf_dir).withColumnRenamed("tick", "frame_idx")
    span = chunk_span(pairs)
    d = pairs.join(calibration.ticks(pairs, span), ["site_id", "frame_idx"]).withColumnsRenamed({"tx": "cx", "ty": "cy"})
    return calibration.without_scenery(d, 64, SCENERY, span).select("site_id", "tick", "pair_id")


@REGISTRY.add(
    "mover_pairs",
    "WITH " + PAIRS_SQL + """
, t AS (SELECT * FROM pairs WHERE pair_id % 2 = 0), o AS (SELECT * FROM pairs WHERE pair_id % 2 = 1
), ft AS (SELECT site_id, tick FROM t GROUP BY ALL HAVING count(*) <= 2), fo AS (SELECT site_id, tick FROM o GROUP BY ALL HAVING count(*) <= 3)
SELECT t.site_id, t.tick, round(t.tx, 4) AS tx, round(t.ty, 4) AS ty, round(o.ox, 4) AS ox, round(o.oy, 4) AS oy
FROM t JOIN o ON o.site_id = t.site_id AND o.tick = t.tick JOIN ft ON ft.site_id = t.site_id AND ft.tick = t.tick JOIN fo ON fo.site_id = t.site_id AND fo.tick = t.tick""",
)
def mover_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rig_pairs(spark, sf_dir)
    even = F.col("pair_id") % 2 == 0
    t = p.filter(even).withColumnsRenamed({"tx": "cx", "ty": "cy"})
    o = p.filter(~even).withColumnsRenamed({"ox": "cx", "oy": "cy"})
    r4 = [F.round(c, 4).alias(c) for c in ("tx", "ty", "ox", "oy")]
    return calibration.mover_pairs(t, o).select("site_id", "tick", *r4)


@REGISTRY.add("fit_homography")
def fit_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = calibration.accepted(calibration.fit(rig_pairs(spark, sf_dir)))
    gap = calibration.corner_disagreement(F.col("h"), h_col(), 192, 256)
    return fits.select("site_id", "pairs", "inliers", "frames", *r6("mean_px"), "accepted", F.round(gap, 4).alias("corner_px"))


@REGISTRY.add(
    "display_activity",
    "WITH " + assessments_sql() + """
, m AS (SELECT site_id, max(threat) AS top FROM assessments GROUP BY 1)
SELECT a.site_id, frame_idx, round(sqrt(greatest(0, least(1, threat / greatest(top, 1e-6)))), 6) AS rate, round(greatest(0, least(1, (threat - 0.02) / 0.23)), 6) AS active
FROM assessments a JOIN m ON m.site_id = a.site_id""",
)
def display_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir)
    top = a.groupBy("site_id").agg(F.max("threat").alias("top"))
    j = a.join(top, "site_id")
    return j.select(
        "site_id", "frame_idx", F.round(site.display_rate(F.col("threat"), F.col("top")), 6).alias("rate"),
        F.round(site.display_activity(F.col("threat")), 6).alias("active"),
    )




@REGISTRY.add(
    "detection_details",
    "WITH " + assessments_sql() + """
SELECT d.site_id, d.frame_idx, d.track_id, round(t.confidence, 6) AS confidence, round(a.threat, 6) AS threat, i.label AS said
FROM assessments d
LEFT JOIN (SELECT * FROM assessments WHERE kind <> 'static') t USING (site_id, frame_idx, track_id)
LEFT JOIN (SELECT * FROM assessments WHERE kind = 'track') a USING (site_id, frame_idx, track_id)
LEFT JOIN (SELECT site_id, key, arg_max(label, frame_idx) AS label FROM assessments WHERE threat >= 0.9 GROUP BY ALL) i ON i.site_id = d.site_id AND i.key = d.key""",
)
def detection_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir)
    dets = a.select("site_id", "frame_idx", "track_id", "key")
    known = a.filter(F.col("kind") != "static").select("site_id", "frame_idx", "track_id", "confidence")
    judged = a.filter(F.col("kind") == "track").select("site_id", "frame_idx", "track_id", "threat")
    said = assess.current_state(a.filter(F.col("threat") >= 0.9), ["site_id", "key"], "frame_idx", ["label"])
    d = assess.annotated(assess.with_details(dets, known, judged), said.withColumnRenamed("label", "said"))
    return d.select("site_id", "frame_idx", "track_id", *r6("confidence", "threat"), "said")


@REGISTRY.add(
    "drawn_names",
    "WITH " + assessments_sql() + """
, r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY confidence DESC, key, frame_idx)::INTEGER AS rank FROM assessments)
SELECT site_id, rank, key, frame_idx, round(confidence, 6) AS confidence FROM r WHERE rank <= 12""",
)
def drawn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir)
    top = assess.top_per(a, ["site_id"], [F.desc("confidence"), F.col("key"), F.col("frame_idx")], 12)
    return top.select("site_id", "rank", "key", "frame_idx", *r6("confidence"))


@REGISTRY.add("request_payloads")
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perimetra.operators import tracks
    from perimetra.sources.adapters import track_obs

    obs = track_obs(spark, sf_dir)
    t = tracks.classified(tracks.kinematics(obs, span=chunk_span(obs, keys=tracks.TRACK)))
    c = F.col
    t = t.withColumns(
        {
            "x": c("cx") - 2, "y": c("cy") - 2, "w": F.lit(4.0), "h": F.lit(4.0), "solidity": c("extent"),
            "threat": T.identity_risk(c("label"), c("confidence")), "dwell_s": F.lit(0.0),
        }
    )
    return t.select("site_id", "track_id", "frame_idx", replies.track_request().alias("payload"), replies.measurements().alias("text"))


@REGISTRY.add(
    "learning_sessions",
    "WITH " + assessments_sql() + """
, m AS (SELECT site_id, frame_idx, t_us, CASE WHEN frame_idx % 3 = 0 THEN 'stop_learning' ELSE 'start_learning' END AS action FROM assessments WHERE threat > 0.8
), l AS (SELECT *, lead(t_us) OVER (PARTITION BY site_id ORDER BY frame_idx) AS ended_us FROM m)
SELECT site_id, t_us AS started_us, ended_us, coalesce((ended_us - t_us) / 1000000.0 >= 7200, false) AS done FROM l WHERE action = 'start_learning'""",
)
def learning_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir).filter(F.col("threat") > 0.8)
    acts = a.select(
        "site_id", "frame_idx", "t_us", F.when(F.col("frame_idx") % 3 == 0, "stop_learning").otherwise("start_learning").alias("action"),
        F.lit(7200.0).alias("seconds"), F.lit(True).alias("reset"),
    )
    return site.learning_sessions(acts, chunk_span(a)).select("site_id", "started_us", "ended_us", "done")


@REGISTRY.add(
    "manual_gate",
    "WITH " + PAIRS_SQL + f", err AS (SELECT site_id, pair_id // 40 AS clicks, sqrt(pow({ERR_X} - ox, 2) + pow({ERR_Y} - oy, 2)) AS e FROM pairs)" + """
SELECT site_id + 10 * clicks AS site_id, count(*) AS pairs, round(avg(e), 6) AS mean_px FROM err GROUP BY site_id, clicks HAVING count(*) >= 4 AND avg(e) < 5""",
)
def manual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made calibrations, some of few points, that are good enough to save."""
    pairs = rig_pairs(spark, sf_dir).withColumn("site_id", (F.col("site_id") + 10 * F.floor(F.col("pair_id") / 40)).cast("long"))
    maps = pairs.select("site_id").distinct().withColumn("h", h_col())
    return calibration.manual_ok(calibration.reprojection(pairs, maps)).select("site_id", "pairs", *r6("mean_px"))


@REGISTRY.add(
    "probe_summary",
    """
WITH f AS (
  SELECT l_suppkey % 10 AS site_id, l_orderkey AS s, 4850 + floor(l_extendedprice / 10)::BIGINT AS hi, 4800 + l_partkey % 50 AS lo, 20.0::DOUBLE + l_tax * 100 AS ambient FROM lineitem
), g AS (
  SELECT site_id, s // 2 * 2 AS start_s, min(least(lo, hi)) OVER w AS raw_min, greatest(lo, hi) AS raw, ambient,
         row_number() OVER (PARTITION BY site_id, s // 2 ORDER BY greatest(lo, hi) DESC, ambient DESC) AS rank
  FROM f WINDOW w AS (PARTITION BY site_id, s // 2)
), u AS (SELECT *, ambient + (raw - 4850.0::DOUBLE) / 31.0::DOUBLE AS lin FROM g WHERE rank = 1)
SELECT site_id, start_s, round(ambient, 6) AS ambient_c, raw_min, raw AS raw_max, round(lin, 6) AS linear_c,
  round(1.0157::DOUBLE * CASE WHEN lin <= 150 THEN -0.00294::DOUBLE * lin * lin + 1.129::DOUBLE * lin + -3.12::DOUBLE ELSE lin - 49.92::DOUBLE END + 3.37::DOUBLE, 6) AS celsius
FROM u""",
)
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, linear and calibrated reading of the hottest pixel, every two seconds."""
    c = F.col
    frames = table(spark, sf_dir, "lineitem").select(
        (c("l_suppkey") % 10).alias("site_id"), F.timestamp_seconds("l_orderkey").alias("ts"),
        F.array((4800 + c("l_partkey") % 50).cast("int"), (4850 + F.floor(c("l_extendedprice") / 10)).cast("int")).alias("counts"),
        (20.0 + c("l_tax") * 100).cast("double").alias("ambient_c"),
    )
    p = feeds.probe(frames)
    long = [c(n).cast("long").alias(n) for n in ("raw_min", "raw_max")]
    return p.select("site_id", c("start").cast("long").alias("start_s"), *long, *r6("ambient_c", "linear_c", "celsius"))


@REGISTRY.add(
    "evidence_sentences",
    "WITH " + BOXES_SQL + """
, e AS (
  SELECT site_id, frame_idx, det_id, quantity::BIGINT % 6 AS q, quantity::DOUBLE AS n, 20 + quantity::DOUBLE / 5 AS peak, quantity::DOUBLE - 25 AS up, quantity::DOUBLE / 100 AS sol,
         (det_id // 100 % 100) / 4.0::DOUBLE AS aspect, floor(area)::BIGINT AS px FROM boxes
)
SELECT site_id, frame_idx, det_id,
  CASE WHEN q = 0 THEN 'not asked' WHEN q = 1 THEN 'outside the thermal field of view' WHEN q = 2 THEN 'hidden'
       WHEN up >= 1.2 THEN printf('warm - %.1f C peak, %+.1f C above surroundings', peak, up)
       ELSE printf('NOT warm - %.1f C peak, only %+.1f C above surroundings', peak, up) END AS thermal,
  CASE WHEN q = 0 THEN 'not asked' WHEN q = 1 THEN 'nothing there' WHEN q = 2 THEN 'hidden'
       WHEN q = 3 THEN printf('it is a person (%.2f) - solidity %.2f, aspect %.2f, ', sol, sol, aspect) || px || ' px'
       WHEN q = 4 THEN printf('looks like bird (%.2f) - solidity %.2f, aspect %.2f, ', sol, sol, aspect) || px || ' px'
       ELSE printf('shape unclear - solidity %.2f, aspect %.2f, ', sol, aspect) || px || ' px' END AS optical
FROM e""",
)
def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sensor says back when it is asked about an object, in every kind of answer."""
    c = F.col
    q, n = c("quantity").cast("long") % 6, c("quantity").cast("double")
    asked, found = q != 0, ~q.isin(1, 2)
    reason = F.when(q == 1, "").when(q == 2, "hidden")
    sol, aspect = n / 100, (F.floor(c("det_id") / 100).cast("long") % 100) / 4.0
    label = F.when(q == 4, "bird").otherwise("unknown")
    name = F.when(q == 3, "person")
    heat = T.thermal_answer(asked, found, n - 25 >= 1.2, 20 + n / 5, n - 25, reason)
    shape = T.optical_answer(asked, found, label, sol, sol, aspect, c("area"), reason, name, sol)
    return boxes(spark, sf_dir).select("site_id", "frame_idx", "det_id", heat.alias("thermal"), shape.alias("optical"))
