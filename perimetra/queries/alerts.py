"""Queries with state over time: alerts, dwell, numbers, tracks, settled regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perimetra.operators import alerts, regions, site, tracks
from perimetra.operators.scans import chunk_span
from perimetra.params import Alerting, Escalate, Fusion, Tracking
from perimetra.queries import REGISTRY
from perimetra.queries.site import CELLS_SQL, MODEL_SQL, OPTICAL_SQL, PERSIST_SQL, SMALL, SMALL_OPTICAL, small_optical, small_reads
from perimetra.queries.tracks import KINEMATICS_SQL
from perimetra.sources.adapters import BOXES_SQL, assessments, assessments_sql, boxes, track_obs, track_obs_sql

# Events are hours apart, so the clock-based limits are hours too.
HOURS = Alerting(open_after=2, threshold=0.5, close_after_s=43200.0, forget_number_s=43200.0)

ABSENCE_SQL = """
, clock AS (SELECT site_id, frame_idx, t_us FROM assessments
), ends AS (
  SELECT * FROM (SELECT DISTINCT site_id, key FROM assessments) JOIN (SELECT site_id, max(frame_idx) + 1 AS frame_idx, max(t_us) + 1 AS t_us FROM clock GROUP BY 1) USING (site_id)
), every AS (
  SELECT site_id, key, frame_idx, t_us, threat, label, dwell_s FROM assessments
  UNION ALL SELECT site_id, key, frame_idx, t_us, NULL, NULL, NULL FROM ends
), lagged AS (SELECT *, lag(t_us) OVER (PARTITION BY site_id, key ORDER BY frame_idx) + {gap} AS due FROM every
), away AS (
  SELECT l.*, CASE WHEN c.frame_idx < l.frame_idx THEN c.t_us END AS away_us, CASE WHEN c.frame_idx < l.frame_idx THEN c.frame_idx END AS away_frame
  FROM lagged l ASOF LEFT JOIN clock c ON c.site_id = l.site_id AND c.t_us >= l.due
)"""


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int | None]:
    a = assessments(spark, sf_dir)
    return a, a.select("site_id", "frame_idx", "t_us"), chunk_span(a)


INTERVALS_SQL = (
    "WITH RECURSIVE " + assessments_sql() + ABSENCE_SQL.format(gap=43200000000) + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY frame_idx) AS i FROM away
), walk AS (
  SELECT site_id, key, 0::BIGINT AS i, 0::BIGINT AS streak, NULL::BIGINT AS opened_us, NULL::BIGINT AS opened_frame, NULL::BIGINT AS updated_us, 0::BIGINT AS frames, 0.0::DOUBLE AS peak,
         NULL::BIGINT AS shut_us, NULL::BIGINT AS was_opened, NULL::BIGINT AS was_frame, NULL::BIGINT AS was_updated, 0::BIGINT AS was_frames, 0.0::DOUBLE AS was_peak
  FROM placed WHERE i = 1
  UNION ALL
  SELECT site_id, key, i, s2, CASE WHEN o1 IS NOT NULL THEN o1 WHEN opens THEN t_us END, CASE WHEN o1 IS NOT NULL THEN f1 WHEN opens THEN frame_idx END,
         CASE WHEN threat IS NULL THEN updated_us WHEN o1 IS NOT NULL OR opens THEN t_us END,
         CASE WHEN threat IS NULL THEN frames WHEN o1 IS NOT NULL THEN frames + 1 WHEN opens THEN 2 ELSE 0 END,
         CASE WHEN threat IS NULL THEN peak WHEN o1 IS NOT NULL THEN greatest(peak, threat) WHEN opens THEN threat ELSE 0 END,
         CASE WHEN shuts THEN away_us END, opened_us, opened_frame, updated_us, frames, peak
  FROM (
    SELECT *, o1 IS NULL AND s2 >= 2 AND threat >= 0.5 AS opens
    FROM (
      SELECT *, CASE WHEN threat IS NULL THEN s1 WHEN threat >= 0.5 THEN s1 + 1 ELSE 0 END AS s2
      FROM (
        SELECT p.site_id, p.key, p.i, p.t_us, p.frame_idx, p.threat, p.away_us, w.opened_us, w.opened_frame, w.updated_us, w.frames, w.peak,
               w.opened_us IS NOT NULL AND p.away_us IS NOT NULL AS shuts,
               CASE WHEN w.opened_us IS NOT NULL AND p.away_us IS NOT NULL THEN 0 ELSE w.streak END AS s1,
               CASE WHEN w.opened_us IS NOT NULL AND p.away_us IS NOT NULL THEN NULL ELSE w.opened_us END AS o1,
               CASE WHEN w.opened_us IS NOT NULL AND p.away_us IS NOT NULL THEN NULL ELSE w.opened_frame END AS f1
        FROM walk w JOIN placed p ON p.site_id = w.site_id AND p.key = w.key AND p.i = w.i + 1
      )
    )
  )
), last AS (SELECT site_id, key, max(i) AS i FROM walk GROUP BY ALL)
SELECT site_id, key, was_frame AS opened_frame, was_opened AS opened_us, was_updated AS updated_us, shut_us AS closed_us, was_frames AS frames, round(was_peak, 6) AS peak_threat
FROM walk WHERE shut_us IS NOT NULL
UNION ALL
SELECT site_id, key, opened_frame, opened_us, updated_us, NULL, frames, round(peak, 6) FROM walk JOIN last USING (site_id, key, i) WHERE opened_us IS NOT NULL"""
)


@REGISTRY.add("alert_intervals", INTERVALS_SQL)
def alert_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, clock, span = both(spark, sf_dir)
    out = alerts.alert_intervals(a, clock, HOURS, span, None if span is None else alerts.DAY_US)
    return out.select(
        "site_id", "key", "opened_frame", "opened_us", "updated_us", "closed_us", "frames", F.round("peak_threat", 6).alias("peak_threat")
    )


@REGISTRY.add(
    "alert_events",
    f"""
WITH alert AS ({INTERVALS_SQL})
SELECT site_id, key, 'open' AS event, opened_us AS at_us, opened_us, frames, peak_threat FROM alert
UNION ALL SELECT site_id, key, 'close', closed_us, opened_us, frames, peak_threat FROM alert WHERE closed_us IS NOT NULL""",
)
def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, clock, span = both(spark, sf_dir)
    out = alerts.alert_intervals(a, clock, HOURS, span, None if span is None else alerts.DAY_US)
    told = alerts.alert_events(alerts.with_level(alerts.with_alert_ids(out, span)))
    return told.select("site_id", "key", "event", "at_us", "opened_us", "frames", F.round("peak_threat", 6).alias("peak_threat"))


@REGISTRY.add(
    "dwell",
    "WITH RECURSIVE " + track_obs_sql(still=True) + "," + KINEMATICS_SQL + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY site_id, track_id ORDER BY frame_idx) AS i FROM kinematics WHERE hits >= 4
), walk AS (
  SELECT site_id, track_id, frame_idx, t_us, i, cx AS ax, cy AS ay, NULL::BIGINT AS since FROM placed WHERE i = 1
  UNION ALL
  SELECT p.site_id, p.track_id, p.frame_idx, p.t_us, p.i,
    CASE WHEN sqrt((p.cx - ax) * (p.cx - ax) + (p.cy - ay) * (p.cy - ay)) > 3 THEN p.cx ELSE ax END,
    CASE WHEN sqrt((p.cx - ax) * (p.cx - ax) + (p.cy - ay) * (p.cy - ay)) > 3 THEN p.cy ELSE ay END,
    CASE WHEN sqrt((p.cx - ax) * (p.cx - ax) + (p.cy - ay) * (p.cy - ay)) > 3 THEN NULL ELSE coalesce(since, p.t_us) END
  FROM walk w JOIN placed p ON p.site_id = w.site_id AND p.track_id = w.track_id AND p.i = w.i + 1
)
SELECT site_id, track_id, frame_idx, round(coalesce(t_us - since, 0) / 1000000.0, 6)::DOUBLE AS dwell_s FROM walk""",
)
def dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = track_obs(spark, sf_dir, still=True)
    span = chunk_span(obs, keys=tracks.TRACK)
    d = alerts.dwell(tracks.kinematics(obs, span=span), span=span)
    return d.select("site_id", "track_id", "frame_idx", F.round("dwell_s", 6).alias("dwell_s"))


@REGISTRY.add(
    "object_numbers",
    "WITH RECURSIVE " + assessments_sql() + ABSENCE_SQL.format(gap=43200000001) + """
, parts AS (SELECT *, count(away_us) OVER (PARTITION BY site_id, key ORDER BY frame_idx) AS part FROM away
), stays AS (
  SELECT site_id, key, part, min(CASE WHEN threat IS NOT NULL THEN frame_idx END) AS start_frame,
         lead(min(away_frame)) OVER (PARTITION BY site_id, key ORDER BY part) AS release_frame
  FROM parts GROUP BY site_id, key, part
), turn AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY start_frame, key) AS i FROM stays WHERE start_frame IS NOT NULL
), walk AS (
  SELECT site_id, 0::BIGINT AS i, NULL::VARCHAR AS key, NULL::BIGINT AS start_frame, NULL::BIGINT AS number,
         []::STRUCT(n BIGINT, r DOUBLE)[] AS held
  FROM turn WHERE i = 1
  UNION ALL
  SELECT site_id, i, key, start_frame, n, list_append(alive, {'n': n, 'r': coalesce(release_frame::DOUBLE, 1e18)})
  FROM (
    SELECT *, list_min(list_filter(range(1, 1 + len(alive) + 1), lambda c: NOT list_contains(list_transform(alive, lambda h: h.n), c))) AS n
    FROM (
      SELECT t.site_id, t.i, t.key, t.start_frame, t.release_frame, list_filter(w.held, lambda h: h.r >= t.start_frame) AS alive
      FROM walk w JOIN turn t ON t.site_id = w.site_id AND t.i = w.i + 1
    )
  )
)
SELECT site_id, key, start_frame, number FROM walk WHERE i > 0""",
)
def object_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, clock, span = both(spark, sf_dir)
    n = alerts.object_numbers(a, clock, HOURS, span, None if span is None else alerts.DAY_US)
    return n.select("site_id", "key", "start_frame", "number")


ADMIT = Escalate(at=0.75, doubt_at=0.35, unsure_conf=0.65, cold_dwell_s=20.0, cooldown_s=86400.0, min_gap_s=7200.0)


@REGISTRY.add(
    "escalation_requests",
    "WITH RECURSIVE " + assessments_sql() + """
, cand AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY frame_idx, key) AS i FROM assessments
  WHERE (kind = 'track' AND (threat >= 0.75 OR ((label = 'unknown' OR confidence < 0.65) AND threat >= 0.35)))
     OR (kind = 'optical' AND (threat >= 0.75 OR (label <> 'drone' AND dwell_s >= 20)))
), walk AS (
  SELECT site_id, 0::BIGINT AS i, NULL::VARCHAR AS key, NULL::BIGINT AS frame_idx, NULL::BIGINT AS t_us, false AS ok,
         -1000000000000000::BIGINT AS last_us, MAP([]::VARCHAR[], []::BIGINT[]) AS asked FROM cand WHERE i = 1
  UNION ALL
  SELECT site_id, i, key, frame_idx, t_us, go, CASE WHEN go THEN t_us ELSE last_us END,
         CASE WHEN go THEN map_concat(asked, MAP([key], [t_us])) ELSE asked END
  FROM (
    SELECT c.site_id, c.i, c.key, c.frame_idx, c.t_us, w.last_us, w.asked,
           (c.t_us - w.last_us) / 1e6 >= 7200 AND coalesce((c.t_us - w.asked[c.key]) / 1e6 >= 86400, true) AS go
    FROM walk w JOIN cand c ON c.site_id = w.site_id AND c.i = w.i + 1
  )
)
SELECT site_id, key, frame_idx, t_us FROM walk WHERE ok""",
)
def escalation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir).withColumns({"found": F.lit(True), "warm": F.col("label") == "drone"})
    return alerts.admitted(alerts.escalation_candidates(a, ADMIT), ADMIT, chunk_span(a)).select("site_id", "key", "frame_idx", "t_us")


@REGISTRY.add(
    "request_desk",
    "WITH RECURSIVE " + assessments_sql() + """
, cand AS (
  SELECT site_id, key, t_us, 1 AS later FROM assessments
  WHERE (kind = 'track' AND (threat >= 0.75 OR ((label = 'unknown' OR confidence < 0.65) AND threat >= 0.35)))
     OR (kind = 'optical' AND (threat >= 0.75 OR (label <> 'drone' AND dwell_s >= 20)))
  UNION ALL SELECT site_id, key, t_us + 1, 0 FROM assessments WHERE frame_idx % 2 = 0
), row_ AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY t_us, later, key) AS i FROM cand
), walk AS (
  SELECT DISTINCT site_id, 0::BIGINT AS i, NULL::BIGINT AS t_us, -1000000000000000::BIGINT AS last_us, MAP([]::VARCHAR[], []::BIGINT[]) AS asked,
         NULL::VARCHAR AS away, []::VARCHAR[] AS waiting, []::STRUCT(key VARCHAR, event VARCHAR)[] AS told
  FROM row_
  UNION ALL
  SELECT site_id, i, t_us, CASE WHEN go THEN t_us ELSE last_us END, CASE WHEN go THEN map_concat(asked, MAP([key], [t_us])) ELSE asked END,
    CASE WHEN back THEN waiting[1] WHEN go AND away IS NULL THEN key ELSE away END,
    CASE WHEN back THEN waiting[2:] WHEN go AND away IS NOT NULL AND len(waiting) < 4 THEN list_append(waiting, key) ELSE waiting END,
    CASE WHEN back AND len(waiting) > 0 THEN [{'key': key, 'event': 'answered'}, {'key': waiting[1], 'event': 'sent'}]
         WHEN back THEN [{'key': key, 'event': 'answered'}]
         WHEN go AND away IS NULL THEN [{'key': key, 'event': 'sent'}]
         WHEN go AND len(waiting) < 4 THEN [{'key': key, 'event': 'queued'}]
         WHEN go THEN [{'key': key, 'event': 'turned away'}] ELSE []::STRUCT(key VARCHAR, event VARCHAR)[] END
  FROM (
    SELECT r.site_id, r.i, r.t_us, r.key, w.last_us, w.asked, w.away, w.waiting, r.later = 0 AND coalesce(r.key = w.away, false) AS back,
      r.later = 1 AND coalesce(r.key <> w.away, true) AND NOT list_contains(w.waiting, r.key)
      AND (r.t_us - w.last_us) / 1e6 >= 7200 AND coalesce((r.t_us - w.asked[r.key]) / 1e6 >= 86400, true) AS go
    FROM walk w JOIN row_ r ON r.site_id = w.site_id AND r.i = w.i + 1
  )
)
SELECT site_id, t_us, unnest(told).key AS key, unnest(told).event AS event FROM walk""",
)
def request_desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a queue; every second row of a site also stands for a reply about its object."""
    a = assessments(spark, sf_dir).withColumns({"found": F.lit(True), "warm": F.col("label") == "drone"})
    replies = a.filter(F.col("frame_idx") % 2 == 0).select("site_id", "key", (F.col("t_us") + 1).alias("t_us"))
    return alerts.request_desk(alerts.escalation_candidates(a, ADMIT), replies, ADMIT).select("site_id", "key", "t_us", "event")


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stand-ins as detections, a handful per frame."""
    obs = track_obs(spark, sf_dir)
    return obs.select(
        (F.col("site_id")).alias("site_id"), F.floor(F.col("frame_idx") / 40).cast("long").alias("frame_idx"), F.col("frame_idx").alias("det_id"),
        F.pmod("cx", F.lit(64.0)).alias("cx"), F.pmod("cy", F.lit(48.0)).alias("cy"), "area",
    )


TRACKS_SQL = "WITH RECURSIVE " + track_obs_sql() + """
, det AS (SELECT site_id, frame_idx // 40 AS frame_idx, frame_idx AS det_id, cx - 64 * floor(cx / 64) AS cx, cy - 48 * floor(cy / 48) AS cy, area FROM track_obs
), shot AS (
  SELECT site_id, frame_idx, list({'id': det_id, 'x': cx::DOUBLE, 'y': cy::DOUBLE} ORDER BY area DESC, det_id) AS dets,
         row_number() OVER (PARTITION BY site_id ORDER BY frame_idx) AS i
  FROM det GROUP BY site_id, frame_idx
), walk AS (
  SELECT DISTINCT site_id, 0::BIGINT AS i, 0::BIGINT AS frame_idx, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, miss BIGINT)[] AS live, 0::BIGINT AS made,
         []::STRUCT(det BIGINT, track BIGINT)[] AS told
  FROM shot
  UNION ALL
  SELECT site_id, i, frame_idx,
    list_concat(
      list_filter(list_transform(range(1, len(t) + 1), lambda k: CASE WHEN list_contains(m.ts, k)
        THEN {'id': t[k].id, 'x': dets[m.ds[list_position(m.ts, k)]].x, 'y': dets[m.ds[list_position(m.ts, k)]].y, 'miss': 0::BIGINT}
        ELSE {'id': t[k].id, 'x': t[k].x, 'y': t[k].y, 'miss': t[k].miss + 1} END), lambda q: q.miss <= 1),
      list_transform(fresh, lambda k: {'id': made + list_position(fresh, k), 'x': dets[k].x, 'y': dets[k].y, 'miss': 0::BIGINT})),
    made + len(fresh),
    list_transform(range(1, len(dets) + 1), lambda k: {'det': dets[k].id, 'track': CASE WHEN list_contains(m.ds, k)
      THEN t[m.ts[list_position(m.ds, k)]].id ELSE made + list_position(fresh, k) END})
  FROM (
    SELECT *, list_filter(range(1, len(dets) + 1), lambda k: NOT list_contains(m.ds, k)) AS fresh
    FROM (
      SELECT *, list_reduce(list_concat([{'ts': []::BIGINT[], 'ds': []::BIGINT[]}], list_transform(pairs, lambda q: {'ts': [q.ti], 'ds': [q.di]})),
               lambda acc, q: CASE WHEN list_contains(acc.ts, q.ts[1]) OR list_contains(acc.ds, q.ds[1]) THEN acc
                 ELSE {'ts': list_append(acc.ts, q.ts[1]), 'ds': list_append(acc.ds, q.ds[1])} END) AS m
      FROM (
        SELECT *, list_sort(list_filter(flatten(list_transform(range(1, len(t) + 1), lambda a: list_transform(range(1, len(dets) + 1), lambda b:
                 {'d': sqrt((t[a].x - dets[b].x) * (t[a].x - dets[b].x) + (t[a].y - dets[b].y) * (t[a].y - dets[b].y)), 'ti': a, 'di': b}))), lambda q: q.d <= 10)) AS pairs
        FROM (
          SELECT s.site_id, s.i, s.frame_idx, s.dets, w.made, CASE WHEN w.i = 0 OR s.frame_idx = w.frame_idx + 1 THEN w.live ELSE
                   list_filter(list_transform(w.live, lambda q: {'id': q.id, 'x': q.x, 'y': q.y, 'miss': q.miss + s.frame_idx - w.frame_idx - 1}), lambda q: q.miss <= 1) END AS t
          FROM walk w JOIN shot s ON s.site_id = w.site_id AND s.i = w.i + 1
        )
      )
    )
  )
)
SELECT site_id, frame_idx, unnest(told).det AS det_id, unnest(told).track AS track_id FROM walk"""


@REGISTRY.add("tracks_from_detections", TRACKS_SQL)
def tracks_from_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dets(spark, sf_dir)
    return alerts.tracked(d, Tracking(max_step_px=10.0, max_misses=1), chunk_span(d))


HELD = "STRUCT(label VARCHAR, confidence DOUBLE, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, seen_us BIGINT)"


@REGISTRY.add(
    "held_names",
    "WITH RECURSIVE " + assessments_sql() + f"""
, found AS (
  SELECT site_id, CASE WHEN frame_idx % 3 = 0 THEN 'aerial' ELSE 'rooms' END AS model, frame_idx // 50 AS frame_idx, t_us, label, confidence,
         (dwell_s - 20 * floor(dwell_s / 20))::DOUBLE AS x, (frame_idx % 20)::DOUBLE AS y
  FROM assessments
), pass AS (
  SELECT site_id, model, frame_idx, min(t_us) AS now, list({{'label': label, 'confidence': confidence, 'x': x, 'y': y}} ORDER BY confidence DESC, label, x, y) AS told
  FROM found GROUP BY ALL
), placed AS (
  SELECT site_id, model, frame_idx, now, row_number() OVER (PARTITION BY site_id, model ORDER BY frame_idx) AS i,
    list_transform(told, lambda q: [{{'label': q.label, 'confidence': q.confidence, 'x': q.x, 'y': q.y, 'w': 12.0, 'h': 12.0, 'seen_us': now}}::{HELD}]) AS fresh
  FROM pass
), walk AS (
  SELECT DISTINCT site_id, model, 0::BIGINT AS i, 0::BIGINT AS frame_idx, []::{HELD}[] AS held FROM placed
  UNION ALL
  SELECT site_id, model, i, frame_idx,
    list_reduce(list_concat([old], fresh), lambda acc, q:
      CASE WHEN len(list_filter(acc, lambda o: o.label = q[1].label AND greatest(0, least(o.x, q[1].x) + 12 - greatest(o.x, q[1].x)) * greatest(0, least(o.y, q[1].y) + 12 - greatest(o.y, q[1].y)) >= 0.4 * 144)) = 0
        THEN list_append(acc, q[1])
        ELSE list_transform(range(1, len(acc) + 1), lambda k: CASE WHEN k = list_filter(range(1, len(acc) + 1), lambda j: acc[j].label = q[1].label
          AND greatest(0, least(acc[j].x, q[1].x) + 12 - greatest(acc[j].x, q[1].x)) * greatest(0, least(acc[j].y, q[1].y) + 12 - greatest(acc[j].y, q[1].y)) >= 0.4 * 144)[1] THEN q[1] ELSE acc[k] END) END)
  FROM (
    SELECT p.site_id, p.model, p.i, p.frame_idx, p.fresh, list_filter(w.held, lambda o: p.now - o.seen_us <= 43200000000) AS old
    FROM walk w JOIN placed p ON p.site_id = w.site_id AND p.model = w.model AND p.i = w.i + 1
  )
), told AS (SELECT site_id, model, frame_idx, unnest(held) AS n FROM walk WHERE i > 0)
SELECT site_id, model, frame_idx, n.label AS label, round(n.confidence, 6) AS confidence, round(n.x, 6) AS x, round(n.y, 6) AS y, n.w AS w, n.h AS h, n.seen_us AS seen_us FROM told""",
)
def held_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two recognisers, each holding its own."""
    a = assessments(spark, sf_dir)
    f = F.col("frame_idx")
    spot = {"x": F.pmod(F.col("dwell_s"), F.lit(20.0)), "y": F.pmod(f, F.lit(20)).cast("double"), "w": F.lit(12.0), "h": F.lit(12.0)}
    one = a.select("site_id", f.alias("at"), F.floor(f / 50).cast("long").alias("frame_idx"), "t_us", "label", "confidence", *[v.alias(k) for k, v in spot.items()])
    parts = [one.filter(F.col("at") % 3 == 0).withColumn("model", F.lit("aerial")), one.filter(F.col("at") % 3 != 0).withColumn("model", F.lit("rooms"))]
    found = parts[0].unionByName(parts[1]).drop("at")
    held = alerts.held_names(found, Fusion(hold_s=43200.0), chunk_span(a))
    r = [F.round(c, 6).alias(c) for c in ("confidence", "x", "y")]
    return held.select("site_id", "model", "frame_idx", "label", *r, "w", "h", "seen_us")


THERMAL_REGION_SQL = """
, settled AS (SELECT site_id, frame_idx, pos, pos // 8 AS y, pos % 8 AS x, persist, dev FROM persisted WHERE persist >= 2
), reach AS (
  SELECT site_id, frame_idx, pos, pos AS root FROM settled
  UNION
  SELECT b.site_id, b.frame_idx, b.pos, r.root FROM reach r JOIN settled a ON a.site_id = r.site_id AND a.frame_idx = r.frame_idx AND a.pos = r.pos
  JOIN settled b ON b.site_id = a.site_id AND b.frame_idx = a.frame_idx AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1
), labelled AS (SELECT site_id, frame_idx, pos, min(root) AS region FROM reach GROUP BY ALL)"""


@REGISTRY.add(
    "settled_regions",
    "WITH RECURSIVE " + CELLS_SQL + MODEL_SQL + PERSIST_SQL + THERMAL_REGION_SQL + """
SELECT site_id, frame_idx, 'static:' || floor(trunc(avg(y) * 8) / 16)::BIGINT || ':' || floor(trunc(avg(x) * 8) / 16)::BIGINT AS key, count(*) AS cells,
  min(x) * 8 AS x, min(y) * 8 AS y, (max(x) - min(x) + 1) * 8 AS w, (max(y) - min(y) + 1) * 8 AS h,
  round(max(persist) / 25.0, 6)::DOUBLE AS dwell_s, round(max(abs(dev)), 6) AS peak_dev_c, round(avg(dev), 6) AS mean_dev_c
FROM settled JOIN labelled USING (site_id, frame_idx, pos) GROUP BY site_id, frame_idx, region HAVING count(*) <= 20""",
)
def settled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, span = small_reads(spark, sf_dir)
    r = regions.thermal_regions(site.persistence(reads, SMALL, span), SMALL)
    return r.select(
        "site_id", "frame_idx", "key", "cells", "x", "y", "w", "h", *[F.round(c, 6).alias(c) for c in ("dwell_s", "peak_dev_c", "mean_dev_c")]
    )


@REGISTRY.add(
    "optical_regions",
    "WITH RECURSIVE " + CELLS_SQL + OPTICAL_SQL + """
, settled AS (SELECT site_id, frame_idx, pos, pos // 8 AS y, pos % 8 AS x, p, z FROM walk WHERE i > 0 AND p >= 1
), reach AS (
  SELECT site_id, frame_idx, pos, pos AS root FROM settled
  UNION
  SELECT b.site_id, b.frame_idx, b.pos, r.root FROM reach r JOIN settled a ON a.site_id = r.site_id AND a.frame_idx = r.frame_idx AND a.pos = r.pos
  JOIN settled b ON b.site_id = a.site_id AND b.frame_idx = a.frame_idx AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1
), labelled AS (SELECT site_id, frame_idx, pos, min(root) AS region FROM reach GROUP BY ALL
), found AS (
  SELECT site_id, frame_idx, region, count(*) AS cells, min(x) * 32 AS x, min(y) * 32 AS y, (max(x) - min(x) + 1) * 32 AS w, (max(y) - min(y) + 1) * 32 AS h,
         max(p) / 25.0::DOUBLE AS dwell_s, max(z) AS peak_z
  FROM settled JOIN labelled USING (site_id, frame_idx, pos) GROUP BY site_id, frame_idx, region
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY site_id, frame_idx) AS regions_found,
         row_number() OVER (PARTITION BY site_id, frame_idx ORDER BY dwell_s DESC, region) AS rank
  FROM found WHERE cells BETWEEN 1 AND 30 AND cells >= 0.45 * (w * h / 1024.0)
)
SELECT site_id, frame_idx, cells, x, y, w, h, round(dwell_s, 6) AS dwell_s, round(peak_z, 4) AS peak_z, regions_found FROM ranked WHERE rank <= 6""",
)
def optical_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions.optical_regions(small_optical(spark, sf_dir), SMALL_OPTICAL)
    return r.select(
        "site_id", "frame_idx", "cells", "x", "y", "w", "h", F.round("dwell_s", 6).alias("dwell_s"), F.round("peak_z", 4).alias("peak_z"), "regions_found"
    )


@REGISTRY.add(
    "region_names",
    "WITH RECURSIVE " + BOXES_SQL + """
, spot AS (
  SELECT frame_idx % 7 AS site_id, frame_idx // 28 AS tick, frame_idx, det_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, area
  FROM boxes WHERE sensor = 'optical'
), named AS (
  SELECT *, 'optical-static:' || floor(y / 64)::BIGINT || ':' || floor(x / 64)::BIGINT AS key, row_number() OVER (PARTITION BY site_id, tick ORDER BY area DESC, y, x, det_id) AS rank
  FROM spot
), shown AS (SELECT site_id, tick, list({'key': key, 'x': x, 'y': y, 'w': w, 'h': h} ORDER BY rank) AS rs FROM named WHERE rank <= 6 GROUP BY ALL
), placed AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY tick) AS i FROM shown
), walk AS (
  SELECT DISTINCT site_id, 0::BIGINT AS i, -9::BIGINT AS tick, []::STRUCT(key VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS rs,
         []::STRUCT(name VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS held FROM placed
  UNION ALL
  SELECT site_id, i, tick, rs, list_transform(rs, lambda r: {'name': coalesce(list_filter(old, lambda o: r.x < o.x + o.w AND o.x < r.x + r.w AND r.y < o.y + o.h AND o.y < r.y + r.h)[1].name, r.key),
                                                             'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h})
  FROM (SELECT p.site_id, p.i, p.tick, p.rs, CASE WHEN p.tick = w.tick + 1 THEN w.held ELSE [] END AS old FROM walk w JOIN placed p ON p.site_id = w.site_id AND p.i = w.i + 1)
), told AS (SELECT site_id, tick, unnest(range(1, len(rs) + 1)) AS k, rs, held FROM walk WHERE i > 0)
SELECT site_id, tick, rs[k].key AS minted, held[k].name AS key FROM told""",
)
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the six largest boxes of a site in each of its ticks; most ticks follow one another, so most names are inherited."""
    b = boxes(spark, sf_dir).filter(F.col("sensor") == "optical")
    f = F.col("frame_idx")
    spots = b.select(
        (f % 7).alias("site_id"), F.floor(f / 28).cast("long").alias("tick"), "det_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], "area"
    )
    rank = F.row_number().over(Window.partitionBy("site_id", "tick").orderBy(F.desc("area"), "y", "x", "det_id"))
    shown = spots.withColumn("rank", rank).filter("rank <= 6")
    cell = lambda c: F.floor(F.col(c) / 64).cast("long")
    keyed = shown.select("site_id", "tick", F.format_string("optical-static:%d:%d", cell("y"), cell("x")).alias("key"), "x", "y", "w", "h", (10 - F.col("rank")).cast("double").alias("dwell_s"))
    return alerts.region_names(keyed, None)
