"""Track queries: features, classification, identity threat and alert runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions import threat as T
from perimetra.operators import tracks
from perimetra.operators.scans import chunk_span
from perimetra.params import Alerting, Fusion
from perimetra.queries import REGISTRY
from perimetra.sources.adapters import assessments, assessments_sql, track_obs, track_obs_sql

KINEMATICS_SQL = """
steps AS (
  SELECT *, sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) AS step,
         frame_idx - lag(frame_idx) OVER w - 1 AS gap
  FROM track_obs WINDOW w AS (PARTITION BY site_id, track_id ORDER BY frame_idx)
), windowed AS (
  SELECT *, count(*) OVER p AS n, first_value(cx) OVER p AS x0, first_value(cy) OVER p AS y0,
         coalesce(sum(step) OVER s, 0) AS path, count(step) OVER s AS n_steps,
         avg(area) OVER p AS mean_area, stddev_pop(area) OVER p AS sd_area,
         row_number() OVER (PARTITION BY site_id, track_id ORDER BY frame_idx) AS hits
  FROM steps
  WINDOW p AS (PARTITION BY site_id, track_id ORDER BY frame_idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW),
         s AS (PARTITION BY site_id, track_id ORDER BY frame_idx ROWS BETWEEN 38 PRECEDING AND CURRENT ROW)
), kinematics AS (
  SELECT *, CASE WHEN n_steps > 0 THEN path / n_steps ELSE 0 END AS speed_px,
         CASE WHEN n < 3 OR path < 1e-6 THEN 0 ELSE sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0)) / path END AS straightness,
         CASE WHEN n < 2 THEN 0 ELSE sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0)) END AS displacement_px,
         CASE WHEN n < 8 OR mean_area <= 0 THEN 0 ELSE sd_area / mean_area END AS flap_score,
         coalesce(gap, 0) AS missed
  FROM windowed
)"""

CLASSIFIED_SQL = """
judged AS (
  SELECT *, peak_c - mean_c AS hot,
         ((peak_c - mean_c >= 6.0 OR abs(contrast_c) >= 3.0) AND parts >= 2
           AND CASE WHEN aspect < 1 THEN 1 / greatest(aspect, 1e-6) ELSE aspect END <= 2.6 AND extent >= 0.25) AS landed
  FROM kinematics
), ruled AS (
  SELECT *, CASE WHEN hits >= 8 AND displacement_px < 8 AND NOT landed
                 THEN 'has not moved - ' || printf('%.1f', displacement_px) || ' px of net travel over its whole history'
                 WHEN area > 2000 THEN 'far too large for an airframe at watch range (' || floor(area)::BIGINT || ' px)' END AS not_airborne,
         greatest(0, least(1, (flap_score - 0.15) / 0.15)) AS wing,
         greatest(0, least(1, (hot - 2.0) / 4.0)) AS core
  FROM judged
), voted AS (
  SELECT *, 0.45 * (1 - wing) + 0.30 * core
            + CASE WHEN area >= 25 AND aspect BETWEEN 0.6 AND 1.8 AND extent > 0.4 THEN 0.15 ELSE 0 END
            + CASE WHEN parts >= 3 THEN 0.075 ELSE 0 END
            + CASE WHEN straightness >= 0.9 THEN 0.10 ELSE 0 END AS drone,
         0.45 * wing + 0.30 * (1 - core) + CASE WHEN area >= 25 AND aspect > 2.0 THEN 0.15 ELSE 0 END
            + CASE WHEN straightness >= 0.9 THEN 0 ELSE 0.10 * least(1, (0.9 - straightness) / 0.9) END AS bird
  FROM ruled
), classified AS (
  SELECT *,
    CASE WHEN hits < 8 OR not_airborne IS NOT NULL THEN 'unknown'
         WHEN displacement_px < 8 AND landed THEN 'drone'
         WHEN greatest(drone, bird) / (drone + bird) >= 0.58 THEN CASE WHEN drone >= bird THEN 'drone' ELSE 'bird' END
         ELSE 'unknown' END AS label,
    CASE WHEN hits < 8 OR not_airborne IS NOT NULL THEN 0.0
         WHEN displacement_px < 8 AND landed THEN least(0.95, 0.62 + 0.06 * parts)
         ELSE greatest(drone, bird) / (drone + bird) END::DOUBLE AS confidence
  FROM voted
)"""

THREAT_SQL = """
assessed AS (
  SELECT *, CASE label WHEN 'drone' THEN confidence WHEN 'bird' THEN 0.0 ELSE 0.15 END::DOUBLE AS threat,
         'track:' || track_id AS key
  FROM classified
)"""


def base_sql(still: bool = False) -> str:
    return "WITH " + ",".join([track_obs_sql(still), KINEMATICS_SQL, CLASSIFIED_SQL, THREAT_SQL])


@REGISTRY.add(
    "track_kinematics",
    "WITH " + track_obs_sql() + "," + KINEMATICS_SQL + """
SELECT site_id, track_id, frame_idx, hits, missed, round(speed_px, 6) AS speed_px, round(straightness, 6) AS straightness,
       round(displacement_px, 6) AS displacement_px, round(flap_score, 6) AS flap_score
FROM kinematics""",
)
def track_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = track_obs(spark, sf_dir)
    k = tracks.kinematics(obs, span=chunk_span(obs, keys=tracks.TRACK))
    return k.select(
        "site_id",
        "track_id",
        "frame_idx",
        "hits",
        "missed",
        *[F.round(c, 6).alias(c) for c in ("speed_px", "straightness", "displacement_px", "flap_score")],
    )


@REGISTRY.add(
    "classify_tracks",
    base_sql(still=True) + """
SELECT site_id, track_id, frame_idx, label, round(confidence, 6) AS confidence, not_airborne FROM classified""",
)
def classify_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = track_obs(spark, sf_dir, still=True)
    c = tracks.classified(tracks.kinematics(obs, span=chunk_span(obs, keys=tracks.TRACK)))
    return c.select("site_id", "track_id", "frame_idx", "label", F.round("confidence", 6).alias("confidence"), "not_airborne")


def assessed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = track_obs(spark, sf_dir)
    c = tracks.classified(tracks.kinematics(obs, span=chunk_span(obs, keys=tracks.TRACK)))
    risk = T.identity_risk(F.col("label"), F.col("confidence"))
    return c.withColumns({"threat": risk, "key": F.format_string("track:%d", "track_id")})


@REGISTRY.add(
    "threat_tracks",
    base_sql() + """
SELECT site_id, track_id, frame_idx, label, round(threat, 6) AS threat,
       CASE WHEN threat >= 0.75 THEN 'alert' WHEN threat >= 0.45 THEN 'watch' ELSE 'nominal' END AS level,
       concat_ws(' | ', CASE WHEN label = 'drone' AND confidence > 0.5 THEN 'classified drone (' || printf('%.2f', confidence) || ')'
                      WHEN label = 'unknown' THEN 'unclassified mover' END, not_airborne) AS reasons
FROM assessed""",
)
def threat_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    a = assessed_tracks(spark, sf_dir)
    why = T.track_reasons(
        F.col("label"), F.col("confidence"), none.cast("string"), none.cast("array<string>"), none.cast("string"),
        none.cast("array<string>"), F.col("not_airborne"),
    )
    return a.select(
        "site_id", "track_id", "frame_idx", "label", F.round("threat", 6).alias("threat"),
        T.level(F.col("threat")).alias("level"), F.array_join(why, " | ").alias("reasons"),
    )


@REGISTRY.add(
    "alert_opens",
    "WITH " + assessments_sql() + """
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY frame_idx) AS i FROM assessments
), runs AS (
  SELECT *, i - coalesce(max(CASE WHEN threat < 0.5 THEN i END) OVER (PARTITION BY site_id, key ORDER BY frame_idx), 0) AS streak
  FROM numbered
)
SELECT site_id, key, frame_idx, t_us, label, round(threat, 6) AS threat, streak FROM runs WHERE streak = 3""",
)
def alert_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessments(spark, sf_dir)
    runs = tracks.alert_opens(rows, Alerting(open_after=3, threshold=0.5), span=chunk_span(rows))
    return runs.filter("opens").select(
        "site_id", "key", "frame_idx", "t_us", "label", F.round("threat", 6).alias("threat"), "streak"
    )


@REGISTRY.add(
    "contact_sessions",
    "WITH " + assessments_sql() + """
, marked AS (
  SELECT *, CASE WHEN t_us - lag(t_us) OVER w <= 21600000000 THEN NULL ELSE t_us END AS opened
  FROM assessments WINDOW w AS (PARTITION BY site_id, key ORDER BY frame_idx)
), since AS (
  SELECT *, max(opened) OVER (PARTITION BY site_id, key ORDER BY frame_idx) AS started FROM marked
)
SELECT site_id, key, frame_idx, round((t_us - started) / 1000000.0, 6)::DOUBLE AS dwell_s FROM since""",
)
def contact_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessments(spark, sf_dir)
    c = tracks.contact_dwell(rows, Fusion(contact_gap_s=21600.0), span=chunk_span(rows))
    return c.select("site_id", "key", "frame_idx", F.round("dwell_s", 6).alias("dwell_s"))


@REGISTRY.add(
    "rolling_cost",
    "WITH " + assessments_sql() + """
SELECT site_id, key, frame_idx,
       sum(round(threat * 1000000)::BIGINT) OVER w::DOUBLE / count(threat) OVER w / 1e6 AS mean30
FROM assessments WINDOW w AS (PARTITION BY site_id, key ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def rolling_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessments(spark, sf_dir)
    r = tracks.rolling_mean(rows, ["site_id", "key"], "frame_idx", "threat", "mean30", span=chunk_span(rows))
    return r.select("site_id", "key", "frame_idx", "mean30")


@REGISTRY.add(
    "sampled_frames",
    "WITH " + assessments_sql() + """
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY frame_idx) AS i FROM assessments
)
SELECT site_id, key, frame_idx,
       round(last_value(CASE WHEN (i - 1) % 3 = 0 THEN threat END IGNORE NULLS)
             OVER (PARTITION BY site_id, key ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS held
FROM numbered""",
)
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessments(spark, sf_dir)
    h = tracks.carried_forward(rows, ["site_id", "key"], "frame_idx", 3, "threat", "held", span=chunk_span(rows))
    return h.select("site_id", "key", "frame_idx", F.round("held", 6).alias("held"))
