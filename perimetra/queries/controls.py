"""Queries on what operators do and on feedback of alerts into learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import alerts, assess, controls, regions, site, tracks
from perimetra.operators.matching import shared_path
from perimetra.operators.scans import chunk_span
from perimetra.queries import REGISTRY
from perimetra.queries.alerts import HOURS, INTERVALS_SQL, both
from perimetra.queries.site import CELLS_SQL, LEARN_SQL, MODEL_SQL, SMALL, rel_frames, small_reads
from perimetra.queries.tracks import KINEMATICS_SQL, assessed_tracks, base_sql
from perimetra.sources.adapters import track_obs, track_obs_sql
from perimetra.sources.models import ModelStore, cells_of

ACTION_COLUMNS = "site_id long, frame_idx long, t_us long, action string, key string, sensor string, alert_id long, x double, y double, w double, h double, reset boolean"


def _actions(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows with some of the columns of `operator_actions`, completed."""
    return spark.createDataFrame([], ACTION_COLUMNS).unionByName(rows, allowMissingColumns=True)


def scene_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in: operators accept a box every seventh frame and start to learn anew every 31st."""
    frame = rel_frames(spark, sf_dir).select("site_id", "frame_idx", (F.col("frame_idx") * 40_000).alias("t_us"))
    f = F.col("frame_idx")
    box = {"x": F.pmod(f * 5, F.lit(64)), "y": F.pmod(F.col("site_id") * 8, F.lit(64)), "w": F.lit(8), "h": F.lit(8)}
    accepts = frame.filter(f % 7 == 3).withColumns({"action": F.lit("accept"), "sensor": F.lit("thermal"), **{k: v.cast("double") for k, v in box.items()}})
    starts = frame.filter(f % 31 == 20).withColumn("action", F.lit("start_learning"))
    return _actions(spark, accepts.unionByName(starts, allowMissingColumns=True))


def _with_controls(sql: str) -> str:
    """The learning walk with what operators do behind a frame."""
    zeros = "list_transform(range(64), lambda x: 0.0::DOUBLE)"
    steps = [
        ("list_transform(range(64), lambda k: m[k+1] + rate[k+1] * dev[k+1])", "rel[k+1]", zeros),
        ("list_transform(range(64), lambda k: (1 - rate[k+1]) * (va[k+1] + rate[k+1] * dev[k+1] * dev[k+1]))", "greatest(own[k+1], 0.1225)", zeros),
        ("n2", "greatest(own[k+1], 10)", zeros),
        ("list_transform(range(64), lambda k: CASE WHEN anom[k+1] THEN p[k+1] + 1 ELSE greatest(p[k+1] - 3, 0) END)", "0", "list_transform(range(64), lambda x: 0::BIGINT)"),
    ]
    head = "  SELECT site_id, frame_idx, i,\n"
    for step, accepted, none in steps:
        taken = accepted.replace("own[k+1]", f"({step})[k+1]")
        new = f"CASE WHEN wipe THEN {none} ELSE list_transform(range(64), lambda k: CASE WHEN list_contains(spots, k) THEN {taken} ELSE ({step})[k+1] END) END"
        sql = sql.replace(f"         {step},\n", f"         {new},\n")
    marks = (
        "list_transform(cells, lambda c: c - level) AS rel, frame_idx % 31 = 20 AS wipe,\n"
        "         CASE WHEN frame_idx % 7 = 3 THEN list_filter(range(64), lambda k: k // 8 BETWEEN (site_id * 8 % 64) // 8 AND least((site_id * 8 % 64) // 8 + 1, 7)\n"
        "           AND k % 8 BETWEEN (frame_idx * 5 % 64) // 8 AND least((frame_idx * 5 % 64 + 8) // 8, 7)) ELSE [] END AS spots"
    )
    sql = sql.replace("list_transform(cells, lambda c: c - level) AS rel", marks)
    assert head in sql and sql.count("wipe") == 5
    return sql.replace("w.p, o.rel,", "w.p, o.rel, o.wipe, o.spots,")


@REGISTRY.add(
    "operator_actions",
    "WITH RECURSIVE " + CELLS_SQL + _with_controls(LEARN_SQL) + """
SELECT site_id, frame_idx, round(list_max(z), 6) AS top_z, round(list_sum(m), 6) AS mean_sum, list_sum(n)::BIGINT AS taken, list_sum(p)::BIGINT AS persist_sum
FROM walk WHERE i > 0""",
)
def operator_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a site has learned behind each frame while operators accept boxes and start anew."""
    acts = controls.for_thermal(scene_actions(spark, sf_dir), p=SMALL)
    told = site.learn_frames(rel_frames(spark, sf_dir), SMALL, acts, state=True)
    total = lambda c, zero: F.aggregate(c, F.lit(zero), lambda a, v: a + v)
    return told.select(
        "site_id",
        "frame_idx",
        F.round(F.array_max("z"), 6).alias("top_z"),
        F.round(total("ref_mean", 0.0), 6).alias("mean_sum"),
        total("ref_n", 0.0).cast("long").alias("taken"),
        F.aggregate("ref_persist", F.lit(0).cast("long"), lambda a, v: a + v).alias("persist_sum"),
    )


@REGISTRY.add(
    "acknowledged_alerts",
    f"""
WITH alert AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY opened_frame, key) AS alert_id FROM ({INTERVALS_SQL}))
SELECT site_id, key, alert_id, opened_us, closed_us, alert_id % 3 = 0 OR (alert_id % 3 = 1 AND closed_us IS NOT NULL) AS acked FROM alert""",
)
def acknowledged_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third alert is acknowledged as it opens, the next once it has closed, the next too early."""
    a, clock, span = both(spark, sf_dir)
    told = alerts.with_alert_ids(alerts.alert_intervals(a, clock, HOURS, span, None if span is None else alerts.DAY_US), span)
    turn = F.col("alert_id") % 3
    when = F.when(turn == 0, F.col("opened_us")).when(turn == 1, F.col("closed_us")).otherwise(F.col("opened_us") - 1)
    said = told.select("site_id", "alert_id", when.alias("t_us"), F.lit("ack").alias("action")).filter("t_us IS NOT NULL")
    out = alerts.acknowledged(told, controls.acks(_actions(spark, said)))
    return out.select("site_id", "key", F.col("alert_id").cast("long").alias("alert_id"), "opened_us", "closed_us", "acked")


@REGISTRY.add(
    "dwell_after_accept",
    "WITH RECURSIVE " + track_obs_sql(still=True) + "," + KINEMATICS_SQL + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY site_id, track_id ORDER BY frame_idx) AS i FROM kinematics WHERE hits >= 4
), walk AS (
  SELECT site_id, track_id, frame_idx, t_us, i, cx AS ax, cy AS ay, NULL::BIGINT AS since, frame_idx % 11 = 0 AS accepted FROM placed WHERE i = 1
  UNION ALL
  SELECT p.site_id, p.track_id, p.frame_idx, p.t_us, p.i,
    CASE WHEN accepted OR sqrt((p.cx - ax) * (p.cx - ax) + (p.cy - ay) * (p.cy - ay)) > 3 THEN p.cx ELSE ax END,
    CASE WHEN accepted OR sqrt((p.cx - ax) * (p.cx - ax) + (p.cy - ay) * (p.cy - ay)) > 3 THEN p.cy ELSE ay END,
    CASE WHEN accepted OR sqrt((p.cx - ax) * (p.cx - ax) + (p.cy - ay) * (p.cy - ay)) > 3 THEN NULL ELSE coalesce(since, p.t_us) END,
    p.frame_idx % 11 = 0
  FROM walk w JOIN placed p ON p.site_id = w.site_id AND p.track_id = w.track_id AND p.i = w.i + 1
)
SELECT site_id, track_id, frame_idx, round(coalesce(t_us - since, 0) / 1000000.0, 6)::DOUBLE AS dwell_s FROM walk""",
)
def dwell_after_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dwell of tracks that an operator takes for normal every eleventh frame."""
    obs = track_obs(spark, sf_dir, still=True)
    span = chunk_span(obs, keys=tracks.TRACK)
    k = tracks.kinematics(obs, span=span)
    said = k.filter(F.col("frame_idx") % 11 == 0).select(
        "site_id", "frame_idx", "t_us", F.lit("accept").alias("action"), F.format_string("track:%d", "track_id").alias("key")
    )
    d = alerts.dwell(k, span=span, actions=controls.for_dwell(_actions(spark, said)))
    return d.select("site_id", "track_id", "frame_idx", F.round("dwell_s", 6).alias("dwell_s"))


@REGISTRY.add(
    "traffic_feedback",
    base_sql() + """
, placed AS (
  SELECT t.*, least(greatest(floor(trunc(cy) / 8), 0), 23)::BIGINT AS gy, least(greatest(floor(trunc(cx) / 8), 0), 31)::BIGINT AS gx,
         coalesce(a.threat >= 0.6, false) AS alarming
  FROM assessed t LEFT JOIN (SELECT site_id, track_id, frame_idx, threat FROM assessed) a
    ON a.site_id = t.site_id AND a.track_id = t.track_id AND a.frame_idx = t.frame_idx - 1
)
SELECT site_id, gy, gx, count(*) AS seen, count(*) FILTER (NOT alarming) AS activity FROM placed WHERE hits >= 2 AND speed_px >= 0.5 GROUP BY ALL""",
)
def traffic_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second pass of learning: traffic without what the first pass had under alert in the frame before."""
    judged = assessed_tracks(spark, sf_dir)
    alarms = judged.filter(F.col("threat") >= 0.6)
    all_seen = site.alarming_before(judged, alarms)
    every = site.activity_cells(site.traffic(all_seen)).withColumnRenamed("activity", "seen")
    clean = site.activity_cells(site.traffic(all_seen, alerting=F.col("alarming")))
    long = [F.col(c).cast("long").alias(c) for c in ("gy", "gx")]
    return every.join(clean, ["site_id", "gy", "gx"], "left").select("site_id", *long, "seen", F.coalesce("activity", F.lit(0)).alias("activity"))


@REGISTRY.add(
    "model_versions",
    "WITH " + CELLS_SQL + MODEL_SQL + """
, newest AS (SELECT site_id, max(frame_idx) AS frame_idx FROM cell_frames GROUP BY 1
), act AS (SELECT site_id, frame_idx * 5 % 64 AS x, site_id * 8 % 64 AS y FROM cell_frames WHERE frame_idx % 25 = 3
), hit AS (
  SELECT DISTINCT a.site_id, gy * 8 + gx AS pos FROM act a, range(8) r(gy), range(8) s(gx)
  WHERE gy BETWEEN least(y // 8, 7) AND least((y + 8) // 8 + 1, 8) - 1 AND gx BETWEEN least(x // 8, 7) AND least((x + 8) // 8 + 1, 8) - 1
), now AS (SELECT r.site_id, r.pos, r.v FROM newest n JOIN rel r ON r.site_id = n.site_id AND r.frame_idx = n.frame_idx)
SELECT m.site_id, m.pos, 1 AS version, round(ref_mean, 6) AS ref_mean, round(ref_var, 6) AS ref_var, false AS accepted FROM model m
UNION ALL
SELECT m.site_id, m.pos, 2, round(CASE WHEN h.pos IS NULL THEN ref_mean ELSE v END, 6), round(CASE WHEN h.pos IS NULL THEN ref_var ELSE greatest(ref_var, 0.1225) END, 6),
       h.pos IS NOT NULL
FROM model m JOIN now n ON n.site_id = m.site_id AND n.pos = m.pos LEFT JOIN hit h ON h.site_id = m.site_id AND h.pos = m.pos""",
)
def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learned model as saved, and the version after operators accepted some boxes, each read back from the store."""
    frames = rel_frames(spark, sf_dir)
    store = ModelStore(spark, shared_path(spark, "models"))
    f = F.col("frame_idx")
    store.save({"thermal": cells_of(site.fit_site_model(frames, SMALL, chunk_span(frames)), "thermal")}, 1)
    said = frames.filter(f % 25 == 3).select(
        "site_id", "frame_idx", (f * 40_000).alias("t_us"), F.lit("accept").alias("action"), F.lit("thermal").alias("sensor"),
        F.pmod(f * 5, F.lit(64)).cast("double").alias("x"), F.pmod(F.col("site_id") * 8, F.lit(64)).cast("double").alias("y"),
        F.lit(8.0).alias("w"), F.lit(8.0).alias("h"),
    )
    newest = frames.groupBy("site_id").agg(F.max_by("rel", "frame_idx").alias("rel"))
    store.accept(_actions(spark, said), 2, thermal=newest, p=SMALL)
    changed = spark.read.parquet(*[path for path, whole in store.parts("thermal", 2) if not whole]).select("site_id", "pos", F.lit(True).alias("accepted"))
    one, two = store.load("thermal", 1).withColumn("version", F.lit(1)), store.load("thermal", 2).withColumn("version", F.lit(2))
    marked = one.withColumn("accepted", F.lit(False)).unionByName(two.join(changed, ["site_id", "pos"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))))
    return marked.select(
        "site_id", F.col("pos").cast("long").alias("pos"), "version", F.round("ref_mean", 6).alias("ref_mean"), F.round("ref_var", 6).alias("ref_var"), "accepted"
    )


@REGISTRY.add(
    "settled_gate",
    f"""
WITH patch AS ({REGISTRY.sql['settled_regions']}), gate AS (
  SELECT site_id, site_id % 3 <> 0 AS thermal_learned, CASE site_id WHEN 1 THEN NULL ELSE site_id <> 4 END AS optical_learned FROM range(10) t(site_id)
), session AS (SELECT site_id, site_id * 1000000 AS started_us, CASE WHEN site_id <> 5 THEN site_id * 1000000 + 4000000 END AS ended_us FROM range(10) t(site_id))
SELECT p.site_id, p.frame_idx, p.key, p.cells FROM patch p JOIN gate g ON g.site_id = p.site_id AND g.thermal_learned AND coalesce(g.optical_learned, true)
ANTI JOIN session s ON s.site_id = p.site_id AND p.frame_idx * 40000 >= s.started_us AND (s.ended_us IS NULL OR p.frame_idx * 40000 < s.ended_us)""",
)
def settled_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled patches of sites whose models are both learned, outside learning sessions."""
    reads, span = small_reads(spark, sf_dir)
    patches = regions.thermal_regions(site.persistence(reads, SMALL, span), SMALL).withColumn("t_us", F.col("frame_idx") * 40_000)
    s = F.col("site_id")
    every = reads.select("site_id").distinct()
    sites = every.select("site_id", (s % 3 != 0).alias("thermal_learned"), F.when(s != 1, s != 4).alias("optical_learned"))
    start = s * 1_000_000
    runs = every.select("site_id", start.alias("started_us"), F.when(s != 5, start + 4_000_000).alias("ended_us"))
    return assess.settled_ready(patches, sites, runs).select("site_id", "frame_idx", "key", "cells")
