"""Queries where both cameras meet, and scoring against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions import classify as C
from perimetra.functions import threat as T
from perimetra.functions.thermal import stretch
from perimetra.operators import blobs, evaluate, fusion
from perimetra.queries import REGISTRY
from perimetra.queries.boxes import IDS, mapped_sql, with_mapped
from perimetra.queries.site import CELLS_SQL, r6
from perimetra.sources.adapters import BOXES_SQL, assessments, assessments_sql, boxes, cell_frames, table

NAMES = ("drone", "chair", "bowl", "person", "bird", "uav")


def thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_mapped(boxes(spark, sf_dir).filter(F.col("sensor") == "thermal"))


def optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optical boxes spread over the larger frame, in optical pixels."""
    o = boxes(spark, sf_dir).filter(F.col("sensor") == "optical")
    c = F.col
    return o.withColumns({"x": c("x") * 2.0 + 30, "y": c("y") * 2.0 + 20, "w": c("w") * 2.0, "h": c("h") * 2.0}).withColumns(
        {"cx": c("x") + c("w") / 2.0, "cy": c("y") + c("h") / 2.0}
    )


SENSORS_SQL = (
    "WITH RECURSIVE " + BOXES_SQL + "," + mapped_sql(where="sensor = 'thermal'") + """
, opt AS (
  SELECT * REPLACE (x * 2.0::DOUBLE + 30 AS x, y * 2.0::DOUBLE + 20 AS y, w * 2.0::DOUBLE AS w, h * 2.0::DOUBLE AS h,
                    x * 2.0::DOUBLE + 30 + w * 2.0::DOUBLE / 2 AS cx, y * 2.0::DOUBLE + 20 + h * 2.0::DOUBLE / 2 AS cy)
  FROM boxes WHERE sensor = 'optical'
)"""
)

MATCH_SQL = """
, turn AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY area DESC, det_id) AS i FROM mapped
), cand AS (
  SELECT t.frame_idx, t.site_id, t.det_id AS t, t.i, o.det_id AS o, o.area AS oa,
         sqrt((t.mx + t.mw / 2 - o.cx) * (t.mx + t.mw / 2 - o.cx) + (t.my + t.mh / 2 - o.cy) * (t.my + t.mh / 2 - o.cy)) AS d
  FROM turn t JOIN opt o ON o.frame_idx = t.frame_idx
  WHERE sqrt((t.mx + t.mw / 2 - o.cx) * (t.mx + t.mw / 2 - o.cx) + (t.my + t.mh / 2 - o.cy) * (t.my + t.mh / 2 - o.cy)) < 28 + greatest(t.mw, t.mh) / 2
), walk AS (
  SELECT DISTINCT frame_idx, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS t, NULL::BIGINT AS o, NULL::DOUBLE AS d FROM cand
  UNION ALL
  SELECT w.frame_idx, n.i, CASE WHEN b.o IS NULL THEN w.used ELSE list_append(w.used, b.o) END, b.t, b.o, b.d
  FROM walk w JOIN turn n ON n.frame_idx = w.frame_idx AND n.i = w.i + 1
  LEFT JOIN LATERAL (
    SELECT arg_min(c.t, (c.d, -c.oa, c.o)) AS t, arg_min(c.o, (c.d, -c.oa, c.o)) AS o, min(c.d) AS d
    FROM cand c WHERE c.frame_idx = w.frame_idx AND c.i = n.i AND NOT list_contains(w.used, c.o)
  ) b ON true
), pairs AS (SELECT frame_idx, t AS thermal_id, o AS optical_id, d FROM walk WHERE o IS NOT NULL)"""


@REGISTRY.add(
    "associate_sensors",
    SENSORS_SQL + MATCH_SQL + " SELECT frame_idx % 10 AS site_id, frame_idx, thermal_id, optical_id, round(d, 4) AS distance FROM pairs",
)
def associate_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fusion.associate(thermal(spark, sf_dir), optical(spark, sf_dir))
    return p.select("site_id", "frame_idx", "thermal_id", "optical_id", F.round("distance", 4).alias("distance"))


@REGISTRY.add(
    "optical_only",
    SENSORS_SQL + MATCH_SQL + """
SELECT site_id, frame_idx, det_id FROM opt o WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.frame_idx = o.frame_idx AND p.optical_id = o.det_id)""",
)
def optical_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = optical(spark, sf_dir)
    return fusion.optical_only(o, fusion.associate(thermal(spark, sf_dir), o)).select(*IDS)


@REGISTRY.add(
    "best_name",
    SENSORS_SQL + """
, named AS (
  SELECT *, ['drone', 'chair', 'bowl', 'person', 'bird', 'uav'][1 + det_id % 6] AS label, 0.05::DOUBLE + discount * 8 AS confidence FROM opt
), covered AS (
  SELECT m.site_id, m.frame_idx, m.det_id, n.label, n.confidence, n.det_id AS name_id,
         greatest(0, least(m.mx + m.mw, n.x + n.w) - greatest(m.mx, n.x)) * greatest(0, least(m.my + m.mh, n.y + n.h) - greatest(m.my, n.y))
           / greatest(1, least(m.mw * m.mh, n.w * n.h)) AS share
  FROM mapped m JOIN named n ON m.frame_idx = n.frame_idx
), best AS (
  SELECT frame_idx, det_id, arg_max(label, (share, confidence, -name_id)) AS name, arg_max(confidence, (share, confidence, -name_id)) AS conf
  FROM covered WHERE share > 0.15 GROUP BY ALL
), tried AS (
  SELECT m.site_id, m.frame_idx, m.det_id, name, conf, name IN ('drone', 'uav') AS craft, name IN ('chair', 'person') AS may,
         CASE WHEN discount > 0.05 THEN 'bird' ELSE 'unknown' END AS label, discount * 9 AS confidence
  FROM mapped m LEFT JOIN best b ON b.frame_idx = m.frame_idx AND b.det_id = m.det_id
), trusted AS (SELECT *, coalesce(conf >= CASE WHEN craft THEN 0.12 ELSE 0.50 END, false) AS ok FROM tried)
SELECT site_id, frame_idx, det_id, name,
  CASE WHEN ok AND craft THEN 'drone' WHEN ok AND may THEN name ELSE label END AS label,
  round(CASE WHEN ok AND craft THEN greatest(conf, confidence) WHEN ok AND may THEN conf ELSE confidence END, 6) AS confidence,
  CASE WHEN ok AND NOT craft AND NOT may THEN name || ' ' || printf('%.2f', conf) END AS guess
FROM trusted""",
)
def best_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    t = thermal(spark, sf_dir)
    names = optical(spark, sf_dir).select(
        "site_id", "frame_idx", c("det_id").alias("name_id"),
        F.element_at(F.array(*[F.lit(n) for n in NAMES]), (1 + c("det_id") % 6).cast("int")).alias("label"),
        (0.05 + c("discount") * 8).alias("confidence"),
        c("x").alias("nx"), c("y").alias("ny"), c("w").alias("nw"), c("h").alias("nh"),
    )
    areas = t.select(*IDS, c("mx").alias("x"), c("my").alias("y"), c("mw").alias("w"), c("mh").alias("h"))
    j = t.join(fusion.best_names(areas, names), list(IDS), "left")
    label = F.when(c("discount") > 0.05, "bird").otherwise("unknown")
    v = C.overruled(label, c("discount") * 9, c("name"), c("name_confidence"))
    return j.select(*IDS, "name", v["label"].alias("label"), F.round(v["confidence"], 6).alias("confidence"), v["optical_guess"].alias("guess"))


@REGISTRY.add(
    "fuse_identity",
    """WITH r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['drone', 'bird', 'unknown'][1 + l_partkey % 3] AS label, l_discount * 9 AS conf,
         ['drone', 'bird', 'unknown'][1 + l_suppkey % 3] AS ol, l_tax * 11 AS oc, 'shape ' || l_linenumber AS why FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN NOT oc > 0 OR ol = label OR ol = 'unknown' THEN label WHEN label = 'unknown' OR oc > conf THEN ol ELSE label END AS label,
  round(CASE WHEN NOT oc > 0 THEN conf WHEN ol = label THEN 1 - (1 - conf) * (1 - oc) WHEN ol = 'unknown' THEN conf WHEN label = 'unknown' THEN oc * 0.8
       WHEN oc > conf THEN oc * 0.5 ELSE conf * 0.5 END, 6) AS confidence,
  CASE WHEN NOT oc > 0 THEN 'thermal only (' || why || ')' WHEN ol = label THEN 'optical agrees: ' || why WHEN ol = 'unknown' THEN 'optical inconclusive: ' || why
       WHEN label = 'unknown' THEN 'optical led: ' || why
       WHEN oc > conf THEN 'SENSORS DISAGREE - thermal said ' || label || ', optical says ' || ol
       ELSE 'SENSORS DISAGREE - optical said ' || ol || ', thermal holds ' || label END AS note
FROM r""",
)
def fuse_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perimetra.sources.adapters import table

    kinds = F.array(F.lit("drone"), F.lit("bird"), F.lit("unknown"))

    def pick(col: str) -> F.Column:
        return F.element_at(kinds, (1 + F.col(col) % 3).cast("int"))

    f = T.fused_identity(
        pick("l_partkey"), F.col("l_discount") * 9, pick("l_suppkey"), F.col("l_tax") * 11, F.concat(F.lit("shape "), F.col("l_linenumber").cast("string"))
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f["label"].alias("label"), F.round(f["confidence"], 6).alias("confidence"), f["note"].alias("note")
    )


REGIONS_SQL = """
, regions AS (
  SELECT *, 'static:' || (cy::BIGINT // 16) || ':' || (cx::BIGINT // 16) || ':' || det_id AS key FROM boxes WHERE sensor = 'optical'
)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(":", F.lit("static"), F.floor(F.rint("cy") / 16).cast("string"), F.floor(F.rint("cx") / 16).cast("string"), F.col("det_id").cast("string"))
    return boxes(spark, sf_dir).filter(F.col("sensor") == "optical").withColumn("key", name)


def touch_sql(pad: int, x: str = "t.x", y: str = "t.y", w: str = "t.w", h: str = "t.h") -> str:
    return (
        f"r.x < {x} + {w} + {pad} AND {x} < r.x + r.w + {pad} AND r.y < {y} + {h} + {pad} AND {y} < r.y + r.h + {pad}"
    )


@REGISTRY.add(
    "unclaimed_static",
    "WITH " + BOXES_SQL + REGIONS_SQL + f"""
SELECT site_id, frame_idx, det_id FROM regions r WHERE NOT EXISTS (
  SELECT 1 FROM boxes t WHERE t.sensor = 'thermal' AND t.frame_idx = r.frame_idx AND {touch_sql(6)})""",
)
def unclaimed_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = boxes(spark, sf_dir).filter(F.col("sensor") == "thermal").withColumnsRenamed({"x": "bx", "y": "by", "w": "bw", "h": "bh"})
    return fusion.unclaimed(regions(spark, sf_dir), live, 6).select(*IDS)


@REGISTRY.add(
    "unclaimed_optical",
    "WITH " + BOXES_SQL + "," + mapped_sql(where="sensor = 'thermal'") + REGIONS_SQL + f"""
SELECT site_id, frame_idx, det_id FROM regions r WHERE NOT EXISTS (
  SELECT 1 FROM mapped t WHERE t.frame_idx = r.frame_idx AND {touch_sql(16, "t.mx", "t.my", "t.mw", "t.mh")})""",
)
def unclaimed_optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = thermal(spark, sf_dir).withColumnsRenamed({"mx": "bx", "my": "by", "mw": "bw", "mh": "bh"})
    return fusion.unclaimed(regions(spark, sf_dir), live, 16).select(*IDS)


def patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Small boxes on the 8x8 stand-in frames, and those frames."""
    frames = cell_frames(spark, sf_dir).select("site_id", "frame_idx", F.col("cells").alias("celsius"))
    c = F.col
    seen = table(spark, sf_dir, "embeddings").count()
    b = boxes(spark, sf_dir).select(
        (c("frame_idx") % seen).alias("frame_idx"), "det_id", (c("frame_idx") * 8 + c("det_id") % 8).alias("row_id"),
        (c("x") % 8).alias("x"), (c("y") % 8).alias("y"), (1.0 + c("w") % 3).alias("w"), (1.0 + c("h") % 3).alias("h"), "discount",
    )
    sites = frames.select("site_id", "frame_idx")
    return b.join(sites, "frame_idx"), frames


PATCH_SQL = """
, patch AS (
  SELECT frame_idx % (SELECT count(*) FROM embeddings) AS frame_idx, det_id, x % 8 AS x, y % 8 AS y, 1 + w % 3 AS w, 1 + h % 3 AS h FROM boxes
), area AS (
  SELECT DISTINCT f.site_id, p.frame_idx, det_id, greatest(0, x - 0)::BIGINT AS x0, greatest(0, y - 0)::BIGINT AS y0, least(8, x + w)::BIGINT AS x1, least(8, y + h)::BIGINT AS y1
  FROM patch p JOIN cell_frames f ON f.frame_idx = p.frame_idx
), px AS (SELECT *, pos // 8 AS py, pos % 8 AS px FROM cells
), measured AS (
  SELECT a.site_id, a.frame_idx, a.det_id, a.x0, a.y0, a.x1, a.y1,
         max(c) FILTER (px >= x0 AND px < x1 AND py >= y0 AND py < y1) AS peak,
         avg(c) FILTER (px >= x0 AND px < x1 AND py >= y0 AND py < y1) AS mean, median(c) AS back
  FROM area a JOIN px q ON q.frame_idx = a.frame_idx AND px >= greatest(0, x0 - 2) AND px < least(8, x1 + 2) AND py >= greatest(0, y0 - 2) AND py < least(8, y1 + 2)
  GROUP BY ALL
)"""


@REGISTRY.add(
    "heat_check",
    "WITH " + BOXES_SQL + "," + CELLS_SQL + PATCH_SQL + """
SELECT site_id, frame_idx, det_id, round(peak, 6) AS peak_c, round(mean - back, 6) AS contrast_c, round(peak - mean, 6) AS hotspot_c,
       mean - back >= 0.4 AS warm, CASE WHEN mean - back >= 0.4 AND peak - mean >= 1.5 THEN 0.85 WHEN mean - back >= 0.4 THEN 0.6 ELSE 0.25 END::DOUBLE AS confidence
FROM measured""",
)
def heat_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perimetra.params import Fusion

    b, frames = patches(spark, sf_dir)
    b = b.select("site_id", "frame_idx", "det_id", "x", "y", "w", "h").distinct()
    h = fusion.heat_checks(b, frames, 8, 8, Fusion(patch_margin_px=0, ring_px=2, warm_c=0.4, hot_core_c=1.5))
    return h.select("site_id", "frame_idx", "det_id", *r6("peak_c", "contrast_c", "hotspot_c"), "warm", "confidence")


@REGISTRY.add(
    "shape_check",
    "WITH " + BOXES_SQL + """
, s AS (SELECT site_id, frame_idx, det_id, area * 3 AS area, w / greatest(h, 1) AS aspect, 0.4::DOUBLE + discount * 5 AS sol FROM boxes
), v AS (
  SELECT *, least(1, (area - 60) / 340.0) AS scale, aspect >= 2.10 OR sol <= 0.52 AS bird, aspect BETWEEN 0.55 AND 1.80 AND sol >= 0.62 AS drone FROM s)
SELECT site_id, frame_idx, det_id, CASE WHEN area < 60 THEN 'unknown' WHEN bird THEN 'bird' WHEN drone THEN 'drone' ELSE 'unknown' END AS label,
  round_even(CASE WHEN area < 60 THEN 0 WHEN bird THEN (0.55 + 0.35 * least(1, CASE WHEN aspect >= 2.10 THEN (aspect - 2.10) / 1.5 ELSE (0.52 - sol) / 0.3 END)) * scale
       WHEN drone THEN (0.55 + 0.35 * least(1, (sol - 0.62) / 0.3)) * scale ELSE 0 END, 3)::DOUBLE AS confidence
FROM v""",
)
def shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    v = T.shape_verdict(c("area") * 3, c("w") / F.greatest(c("h"), F.lit(1.0)), 0.4 + c("discount") * 5)
    b = boxes(spark, sf_dir).select(*IDS, v.alias("v"))
    return b.select(*IDS, "v.label", F.col("v.confidence").alias("confidence"))


@REGISTRY.add(
    "otsu_split",
    "WITH " + CELLS_SQL + """
, lv AS (SELECT site_id, frame_idx, greatest(0, least(255, floor((c - 15) * 25)))::BIGINT AS level FROM cells
), hist AS (SELECT site_id, frame_idx, level, count(*) AS n FROM lv GROUP BY ALL
), cum AS (
  SELECT *, sum(n) OVER u AS n0, sum(n * level) OVER u AS s0, sum(n) OVER a AS nt, sum(n * level) OVER a AS st FROM hist
  WINDOW u AS (PARTITION BY site_id, frame_idx ORDER BY level), a AS (PARTITION BY site_id, frame_idx)
), var AS (SELECT *, CASE WHEN nt > n0 THEN n0 * (nt - n0) * pow(s0 / n0 - (st - s0) / nullif(nt - n0, 0), 2) ELSE 0 END AS b FROM cum
), best AS (SELECT site_id, frame_idx, arg_max(level, (round(b, 6), -level)) AS threshold, arg_max(n0, (round(b, 6), -level)) AS n0, max(nt) AS nt FROM var GROUP BY ALL)
SELECT site_id, frame_idx, threshold, (nt - n0) <= nt / 2.0 AS object_is_brighter, least(n0, nt - n0)::BIGINT AS object_px FROM best""",
)
def otsu_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("c") - 15) * 25))).cast("long")
    px = cell_frames(spark, sf_dir).select("site_id", "frame_idx", F.explode("cells").alias("c")).withColumn("level", level)
    return fusion.otsu(px, ["site_id", "frame_idx"])


@REGISTRY.add(
    "stretch_levels",
    "WITH " + CELLS_SQL + """
, b AS (SELECT site_id, frame_idx, quantile_cont(c, 0.01) AS lo, quantile_cont(c, 0.995) AS hi FROM cells GROUP BY ALL)
SELECT site_id, frame_idx, pos, round(greatest(0, least(255, (c - lo) * (255.0 / greatest(hi - lo, 0.5)))), 4) AS shade
FROM cells JOIN b USING (site_id, frame_idx)""",
)
def stretch_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = cell_frames(spark, sf_dir).select("site_id", "frame_idx", F.posexplode("cells").alias("pos", "c"))
    bounds = px.groupBy("site_id", "frame_idx").agg(F.percentile("c", F.array(F.lit(0.01), F.lit(0.995))).alias("b"))
    j = px.join(bounds, ["site_id", "frame_idx"])
    shade = stretch(F.col("c"), F.col("b")[0], F.col("b")[1])
    return j.select("site_id", "frame_idx", F.col("pos").cast("long").alias("pos"), F.round(shade, 4).alias("shade"))


@REGISTRY.add(
    "threat_static",
    "WITH " + assessments_sql() + """
SELECT site_id, frame_idx, round(least(1, 0.60 + 0.25 * least(1, dwell_s / 30.0) + 0.15 * least(1, abs(10 * threat - 4.9877) / 8.0)), 6) AS threat,
  'object at rest ' || printf('%.0f', dwell_s) || ' s where the learned site is empty | ' || printf('%+.1f', round_even(10 * threat - 4.9877, 1)) || ' C off baseline over 4 cells' AS reasons
FROM assessments WHERE kind = 'static'""",
)
def threat_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = 10 * F.col("threat") - 4.9877
    a = assessments(spark, sf_dir).filter(F.col("kind") == "static")
    return a.select(
        "site_id", "frame_idx", F.round(T.static_threat(F.col("dwell_s"), dev), 6).alias("threat"),
        F.array_join(T.static_reasons(F.col("dwell_s"), dev, F.lit(4)), " | ").alias("reasons"),
    )


@REGISTRY.add(
    "threat_optical",
    "WITH " + assessments_sql() + """
, o AS (SELECT *, label <> 'unknown' AS found, label = 'drone' AS warm, threat * 10 AS hot, least(1, dwell_s / 60.0) AS s FROM assessments WHERE kind = 'optical')
SELECT site_id, frame_idx, round(CASE WHEN warm THEN 0.55 + 0.25 * least(1, hot / 8.0) WHEN found THEN 0.12 + 0.58 * s ELSE 0.20 + 0.45 * s END, 6) AS threat,
  CASE WHEN found AND NOT warm AND s > 0.25 THEN 'cold contact' ELSE 'unverified contact' END AS label,
  CASE WHEN warm THEN 'optical found it first, thermal confirmed heat | seen'
       WHEN found THEN 'optical-only contact, no heat where thermal looked | seen' || CASE WHEN s > 0.15 THEN ' | still in the same place after ' || printf('%.0f', dwell_s) || ' s - clutter usually is not' ELSE '' END
       ELSE 'optical-only contact, outside the thermal field of view | cannot be cross-checked on a fixed mount' END AS reasons
FROM o""",
)
def threat_optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    o = assessments(spark, sf_dir).filter(c("kind") == "optical")
    found, warm = c("label") != "unknown", c("label") == "drone"
    return o.select(
        "site_id", "frame_idx", F.round(T.optical_threat(found, warm, c("threat") * 10, c("dwell_s")), 6).alias("threat"),
        T.optical_label(found, warm, c("dwell_s")).alias("label"),
        F.array_join(T.optical_reasons(found, warm, F.lit("seen"), c("dwell_s")), " | ").alias("reasons"),
    )


@REGISTRY.add(
    "confusion",
    "WITH RECURSIVE " + BOXES_SQL + """
, dets AS (SELECT *, ['drone', 'bird', 'unknown'][1 + det_id % 3] AS label FROM boxes WHERE sensor = 'optical'
), truth AS (
  SELECT site_id, frame_idx, det_id AS truth_id, CASE WHEN quantity > 25 THEN 'drone' ELSE 'bird' END AS kind, cx AS x, cy AS y
  FROM boxes WHERE sensor = 'thermal' AND cx >= 0 AND cx < 256 AND cy >= 0 AND cy < 192
), turn AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY truth_id) AS i FROM truth
), cand AS (
  SELECT t.frame_idx, t.i, t.truth_id, d.det_id, sqrt((t.x - d.cx) * (t.x - d.cx) + (t.y - d.cy) * (t.y - d.cy)) AS d
  FROM turn t JOIN dets d ON d.frame_idx = t.frame_idx WHERE sqrt((t.x - d.cx) * (t.x - d.cx) + (t.y - d.cy) * (t.y - d.cy)) < 60
), walk AS (
  SELECT DISTINCT frame_idx, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS t, NULL::BIGINT AS o FROM cand
  UNION ALL
  SELECT w.frame_idx, n.i, CASE WHEN b.o IS NULL THEN w.used ELSE list_append(w.used, b.o) END, b.t, b.o
  FROM walk w JOIN turn n ON n.frame_idx = w.frame_idx AND n.i = w.i + 1
  LEFT JOIN LATERAL (
    SELECT arg_min(c.truth_id, (c.d, c.det_id)) AS t, arg_min(c.det_id, (c.d, c.det_id)) AS o FROM cand c
    WHERE c.frame_idx = w.frame_idx AND c.i = n.i AND NOT list_contains(w.used, c.det_id)
  ) b ON true
), pairs AS (SELECT frame_idx, t, o FROM walk WHERE o IS NOT NULL
), outcome AS (
  SELECT kind, d.label AS said FROM truth t LEFT JOIN pairs p ON p.frame_idx = t.frame_idx AND p.t = t.truth_id
    LEFT JOIN dets d ON d.frame_idx = p.frame_idx AND d.det_id = p.o
  UNION ALL SELECT NULL, label FROM dets d WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.frame_idx = d.frame_idx AND p.o = d.det_id)
)
SELECT kind, count(*) FILTER (said = 'drone') AS said_drone, count(*) FILTER (said = 'bird') AS said_bird, count(*) FILTER (said = 'unknown') AS said_unknown,
  count(*) FILTER (said IS NULL) AS missed, count(*) AS total, count(*) FILTER (said = kind) AS correct,
  round(CASE WHEN kind IS NOT NULL THEN count(*) FILTER (said = kind) / count(*)::DOUBLE END, 6) AS recall
FROM outcome GROUP BY kind""",
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perimetra.params import Scoring

    c = F.col
    b = boxes(spark, sf_dir)
    kinds = F.array(F.lit("drone"), F.lit("bird"), F.lit("unknown"))
    dets = b.filter(c("sensor") == "optical").withColumn("label", F.element_at(kinds, (1 + c("det_id") % 3).cast("int")))
    truth = b.filter(c("sensor") == "thermal").select(
        "site_id", "frame_idx", c("det_id").alias("truth_id"), F.when(c("quantity") > 25, "drone").otherwise("bird").alias("kind"), c("cx").alias("x"), c("cy").alias("y")
    )
    r = evaluate.confusion(evaluate.outcomes(evaluate.visible(truth), dets, Scoring(match_px=60.0)))
    return r.withColumn("recall", F.round("recall", 6))


@REGISTRY.add(
    "ranked_detections",
    "WITH " + BOXES_SQL + """
SELECT site_id, frame_idx, det_id, row_number() OVER (PARTITION BY site_id, frame_idx ORDER BY area DESC, det_id)::INTEGER AS rank FROM boxes""",
)
def ranked_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.by_area(boxes(spark, sf_dir)).select(*IDS, "rank")


@REGISTRY.add("shape_from_pixels")
def shape_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perimetra.params import Fusion

    b, frames = patches(spark, sf_dir)
    c = F.col
    # Only novel or unnamed objects with some history are worth the look.
    b = b.withColumns(
        {"site_risk": c("discount") * 3.2, "label": F.lit("bird"), "confidence": F.lit(0.5), "hits": (c("det_id") % 100).cast("int")}
    )
    b = fusion.worth_a_look(b).select("site_id", "frame_idx", "det_id", "x", "y", "w", "h").distinct()
    grey = F.transform("celsius", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((v - 15.0) * 25.0))))
    p = Fusion(crop_margin_px=2, min_shape_px=2.0, good_shape_px=8.0)
    return fusion.shape_checks(b, frames.select("site_id", "frame_idx", grey.alias("grey")), 8, 8, p)


@REGISTRY.add(
    "cross_counters",
    SENSORS_SQL + MATCH_SQL + """
, met AS (SELECT frame_idx, count(*) AS n FROM pairs GROUP BY 1
), warm AS (SELECT frame_idx, count(*) AS n FROM opt WHERE discount > 0.05 GROUP BY 1)
SELECT o.site_id, o.frame_idx, count(*) AS optical_candidates, coalesce(max(m.n), 0) AS paired_with_thermal, coalesce(max(w.n), 0) AS optical_only_confirmed_warm,
       count(*) - coalesce(max(m.n), 0) AS optical_only
FROM opt o LEFT JOIN met m ON m.frame_idx = o.frame_idx LEFT JOIN warm w ON w.frame_idx = o.frame_idx GROUP BY o.site_id, o.frame_idx""",
)
def cross_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = optical(spark, sf_dir)
    pairs = fusion.associate(thermal(spark, sf_dir), o)
    return fusion.frame_counters(o, pairs, o.select("site_id", "frame_idx", (F.col("discount") > 0.05).alias("warm")))
