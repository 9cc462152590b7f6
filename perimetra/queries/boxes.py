"""Box queries: maps between cameras, matching, grouping, shape filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions import geometry as G
from perimetra.functions.thermal import calibrated_c, celsius, linear_c
from perimetra.operators import blobs, site
from perimetra.params import Detect, Sensor
from perimetra.queries import REGISTRY
from perimetra.queries.site import CELLS_SQL, r6
from perimetra.sources.adapters import BOXES_SQL, boxes, cell_frames, table

# A mild perspective map of the stand-in frames, thermal to optical.
H = (2.1, 0.05, 30.0, -0.03, 2.2, 20.0, 0.0001, 0.0002, 1.0)


def h_col() -> F.Column:
    return F.array(*[F.lit(v) for v in H])


def map_sql(x: str, y: str) -> tuple[str, str]:
    d = f"(0.0001::DOUBLE * ({x}) + 0.0002::DOUBLE * ({y}) + 1.0::DOUBLE)"
    return (
        f"((2.1::DOUBLE * ({x}) + 0.05::DOUBLE * ({y}) + 30.0::DOUBLE) / {d})",
        f"((-0.03::DOUBLE * ({x}) + 2.2::DOUBLE * ({y}) + 20.0::DOUBLE) / {d})",
    )


def mapped_sql(src: str = "boxes", where: str = "true") -> str:
    pts = [map_sql(x, y) for x, y in (("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h"))]
    xs, ys = ", ".join(p[0] for p in pts), ", ".join(p[1] for p in pts)
    return f"""mapped AS (
  SELECT *, round_even(mx0, 0) AS mx, round_even(my0, 0) AS my, round_even(mx1 - mx0, 0) AS mw, round_even(my1 - my0, 0) AS mh
  FROM (SELECT *, least({xs}) AS mx0, greatest({xs}) AS mx1, least({ys}) AS my0, greatest({ys}) AS my1 FROM {src} WHERE {where})
)"""


def with_mapped(df: DataFrame) -> DataFrame:
    return G.with_mapped_box(df, h_col(), G.Box.of())


@REGISTRY.add(
    "calibrate_counts",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
   20.0::DOUBLE + l_tax * 100 AS ambient, 4850.0::DOUBLE + l_extendedprice / 10.0 AS raw FROM lineitem),
u AS (SELECT *, ambient + (raw - 4850.0::DOUBLE) / 31.0::DOUBLE AS lin FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(lin, 6) AS linear_c,
  round(1.0157::DOUBLE * CASE WHEN lin <= 150 THEN -0.00294::DOUBLE * lin * lin + 1.129::DOUBLE * lin + -3.12::DOUBLE ELSE lin - 49.92::DOUBLE END + 3.37::DOUBLE, 6) AS celsius
FROM u""",
)
def calibrate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, ambient = 4850.0 + F.col("l_extendedprice") / 10.0, 20.0 + F.col("l_tax") * 100
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(linear_c(raw, ambient), 6).alias("linear_c"), F.round(celsius(raw, ambient), 6).alias("celsius"),
    )


@REGISTRY.add(
    "calibrate_max",
    """WITH t AS (SELECT l_suppkey, max(4850.0::DOUBLE + l_extendedprice / 10.0) AS raw_max, min(4850.0::DOUBLE + l_extendedprice / 10.0) AS raw_min FROM lineitem GROUP BY 1),
u AS (SELECT *, 25.0::DOUBLE + (raw_max - 4850.0::DOUBLE) / 31.0::DOUBLE AS lin FROM t)
SELECT l_suppkey, round(raw_min, 6) AS raw_min, round(raw_max, 6) AS raw_max,
  round(1.0157::DOUBLE * CASE WHEN lin <= 150 THEN -0.00294::DOUBLE * lin * lin + 1.129::DOUBLE * lin + -3.12::DOUBLE ELSE lin - 49.92::DOUBLE END + 3.37::DOUBLE, 6) AS max_c
FROM u""",
)
def calibrate_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = 4850.0 + F.col("l_extendedprice") / 10.0
    top = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(raw).alias("raw_min"), F.max(raw).alias("raw_max"))
    return top.select("l_suppkey", *r6("raw_min", "raw_max"), F.round(calibrated_c(linear_c(F.col("raw_max"), F.lit(25.0))), 6).alias("max_c"))


IDS = ("site_id", "frame_idx", "det_id")


@REGISTRY.add("map_boxes", "WITH " + BOXES_SQL + "," + mapped_sql() + " SELECT site_id, frame_idx, det_id, mx, my, mw, mh FROM mapped")
def map_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_mapped(boxes(spark, sf_dir)).select(*IDS, "mx", "my", "mw", "mh")


@REGISTRY.add(
    "map_back",
    "WITH " + BOXES_SQL + f"""
SELECT site_id, frame_idx, det_id, round(cx, 4) AS cx, round(cy, 4) AS cy FROM boxes""",
)
def map_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal point to optical and back through the inverse map gives the point again."""
    there = boxes(spark, sf_dir).withColumns(
        {"ox": G.map_x(h_col(), F.col("cx"), F.col("cy")), "oy": G.map_y(h_col(), F.col("cx"), F.col("cy"))}
    )
    inv = G.inverse(h_col())
    return there.select(
        *IDS,
        F.round(G.map_x(inv, F.col("ox"), F.col("oy")), 4).alias("cx"),
        F.round(G.map_y(inv, F.col("ox"), F.col("oy")), 4).alias("cy"),
    )


@REGISTRY.add(
    "turn_boxes",
    "WITH " + BOXES_SQL + """
SELECT site_id, frame_idx, det_id, 192 - y - h AS tx, x AS ty, h AS tw, w AS th, 640 - x - w AS ux, 480 - y - h AS uy FROM boxes""",
)
def turn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.turned_box(G.Box.of(), 256, 192, 3)
    u = G.turned_box(G.Box.of(), 640, 480, 2)
    return boxes(spark, sf_dir).select(
        *IDS, t.x.alias("tx"), t.y.alias("ty"), t.w.alias("tw"), t.h.alias("th"), u.x.alias("ux"), u.y.alias("uy")
    )


PLAUSIBLE = """(w * h > 0 AND w * h <= 0.22 * 256 * 192 AND greatest(w, h) / greatest(least(w, h), 1) <= 6.0 AND area / (w * h) >= 0.14)"""


@REGISTRY.add(
    "plausible_boxes",
    "WITH " + BOXES_SQL + f"""
SELECT site_id, frame_idx, det_id, round(w / greatest(h, 1), 6) AS aspect, round(area / greatest(w * h, 1), 6) AS extent,
       round(least(1, area / greatest(w * h, 1) * 1.15), 6) AS solidity
FROM boxes WHERE {PLAUSIBLE} AND area BETWEEN 12 AND 30000""",
)
def plausible_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = blobs.shape_filter(blobs.sized(boxes(spark, sf_dir), optical=True), 256, 192)
    c = F.col
    return kept.select(
        *IDS,
        F.round(G.aspect(c("w"), c("h")), 6).alias("aspect"),
        F.round(G.extent(c("area"), c("w"), c("h")), 6).alias("extent"),
        F.round(G.merged_solidity(c("area"), c("w"), c("h")), 6).alias("solidity"),
    )


@REGISTRY.add(
    "shape_rejects",
    "WITH " + BOXES_SQL + f" SELECT site_id, count(*) FILTER (NOT {PLAUSIBLE}) AS rejected_shape FROM boxes GROUP BY site_id",
)
def shape_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.shape_filter(boxes(spark, sf_dir), 256, 192)[1]


@REGISTRY.add(
    "noise_floor",
    "WITH " + CELLS_SQL + """
, grain AS (SELECT site_id, frame_idx, 1.4826 * median(abs(v)) AS noise FROM rel WHERE (pos // 8) % 4 = 0 AND (pos % 8) % 4 = 0 GROUP BY ALL)
SELECT site_id, frame_idx, round(noise, 6) AS noise, round(greatest(18.0, 6.0 * noise), 6) AS threshold FROM grain""",
)
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cell_frames(spark, sf_dir).withColumn("noise", blobs.noise_floor(site.relative(F.col("cells")), 8, 8))
    return f.select("site_id", "frame_idx", *r6("noise"), F.round(blobs.effective_threshold(F.col("noise")), 6).alias("threshold"))


def _outline_sql(hot: str, clean: bool, inside: str = "true") -> str:
    """Blobs of 8x8 frames with what they enclose: flood from outside, components, areas from squares of four pixels."""
    near = "n.site_id = g.site_id AND n.frame_idx = g.frame_idx"
    steps, name = [f", grid AS (SELECT site_id, frame_idx, pos // 8 AS y, pos % 8 AS x, c, v, {hot} AS s0 FROM rel WHERE {inside})"], "s0"
    if clean:  # opening by 3x3, closing by 5x5; what lies outside does not count
        for k, (reach, spread) in enumerate(((1, False), (1, True), (2, True), (2, False)), 1):
            steps.append(
                f", grid{k} AS (SELECT g.site_id, g.frame_idx, g.y, g.x, any_value(g.c) AS c, any_value(g.v) AS v, {'bool_or' if spread else 'bool_and'}(n.s{k - 1}) AS s{k}"
                f" FROM grid{k - 1 or ''} g JOIN grid{k - 1 or ''} n ON {near} AND abs(n.y - g.y) <= {reach} AND abs(n.x - g.x) <= {reach} GROUP BY g.site_id, g.frame_idx, g.y, g.x)"
            )
        name = "s4"
    last = "grid4" if clean else "grid"
    return "".join(steps) + f"""
, frame AS (SELECT DISTINCT site_id, frame_idx FROM {last}
), padded AS (
  SELECT f.site_id, f.frame_idx, a.y, b.x, coalesce(g.{name}, false) AS lit FROM frame f, range(-1, 9) a(y), range(-1, 9) b(x)
  LEFT JOIN {last} g ON g.site_id = f.site_id AND g.frame_idx = f.frame_idx AND g.y = a.y AND g.x = b.x
), outside AS (
  SELECT site_id, frame_idx, -1::BIGINT AS y, -1::BIGINT AS x FROM frame
  UNION
  SELECT p.site_id, p.frame_idx, p.y, p.x FROM outside o JOIN padded p
    ON p.site_id = o.site_id AND p.frame_idx = o.frame_idx AND abs(p.y - o.y) + abs(p.x - o.x) = 1 AND NOT p.lit
), full_ AS (
  SELECT g.site_id, g.frame_idx, g.y, g.x, g.y * 8 + g.x AS pos, g.c, g.v FROM {last} g
  ANTI JOIN outside o ON o.site_id = g.site_id AND o.frame_idx = g.frame_idx AND o.y = g.y AND o.x = g.x
), reach AS (
  SELECT site_id, frame_idx, pos, pos AS root FROM full_
  UNION
  SELECT b.site_id, b.frame_idx, b.pos, r.root FROM reach r JOIN full_ a ON a.site_id = r.site_id AND a.frame_idx = r.frame_idx AND a.pos = r.pos
  JOIN full_ b ON b.site_id = a.site_id AND b.frame_idx = a.frame_idx AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1
), labelled AS (SELECT site_id, frame_idx, pos, min(root) AS blob FROM reach GROUP BY ALL
), owned AS (SELECT f.*, l.blob FROM full_ f JOIN labelled l USING (site_id, frame_idx, pos)
), quad AS (
  SELECT o.site_id, o.frame_idx, min(o.blob) AS blob, count(*) AS n, avg(o.x) AS mx, avg(o.y) AS my
  FROM owned o, range(-1, 1) a(dy), range(-1, 1) b(dx) GROUP BY o.site_id, o.frame_idx, o.y + dy, o.x + dx HAVING count(*) >= 3
), outline AS (
  SELECT site_id, frame_idx, blob, sum(CASE n WHEN 4 THEN 1 ELSE 0.5 END)::DOUBLE AS area, sum(CASE n WHEN 4 THEN mx ELSE mx / 2 END) AS sx,
         sum(CASE n WHEN 4 THEN my ELSE my / 2 END) AS sy FROM quad GROUP BY ALL
), blob AS (
  SELECT site_id, frame_idx, blob, min(x)::DOUBLE AS x, min(y)::DOUBLE AS y, (max(x) - min(x) + 1)::DOUBLE AS w, (max(y) - min(y) + 1)::DOUBLE AS h,
         max(c) AS peak, avg(c) AS mean, avg(v) AS signed, avg(abs(v)) AS off FROM owned GROUP BY ALL
)"""


_BLOB_COLUMNS = """
SELECT b.site_id, b.frame_idx, b.blob::INTEGER AS blob, x, y, w, h, round(coalesce(sx / area, x + w / 2), 6) AS cx, round(coalesce(sy / area, y + h / 2), 6) AS cy,
  CASE WHEN area >= 1 THEN area END AS area, round(peak, 6) AS peak, round(mean, 6) AS mean, round({contrast}, 6) AS contrast, signed < 0 AS darker
FROM blob b LEFT JOIN outline o ON o.site_id = b.site_id AND o.frame_idx = b.frame_idx AND o.blob = b.blob"""


def _still(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their own level for a background."""
    f = cell_frames(spark, sf_dir).select("site_id", "frame_idx", F.col("cells").alias("values"))
    return f.withColumn("background", F.zip_with("values", site.relative(F.col("values")), lambda v, r: v - r))


def _told(b: DataFrame) -> DataFrame:
    """Thin blobs, whose area is a count of corners, go without it."""
    area = F.when(~F.col("thin"), F.col("area"))
    return b.select("site_id", "frame_idx", "blob", "x", "y", "w", "h", *r6("cx", "cy"), area.alias("area"), *r6("peak", "mean", "contrast"), "darker")


@REGISTRY.add("blob_features", "WITH RECURSIVE " + CELLS_SQL + _outline_sql("v > 0.4", False) + _BLOB_COLUMNS.format(contrast="signed"))
def blob_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(blobs.detect_frozen(_still(spark, sf_dir), 8, 8, threshold=0.4, clean=False))


@REGISTRY.add("motion_blobs", "WITH RECURSIVE " + CELLS_SQL + _outline_sql("v > -1.0", True) + _BLOB_COLUMNS.format(contrast="signed"))
def motion_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal blobs of a mask that was opened and closed."""
    return _told(blobs.detect_frozen(_still(spark, sf_dir), 8, 8, threshold=-1.0))


@REGISTRY.add(
    "optical_motion",
    "WITH RECURSIVE " + CELLS_SQL + _outline_sql("abs(v) > 0.3", True, "pos // 8 BETWEEN 1 AND 6 AND pos % 8 BETWEEN site_id % 2 AND 7") + _BLOB_COLUMNS.format(contrast="off"),
)
def optical_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optical blobs, warmer or colder, inside what the thermal sensor can see of the optical frame."""
    small = Sensor(rows=4, cols=4, optical_rows=8, optical_cols=8)
    still = _still(spark, sf_dir)
    one = F.lit(1.0)
    ahead = (F.col("site_id") % 2).cast("double")
    h = F.array(F.lit(2.0), F.lit(0.0), ahead, F.lit(0.0), F.lit(1.5), one, F.lit(0.0), F.lit(0.0), one)
    maps = still.select("site_id").distinct().withColumn("h", h)
    seen = blobs.within_footprint(still, maps, small, Detect(roi_pad_px=0))
    return _told(blobs.detect_frozen(seen, 8, 8, threshold=0.3, absolute=True))


@REGISTRY.add(
    "merge_blobs",
    "WITH RECURSIVE " + BOXES_SQL + """
, ids AS (SELECT *, 20 + quantity / 10.0::DOUBLE AS mean_c, 22 + quantity / 5.0::DOUBLE AS peak_c, discount * 40 AS contrast_c FROM boxes WHERE sensor = 'thermal'
), linked AS (
  SELECT a.frame_idx, a.det_id AS a, b.det_id AS b FROM ids a JOIN ids b ON a.frame_idx = b.frame_idx
  WHERE greatest(b.x - (a.x + a.w), a.x - (b.x + b.w), 0) <= 6 AND greatest(b.y - (a.y + a.h), a.y - (b.y + b.h), 0) <= 6
), reach AS (
  SELECT frame_idx, a, b FROM linked
  UNION
  SELECT r.frame_idx, r.a, l.b FROM reach r JOIN linked l ON l.frame_idx = r.frame_idx AND l.a = r.b
), grouped AS (SELECT frame_idx, a AS det_id, min(b) AS "group" FROM reach GROUP BY ALL)
SELECT i.site_id, i.frame_idx, "group", min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, round(sum(area), 4) AS area,
  round(sum(cx * area) / sum(area), 4) AS cx, round(sum(cy * area) / sum(area), 4) AS cy, max(peak_c) AS peak_c,
  round(sum(mean_c * area) / sum(area), 4) AS mean_c, round(sum(contrast_c * area) / sum(area), 4) AS contrast_c, count(*) AS parts
FROM ids i JOIN grouped g ON g.frame_idx = i.frame_idx AND g.det_id = i.det_id GROUP BY i.site_id, i.frame_idx, "group" """,
)
def merge_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = boxes(spark, sf_dir).filter(F.col("sensor") == "thermal").select(
        *IDS, "x", "y", "w", "h", "cx", "cy", "area",
        (22.0 + F.col("quantity") / 5.0).alias("peak_c"), (20.0 + F.col("quantity") / 10.0).alias("mean_c"),
        (F.col("discount") * 40).alias("contrast_c"), F.lit(1).cast("long").alias("parts"),
    )
    m = blobs.merged(parts)
    r4 = [F.round(c, 4).alias(c) for c in ("area", "cx", "cy", "mean_c", "contrast_c")]
    return m.select("site_id", "frame_idx", "group", "x", "y", "w", "h", "peak_c", "parts", *r4)


@REGISTRY.add("merge_fragments")
def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = boxes(spark, sf_dir).filter(F.col("sensor") == "optical").select(*IDS, "x", "y", "w", "h", "cx", "cy", "area")
    return blobs.merged_fragments(parts, 256, 192)
