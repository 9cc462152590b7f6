"""Sensor-shaped stand-ins built row by row from the driver's tables.

Every mapping is a projection: no shuffle, no window, so its cost is one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def track_obs(spark: SparkSession, sf_dir: str, still: bool = False) -> DataFrame:
    """``events`` as track observations; ``still`` keeps objects within a few pixels."""
    k = F.get_json_object("props", "$.k").cast("double")
    event = F.col("event_id").cast("double")
    value = F.col("value")
    cx = 100.0 + F.pmod(k, F.lit(4.0)) if still else k * 2.56
    cy = 80.0 + F.pmod(event, F.lit(3.0)) if still else F.pmod(value, F.lit(192.0))
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(10)).cast("long").alias("site_id"),
        F.col("user_id").cast("long").alias("track_id"),
        F.col("event_id").cast("long").alias("frame_idx"),
        micros("ts").alias("t_us"),
        cx.alias("cx"),
        cy.alias("cy"),
        (4.0 + value).alias("area"),
        F.lit(20.0).alias("mean_c"),
        (20.0 + value / 10.0).alias("peak_c"),
        (value / 25.0).alias("contrast_c"),
        (0.6 + F.pmod(k, F.lit(20.0)) / 10.0).alias("aspect"),
        (0.2 + F.pmod(k, F.lit(8.0)) / 10.0).alias("extent"),
        (1 + F.pmod(k, F.lit(4.0))).cast("int").alias("parts"),
        F.col("event_type").alias("event_type"),
    )


TRACK_OBS_SQL = """
track_obs AS (
  SELECT user_id % 10 AS site_id, user_id AS track_id, event_id AS frame_idx, epoch_us(ts) AS t_us,
         {cx} AS cx, {cy} AS cy, 4.0::DOUBLE + value AS area, 20.0::DOUBLE AS mean_c,
         20.0::DOUBLE + value / 10.0::DOUBLE AS peak_c, value / 25.0::DOUBLE AS contrast_c,
         0.6::DOUBLE + (k % 20.0::DOUBLE) / 10.0::DOUBLE AS aspect, 0.2::DOUBLE + (k % 8.0::DOUBLE) / 10.0::DOUBLE AS extent,
         CAST(1 + k % 4.0::DOUBLE AS INTEGER) AS parts, event_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
)"""


def track_obs_sql(still: bool = False) -> str:
    if still:
        return TRACK_OBS_SQL.format(cx="100.0::DOUBLE + k % 4.0::DOUBLE", cy="80.0::DOUBLE + event_id::DOUBLE % 3.0::DOUBLE")
    return TRACK_OBS_SQL.format(cx="k * 2.56::DOUBLE", cy="value % 192.0::DOUBLE")


def cell_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 8x8 frames of cell temperatures, one array per frame."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("site_id"),
        F.col("vec_id").cast("long").alias("frame_idx"),
        F.transform("embedding", lambda v: 20.0 + 10.0 * v.cast("double")).alias("cells"),
    )


CELL_FRAMES_SQL = """
cell_frames AS (
  SELECT label::BIGINT AS site_id, vec_id AS frame_idx,
         list_transform(embedding, lambda v: 20.0::DOUBLE + 10.0::DOUBLE * v::DOUBLE) AS cells
  FROM embeddings
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as boxes of two sensors, one order per frame."""
    w = 4.0 + F.pmod("l_quantity", F.lit(12.0))
    h = 4.0 + 2.0 * F.col("l_linenumber")
    x = F.pmod("l_partkey", F.lit(240)).cast("double")
    y = F.pmod(F.col("l_suppkey") * 7, F.lit(180)).cast("double")
    base = table(spark, sf_dir, "lineitem").select(
        F.pmod("l_orderkey", F.lit(10)).cast("long").alias("site_id"),
        F.col("l_orderkey").cast("long").alias("frame_idx"),
        (F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 10000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("det_id"),
        F.when(F.col("l_returnflag") == "N", "thermal").otherwise("optical").alias("sensor"),
        x.alias("x"),
        y.alias("y"),
        w.alias("w"),
        h.alias("h"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        micros("l_shipdate").alias("t_us"),
    )
    return base.withColumns(
        {
            "cx": F.col("x") + F.col("w") / 2.0,
            "cy": F.col("y") + F.col("h") / 2.0,
            "area": F.col("w") * F.col("h") * (0.1 + F.col("discount") * 8.0),
        }
    )


BOXES_SQL = """
boxes AS (
  SELECT *, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy,
         w * h * (0.1::DOUBLE + discount * 8.0::DOUBLE) AS area
  FROM (SELECT l_orderkey % 10 AS site_id, l_orderkey AS frame_idx,
         l_partkey * 100000000 + l_suppkey * 10000 + l_linenumber * 100 + l_quantity::BIGINT AS det_id,
         CASE WHEN l_returnflag = 'N' THEN 'thermal' ELSE 'optical' END AS sensor,
         (l_partkey % 240)::DOUBLE AS x, ((l_suppkey * 7) % 180)::DOUBLE AS y,
         4.0::DOUBLE + l_quantity % 12.0::DOUBLE AS w, 4.0::DOUBLE + 2.0::DOUBLE * l_linenumber AS h,
         l_discount AS discount, l_tax AS tax, l_quantity AS quantity, l_extendedprice AS price,
         epoch_us(l_shipdate) AS t_us
        FROM lineitem)
)"""


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as per-object verdicts: one row per object and frame."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(10)).cast("long").alias("site_id"),
        F.format_string("track:%d", "user_id").alias("key"),
        F.col("user_id").cast("long").alias("track_id"),
        F.col("event_id").cast("long").alias("frame_idx"),
        micros("ts").alias("t_us"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("threat"),
        F.when(k % 4 == 0, "static").when(k % 4 == 1, "optical").otherwise("track").alias("kind"),
        F.when(k % 3 == 0, "drone").when(k % 3 == 1, "bird").otherwise("unknown").alias("label"),
        (F.lit(1.0) - k / 100.0).alias("confidence"),
        k.cast("double").alias("dwell_s"),
        F.col("event_type"),
    )


def assessments_sql() -> str:
    return """
assessments AS (
  SELECT user_id % 10 AS site_id, 'track:' || user_id AS key, user_id AS track_id, event_id AS frame_idx, epoch_us(ts) AS t_us,
         least(1.0::DOUBLE, value / 100.0::DOUBLE) AS threat,
         CASE k % 4 WHEN 0 THEN 'static' WHEN 1 THEN 'optical' ELSE 'track' END AS kind,
         CASE k % 3 WHEN 0 THEN 'drone' WHEN 1 THEN 'bird' ELSE 'unknown' END AS label,
         1.0::DOUBLE - k / 100.0::DOUBLE AS confidence, k::DOUBLE AS dwell_s, event_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
