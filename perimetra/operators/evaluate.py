"""Scoring against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.functions.geometry import map_x, map_y
from perimetra.operators.matching import greedy_pairs
from perimetra.params import SCORING, SENSOR, Scoring, Sensor

FRAME = ["site_id", "frame_idx"]


def projected(targets: DataFrame, maps: DataFrame) -> DataFrame:
    """World positions ``(site_id, .., x, y)`` to thermal pixels through each site's map ``h``."""
    j = targets.withColumnsRenamed({"x": "_wx", "y": "_wy"}).join(maps.select("site_id", "h"), "site_id")
    h, x, y = F.col("h"), F.col("_wx"), F.col("_wy")
    return j.withColumns({"x": map_x(h, x, y), "y": map_y(h, x, y)}).drop("h", "_wx", "_wy")


def visible(truth: DataFrame, s: Sensor = SENSOR) -> DataFrame:
    """Targets inside the thermal frame."""
    return truth.filter((F.col("x") >= 0) & (F.col("x") < s.cols) & (F.col("y") >= 0) & (F.col("y") < s.rows))


def matched(truth: DataFrame, dets: DataFrame, p: Scoring = SCORING) -> DataFrame:
    """Each target takes the nearest free detection: columns ``truth_id, det_id, distance``."""
    left = truth.select(
        *FRAME, F.col("truth_id").alias("l_id"), F.col("truth_id").alias("l_ord"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.lit(p.match_px).alias("radius")
    )
    right = dets.select(
        *FRAME, F.col("det_id").alias("r_id"), F.col("det_id").alias("r_ord"), F.col("cx").alias("rx"), F.col("cy").alias("ry")
    )
    return greedy_pairs(left, right).withColumnsRenamed({"l_id": "truth_id", "r_id": "det_id"})


def outcomes(truth: DataFrame, dets: DataFrame, p: Scoring = SCORING) -> DataFrame:
    """One row per target and per spurious detection: ``kind`` (NULL if spurious), ``said`` (NULL if missed)."""
    pairs = matched(truth, dets, p)
    of_truth = truth.join(pairs.select(*FRAME, "truth_id", "det_id"), [*FRAME, "truth_id"], "left").join(
        dets.select(*FRAME, "det_id", F.col("label").alias("said")), [*FRAME, "det_id"], "left"
    )
    spurious = dets.join(pairs.select(*FRAME, "det_id"), [*FRAME, "det_id"], "left_anti")
    return of_truth.select("site_id", "kind", F.when(F.col("det_id").isNotNull(), F.col("said")).alias("said")).unionByName(
        spurious.select("site_id", F.lit(None).cast("string").alias("kind"), F.col("label").alias("said"))
    )


def confusion(results: DataFrame) -> DataFrame:
    """Per true class: counts by answer, missed, recall. The NULL row counts spurious detections."""
    c = F.col
    by = results.groupBy("kind").agg(
        F.count_if(c("said") == "drone").alias("said_drone"),
        F.count_if(c("said") == "bird").alias("said_bird"),
        F.count_if(c("said") == "unknown").alias("said_unknown"),
        F.count_if(c("said").isNull()).alias("missed"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(c("said") == c("kind")).alias("correct"),
    )
    return by.withColumn("recall", F.when(c("kind").isNotNull(), c("correct") / c("total")))
