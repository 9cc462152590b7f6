"""Stored camera frames: array files of raw counts to rows of counts and metadata."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perimetra.functions.thermal import celsius_frame
from perimetra.operators.matching import settled
from perimetra.params import CALIBRATION, SENSOR, Calibration, Sensor

FRAME_DDL = "path string, site_id string, ambient_c double, rows int, cols int, counts array<int>"


def _decoded(files: DataFrame, s: Sensor, c: Calibration) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws = [np.load(io.BytesIO(b), allow_pickle=False) for b in batch["content"]]
            meta = [r[s.rows] for r in raws]
            yield pd.DataFrame(
                {
                    "path": batch["path"], "site_id": batch["site_id"],
                    "ambient_c": [float(m[0]) / c.ambient_scale for m in meta],
                    "rows": [int(m[8]) for m in meta], "cols": [int(m[9]) for m in meta],
                    "counts": [r[: s.rows, : s.cols].astype(np.int32).ravel() for r in raws],
                }
            )

    return files.mapInPandas(decode, FRAME_DDL)


def _files(reader, path: str) -> DataFrame:
    """Array files; the folder a file lies in is its site."""
    raw = reader.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return raw.withColumn("site_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def read_frames(spark: SparkSession, path: str, s: Sensor = SENSOR, c: Calibration = CALIBRATION) -> DataFrame:
    """All stored frames, numbered per site in file-name order."""
    files = _files(spark.read, path)
    return _decoded(files.select("path", "site_id", "content"), s, c).join(file_numbers(files.select("path", "site_id")), ["site_id", "path"])


def stream_frames(spark: SparkSession, path: str, per_trigger: int = 1000, s: Sensor = SENSOR, c: Calibration = CALIBRATION) -> DataFrame:
    """Frames as they are dropped into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = (
        spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", per_trigger).load(path)
    )
    files = raw.withColumn("site_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return _decoded(files.select("path", "site_id", "content"), s, c)


def file_numbers(files: DataFrame) -> DataFrame:
    """Position of each file in its site by name, from 0.

    Files are range-sorted over the cluster; each range counts its own and adds what the
    ranges before it hold, so no task sees a whole site.
    """
    ranged = files.select("site_id", "path").repartitionByRange("site_id", "path").withColumn("_range", F.spark_partition_id())
    ranged = settled(ranged)
    inside = Window.partitionBy("site_id", "_range").orderBy("path")
    before = Window.partitionBy("site_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("site_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("site_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    placed = ranged.withColumn("_i", F.row_number().over(inside)).join(offsets, ["site_id", "_range"])
    return placed.select("site_id", "path", (F.col("_ahead") + F.col("_i") - 1).alias("frame_idx"))


def calibrated(frames: DataFrame, s: Sensor = SENSOR, c: Calibration = CALIBRATION) -> DataFrame:
    """Counts to degrees for whole frames."""
    return frames.withColumn("celsius", celsius_frame(F.col("counts"), F.col("ambient_c"), s.rows * s.cols, c)).drop("counts")
