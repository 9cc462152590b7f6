"""Patches of scene that stayed wrong long enough to be objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimetra.functions.geometry import place_key
from perimetra.operators.blobs import label_mask
from perimetra.params import OPTICAL_SITE, THERMAL_SITE, OpticalSite, ThermalSite


def components(settled: DataFrame, rows: int, cols: int) -> DataFrame:
    """Label 8-connected cells ``(site_id, frame_idx, pos, ..)`` of each frame; a frame holds at most one grid."""
    rest = [c for c in settled.columns if c not in ("site_id", "frame_idx")]

    @F.pandas_udf("array<int>")
    def label(positions: pd.Series) -> pd.Series:
        out = []
        for pos in positions:
            mask = np.zeros(rows * cols, bool)
            mask[pos] = True
            out.append(label_mask(mask.reshape(rows, cols)).ravel()[pos])
        return pd.Series(out)

    frames = settled.groupBy("site_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("_c"))
    named = frames.withColumn("_l", label(F.col("_c.pos")))
    return named.select("site_id", "frame_idx", F.explode(F.arrays_zip("_c", "_l")).alias("z")).select(
        "site_id", "frame_idx", "z._c.*", F.col("z._l").alias("region")
    )


def _outline(cells: DataFrame, cols: int, size: int, aggs: list[Column]) -> DataFrame:
    gy, gx = F.floor(F.col("pos") / F.lit(cols)).cast("long"), (F.col("pos") % cols).cast("long")
    c = cells.withColumns({"_gy": gy, "_gx": gx})
    return c.groupBy("site_id", "frame_idx", "region").agg(
        F.count(F.lit(1)).alias("cells"),
        (F.min("_gx") * size).alias("x"), (F.min("_gy") * size).alias("y"),
        ((F.max("_gx") - F.min("_gx") + 1) * size).alias("w"), ((F.max("_gy") - F.min("_gy") + 1) * size).alias("h"),
        (F.avg("_gx") * size).alias("cx"), (F.avg("_gy") * size).alias("cy"), *aggs,
    )


def thermal_regions(persisted: DataFrame, p: ThermalSite = THERMAL_SITE) -> DataFrame:
    """Settled thermal patches from ``persisted(site_id, frame_idx, pos, persist, dev)``."""
    settled = persisted.filter(F.col("persist") >= p.persist_frames).select("site_id", "frame_idx", "pos", "persist", "dev")
    out = _outline(
        components(settled, p.grid_rows, p.grid_cols), p.grid_cols, p.cell_px,
        [(F.max("persist") / F.lit(p.fps)).alias("dwell_s"), F.max(F.abs("dev")).alias("peak_dev_c"), F.avg("dev").alias("mean_dev_c")],
    )
    return out.filter(F.col("cells") <= p.max_region_cells).withColumn("key", place_key("static", F.col("cx"), F.col("cy"), 16))


def optical_regions(cells: DataFrame, p: OpticalSite = OPTICAL_SITE) -> DataFrame:
    """Settled optical patches, the longest few per frame, with how many there were in all."""
    settled = cells.filter(F.col("persist") >= p.persist_frames).select("site_id", "frame_idx", "pos", "persist", "z")
    out = _outline(
        components(settled, p.grid_rows, p.grid_cols), p.grid_cols, p.cell_px,
        [(F.max("persist") / F.lit(p.fps)).alias("dwell_s"), F.max("z").alias("peak_z")],
    )
    box_cells = F.col("w") * F.col("h") / F.lit(p.cell_px**2)
    fit = F.col("cells").between(p.min_region_cells, p.max_region_cells) & (F.col("cells") >= p.min_region_fill * box_cells)
    frame = Window.partitionBy("site_id", "frame_idx")
    ranked = out.filter(fit).withColumns(
        {
            "regions_found": F.count(F.lit(1)).over(frame),
            "_rank": F.row_number().over(frame.orderBy(F.col("dwell_s").desc(), "region")),
        }
    )
    return ranked.filter(F.col("_rank") <= p.max_regions).drop("_rank").withColumn(
        "key", place_key("optical-static", F.col("cx"), F.col("cy"), 64)
    )
