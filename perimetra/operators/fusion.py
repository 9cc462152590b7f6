"""Each camera asking the other: association, names, shape and heat checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimetra.functions import geometry as G
from perimetra.functions import threat as T
from perimetra.functions.arrays import let, mean_of, median_of, middle_of
from perimetra.operators.blobs import largest_outlines
from perimetra.operators.matching import greedy_pairs
from perimetra.params import BUNDLE, FUSION, Fusion

FRAME = ["site_id", "frame_idx"]


def associate(thermal: DataFrame, optical: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """Pair detections of both cameras that are one object.

    ``thermal`` carries its box already mapped to optical pixels (``mx, my, mw, mh``); the
    largest thermal detection chooses first.
    """
    c = F.col
    left = thermal.select(
        *FRAME,
        c("det_id").alias("l_id"),
        F.struct((-c("area")).alias("a"), c("det_id").alias("i")).alias("l_ord"),
        (c("mx") + c("mw") / 2.0).alias("lx"),
        (c("my") + c("mh") / 2.0).alias("ly"),
        (p.match_px + F.greatest("mw", "mh") / 2.0).alias("radius"),
    )
    right = optical.select(
        *FRAME,
        c("det_id").alias("r_id"),
        F.struct((-c("area")).alias("a"), c("det_id").alias("i")).alias("r_ord"),
        c("cx").alias("rx"),
        c("cy").alias("ry"),
    )
    return greedy_pairs(left, right).withColumnsRenamed({"l_id": "thermal_id", "r_id": "optical_id"})


def optical_only(optical: DataFrame, pairs: DataFrame) -> DataFrame:
    """Optical detections no thermal detection claimed."""
    return optical.join(pairs.select(*FRAME, F.col("optical_id").alias("det_id")), [*FRAME, "det_id"], "left_anti")


TILE = 64


def tiled(df: DataFrame, x: str, y: str, w: str, h: str, pad: float = 0) -> DataFrame:
    """One row per tile a box (grown by ``pad``) lies on, so boxes meet on equal keys."""

    def tiles(v: Column, size: Column) -> Column:
        return F.sequence(F.floor((v - pad) / F.lit(TILE)).cast("int"), F.floor((v + size + pad) / F.lit(TILE)).cast("int"))

    return df.withColumn("_tx", F.explode(tiles(F.col(x), F.col(w)))).withColumn("_ty", F.explode(tiles(F.col(y), F.col(h))))


def best_names(boxes: DataFrame, names: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """The recognised name that covers each box best, if any covers enough of it.

    ``boxes(site_id, frame_idx, det_id, x, y, w, h)`` and ``names(..., label, confidence, nx,
    ny, nw, nh)`` are in optical pixels. Both sides meet on the 64-pixel tiles they cover.
    """
    real = boxes.filter((F.col("w") > 0) & (F.col("h") > 0))
    met = tiled(real, "x", "y", "w", "h").join(tiled(names, "nx", "ny", "nw", "nh"), [*FRAME, "_tx", "_ty"])
    share = G.cover(G.Box.of(), G.Box(F.col("nx"), F.col("ny"), F.col("nw"), F.col("nh")))
    best = F.max_by(
        F.struct("label", "confidence"),
        F.struct(share.alias("s"), F.col("confidence").alias("c"), (-F.col("name_id")).alias("i")),
    )
    named = met.filter(share > p.name_cover).groupBy(*FRAME, "det_id").agg(best.alias("_n"))
    return named.select(*FRAME, "det_id", F.col("_n.label").alias("name"), F.col("_n.confidence").alias("name_confidence"))


def unclaimed(regions: DataFrame, boxes: DataFrame, pad: float) -> DataFrame:
    """Settled regions no live detection of the same frame touches (each side grown by ``pad``).

    Regions ``(.., key, x, y, w, h)`` and ``boxes(.., bx, by, bw, bh)`` share pixels.
    """
    a, b = G.Box.of(), G.Box(F.col("bx"), F.col("by"), F.col("bw"), F.col("bh"))
    live = tiled(boxes.select(*FRAME, "bx", "by", "bw", "bh"), "bx", "by", "bw", "bh")
    wide = tiled(regions.select(*FRAME, "key", "x", "y", "w", "h"), "x", "y", "w", "h", pad)
    touched = wide.join(live, [*FRAME, "_tx", "_ty"]).filter(G.touches(a, b, pad)).select(*FRAME, "key").distinct()
    return regions.join(touched, [*FRAME, "key"], "left_anti")


def crop(values: Column, cols: int, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rectangle ``[x0, x1) x [y0, y1)`` of a row-major frame, flattened."""
    lines = F.sequence(y0.cast("int"), y1.cast("int") - 1)
    start, length = x0.cast("int"), (x1 - x0).cast("int")
    return F.flatten(F.transform(lines, lambda y: F.slice(values, y * cols + start + 1, length)))


def bundled(boxes: DataFrame, limit: int = BUNDLE) -> DataFrame:
    """Boxes of a frame as lists of about ``limit`` at most: a crowded frame makes several."""
    sizes = boxes.groupBy(*FRAME).agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int").alias("_cuts"))
    cut = boxes.join(sizes, FRAME).withColumn("_cut", F.pmod(F.xxhash64("det_id"), F.col("_cuts")))
    return cut.groupBy(*FRAME, "_cut").agg(F.collect_list(F.struct("det_id", "x", "y", "w", "h")).alias("_boxes")).drop("_cut")


BESIDE_PX = 1024


def heat_checks(boxes: DataFrame, frames: DataFrame, rows: int, cols: int, p: Fusion = FUSION) -> DataFrame:
    """Is each box ``(site_id, frame_idx, det_id, x, y, w, h)``, in thermal pixels, warm against its ring?

    ``frames`` holds ``celsius`` arrays, which a join copies beside each box: a frame of up to ``BESIDE_PX`` pixels costs less
    so than putting its boxes in lists. Boxes of larger frames ride in lists with the frame's single pixel row.
    """
    asked = boxes.select(*FRAME, "det_id", "x", "y", "w", "h")
    pixels, c = F.col("celsius"), F.col
    fields = ["peak_c", "mean_c", "contrast_c", "hotspot_c", "warm", "confidence", "reason"]

    def ring(a: Column) -> Column:
        return G.clipped_box(G.Box(a["x0"], a["y0"], a["x1"] - a["x0"], a["y1"] - a["y0"]), cols, rows, p.ring_px)

    def inside(a: Column) -> Column:
        return crop(pixels, cols, a["x0"], a["y0"], a["x1"], a["y1"])

    if rows * cols <= BESIDE_PX:
        # Areas before the join; each step's values are columns of the next, and what nobody reads is not made.
        areas = asked.withColumn("_a", G.clipped_box(G.Box.of(), cols, rows, p.patch_margin_px)).withColumn("_o", ring(c("_a")))
        cut = areas.join(frames.select(*FRAME, "celsius"), FRAME).select(
            *FRAME, "det_id", c("_a").isNotNull().alias("found"), inside(c("_a")).alias("_in"), F.sort_array(inside(c("_o"))).alias("_around")
        )
        seen = cut.select(*FRAME, "det_id", "found", F.array_max("_in").alias("_peak"), mean_of(c("_in")).alias("_mean"), middle_of(c("_around")).alias("_back"))
        heat = T.heat_verdict(c("_peak"), c("_mean"), c("_back"), p)
        return seen.select(*FRAME, "det_id", "found", *[F.when(c("found"), heat[f]).alias(f) for f in fields])

    def check(b: Column) -> Column:
        area = G.clipped_box(G.Box(b["x"], b["y"], b["w"], b["h"]), cols, rows, p.patch_margin_px)
        return let(area, lambda a: measured(b, a))

    def measured(b: Column, a: Column) -> Column:
        patch = inside(a)
        around = let(ring(a), lambda o: median_of(inside(o)))
        seen = F.struct(F.array_max(patch).alias("peak"), mean_of(patch).alias("mean"), around.alias("back"))
        heat = let(seen, lambda s: T.heat_verdict(s["peak"], s["mean"], s["back"], p))
        return F.struct(b["det_id"].alias("det_id"), a.isNotNull().alias("found"), F.when(a.isNotNull(), heat).alias("heat"))

    return (
        bundled(asked).join(frames.select(*FRAME, "celsius"), FRAME)
        .select(*FRAME, F.explode(F.transform("_boxes", check)).alias("c"))
        .select(*FRAME, "c.det_id", "c.found", "c.heat.*")
    )


def shape_checks(boxes: DataFrame, frames: DataFrame, rows: int, cols: int, p: Fusion = FUSION) -> DataFrame:
    """What does each box ``(site_id, frame_idx, det_id, x, y, w, h)``, in optical pixels, look like?

    ``frames`` holds grey levels as arrays. Each crop is split at its own best level; the
    outline of its main object decides.
    """
    held = bundled(boxes.select(*FRAME, "det_id", "x", "y", "w", "h"))

    def cut(b: Column) -> Column:
        area = G.clipped_box(G.Box(b["x"], b["y"], b["w"], b["h"]), cols, rows, p.crop_margin_px)
        return let(
            area,
            lambda a: F.struct(
                b["det_id"].alias("det_id"),
                (a["x1"] - a["x0"]).cast("int").alias("width"),
                F.when(a.isNotNull(), crop(F.col("grey"), cols, a["x0"], a["y0"], a["x1"], a["y1"])).alias("grey"),
            ),
        )

    @F.pandas_udf("struct<area: double, w: double, h: double, solidity: double>")
    def outline(grey: pd.Series, width: pd.Series) -> pd.DataFrame:
        crops = [None if g is None else np.asarray(g, float).reshape(-1, int(w)) for g, w in zip(grey, width)]
        return pd.DataFrame(largest_outlines(crops), columns=["area", "w", "h", "solidity"])

    crops = held.join(frames.select(*FRAME, "grey"), FRAME).select(*FRAME, F.explode(F.transform("_boxes", cut)).alias("c")).select(*FRAME, "c.*")
    # A fixed count, as scans have: the work is in Python, and few bytes would be merged into few tasks.
    tasks = int(crops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = crops.repartition(tasks, F.xxhash64(*FRAME, "det_id")).withColumn("_o", outline("grey", "width"))
    c = F.col
    aspect = c("_o.w") / F.greatest(c("_o.h"), F.lit(1.0))
    verdict = T.shape_verdict(c("_o.area"), aspect, c("_o.solidity"), p)
    inside = c("grey").isNotNull()
    lost = F.when(~inside, "thermal detection maps outside the optical frame").otherwise("nothing segmented in the crop")
    found = c("_o.area").isNotNull()
    return seen.select(
        *FRAME, "det_id", found.alias("o_found"), c("_o.area").alias("o_pixels"), aspect.alias("o_aspect"), c("_o.solidity").alias("o_solidity"),
        F.when(found, verdict["label"]).otherwise("unknown").alias("o_label"), F.when(found, verdict["confidence"]).otherwise(0.0).alias("o_confidence"),
        F.when(found, verdict["reason"]).otherwise(lost).alias("o_reason"),
    )


def otsu(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Grey level that best splits each key's histogram, and which side is the minority.

    Counting first leaves at most 256 rows per key for the cumulative windows.
    """
    hist = levels.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n"))
    all_of = Window.partitionBy(*keys)
    upto = all_of.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("n") * F.col("level")
    h = hist.select(
        *keys, "level",
        F.sum("n").over(upto).alias("n0"), F.sum(mass).over(upto).alias("s0"),
        F.sum("n").over(all_of).alias("nt"), F.sum(mass).over(all_of).alias("st"),
    )
    c = F.col
    n1 = c("nt") - c("n0")
    gap = c("s0") / c("n0") - (c("st") - c("s0")) / F.nullif(n1, F.lit(0))
    between = F.when(n1 > 0, c("n0") * n1 * gap * gap).otherwise(0.0)
    best = h.withColumn("b", between).groupBy(*keys).agg(
        F.max_by(F.struct("level", "n0", "nt"), F.struct(F.col("b"), (-F.col("level")).alias("l"))).alias("m")
    )
    above = c("m.nt") - c("m.n0")
    return best.select(
        *keys, c("m.level").alias("threshold"), (above <= c("m.nt") / 2.0).alias("object_is_brighter"),
        F.least(above, c("m.n0")).alias("object_px"),
    )


def worth_a_look(tracks: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """Only objects that are novel, named drone or unnamed get the costly shape check."""
    odd = (F.col("site_risk") >= p.interest) | (F.col("label") == "drone") | (F.col("confidence") == 0.0)
    return tracks.filter(odd & (F.col("hits") >= p.settle_min_hits))


def frame_counters(optical: DataFrame, pairs: DataFrame, checks: DataFrame) -> DataFrame:
    """Per-frame tally of what the cameras asked each other."""
    seen = optical.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("optical_candidates"))
    met = pairs.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("paired_with_thermal"))
    warm = checks.groupBy(*FRAME).agg(F.count_if("warm").alias("optical_only_confirmed_warm"))
    j = seen.join(met, FRAME, "left").join(warm, FRAME, "left").fillna(0, ["paired_with_thermal", "optical_only_confirmed_warm"])
    return j.withColumn("optical_only", F.col("optical_candidates") - F.col("paired_with_thermal"))
