"""What is it: a weighted vote over wingbeat, hot core, outline and path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perimetra.functions.text import num, words
from perimetra.params import CLASSIFY, FUSION, Classify, Fusion

# Class names that are direct evidence of an aircraft.
AIRCRAFT = ("drone", "uav", "quadcopter", "quadrotor")
# Class names that may replace the thermal verdict.
CAN_OVERRULE = (
    "person", "chair", "couch", "bed", "dining table", "tv", "laptop",
    "refrigerator", "oven", "microwave", "sink", "toilet", "bench",
    "potted plant", "car", "truck", "bus", "motorcycle", "bicycle",
    "train", "boat", "horse", "cow", "elephant", "bear", "zebra",
    "giraffe", "dog", "cat",
)
# Class names of furniture.
FURNITURE = (
    "chair", "couch", "bed", "dining table", "tv", "refrigerator", "oven",
    "microwave", "sink", "toilet", "potted plant", "bench", "book", "clock",
    "vase", "laptop", "keyboard", "mouse", "bowl", "cup", "bottle",
    "wine glass",
)
# Class names of things that fly or are thrown.
AIRBORNE = ("airplane", "bird", "kite", "frisbee", "sports ball")


def landed(aspect: Column, extent: Column, parts: Column, hotspot: Column, contrast: Column, p: Classify = CLASSIFY) -> Column:
    """Several hot parts in one compact outline that stands out from its surroundings."""
    folded = F.when(aspect < 1.0, 1.0 / F.greatest(aspect, F.lit(1e-6))).otherwise(aspect)
    stands_out = (hotspot >= p.hot_drone_c) | (F.abs(contrast) >= p.landed_contrast_c)
    return stands_out & (parts >= p.landed_parts) & (folded <= p.landed_aspect) & (extent >= p.landed_extent)


def grounded_reason(hits: Column, travel: Column, area: Column, is_landed: Column, p: Classify = CLASSIFY) -> Column:
    """Why this cannot be an aircraft; NULL when it might be one."""
    still = (hits >= p.min_hits) & (travel < p.min_travel_px) & ~is_landed
    return F.when(
        still, words("has not moved - ", num(travel, 1), " px of net travel over its whole history")
    ).when(
        area > p.max_area_px,
        words("far too large for an airframe at watch range (", F.floor(area).cast("string"), " px)"),
    )


def _ramp(v: Column, lo: float, hi: float) -> Column:
    """0 at ``lo``, 1 at ``hi``, straight between, flat outside."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / F.lit(hi - lo)))


def vote(
    flap: Column,
    hotspot: Column,
    area: Column,
    aspect: Column,
    extent: Column,
    parts: Column,
    straightness: Column,
    p: Classify = CLASSIFY,
) -> tuple[Column, Column]:
    """Weight of evidence for an aircraft and for a bird."""
    wing = _ramp(flap, p.flap_rigid, p.flap_bird)
    core = _ramp(hotspot, p.hot_flat_c, p.hot_drone_c)
    resolved = area >= p.shape_area_px
    long_outline = F.when(resolved & (aspect > 2.0), p.w_shape).otherwise(0.0)
    square_outline = F.when(resolved & aspect.between(0.6, 1.8) & (extent > 0.4), p.w_shape).otherwise(0.0)
    many_parts = F.when(parts >= 3, p.w_shape * 0.5).otherwise(0.0)
    direct = straightness >= p.straight_drone
    wander = F.least(F.lit(1.0), (p.straight_drone - straightness) / F.lit(p.straight_drone))
    drone = (
        p.w_flap * (1.0 - wing)
        + p.w_hot * core
        + square_outline
        + many_parts
        + F.when(direct, p.w_straight).otherwise(0.0)
    )
    bird = p.w_flap * wing + p.w_hot * (1.0 - core) + long_outline + F.when(direct, 0.0).otherwise(p.w_straight * wander)
    return drone, bird


def verdict(
    hits: Column,
    travel: Column,
    grounded: Column,
    is_landed: Column,
    parts: Column,
    drone: Column,
    bird: Column,
    p: Classify = CLASSIFY,
) -> Column:
    """``STRUCT<label, confidence>``; "unknown" until history and evidence allow more."""
    total = drone + bird
    share = F.when(drone >= bird, drone).otherwise(bird) / F.nullif(total, F.lit(0.0))
    name = F.when(drone >= bird, "drone").otherwise("bird")
    sitting = (travel < p.min_travel_px) & is_landed

    def answer(label: Column | str, confidence: Column) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(label.alias("label"), confidence.cast("double").alias("confidence"))

    return (
        F.when((hits < p.min_hits) | grounded.isNotNull(), answer("unknown", F.lit(0.0)))
        .when(sitting, answer("drone", F.least(F.lit(0.95), 0.62 + 0.06 * parts)))
        .when(total <= 0, answer("unknown", F.lit(0.0)))
        .when(share >= p.decision, answer(name, share))
        .otherwise(answer("unknown", share))
    )


def overruled(label: Column, confidence: Column, name: Column, name_conf: Column, p: Fusion = FUSION) -> Column:
    """Let a name from the optical camera replace, confirm or only annotate the verdict."""
    aircraft = F.coalesce(name.isin(*AIRCRAFT), F.lit(False))
    trusted = F.coalesce(name_conf >= F.when(aircraft, p.aircraft_trust).otherwise(p.name_trust), F.lit(False))
    replaces = F.coalesce(name.isin(*CAN_OVERRULE), F.lit(False))
    return F.struct(
        F.when(trusted & aircraft, "drone").when(trusted & replaces, name).otherwise(label).alias("label"),
        F.when(trusted & aircraft, F.greatest(confidence, name_conf))
        .when(trusted & replaces, name_conf)
        .otherwise(confidence)
        .alias("confidence"),
        (trusted & (aircraft | replaces)).alias("named_by_optical"),
        F.when(trusted & ~aircraft & ~replaces, words(name, " ", num(name_conf, 2))).alias("optical_guess"),
    )


def class_hue(label: Column) -> Column:
    """A stable display hue per class name."""
    return (F.crc32(label.cast("binary")) % 180).cast("int")
