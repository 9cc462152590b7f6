"""Temperature columns: raw counts to degrees, and the small features built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perimetra.params import CALIBRATION, Calibration


def linear_c(raw: Column, ambient: Column, p: Calibration = CALIBRATION) -> Column:
    """First estimate of a pixel's temperature from its count and the ambient reading."""
    return ambient + (raw - F.lit(p.raw_zero)) / F.lit(p.raw_per_degree)


def calibrated_c(t: Column, p: Calibration = CALIBRATION) -> Column:
    """Factory curve: quadratic up to the knee, a straight line above it."""
    curve = F.when(t <= p.knee, F.lit(p.quad) * t * t + F.lit(p.lin) * t + F.lit(p.const)).otherwise(t - p.above_knee)
    return F.lit(p.gain) * curve + F.lit(p.offset)


def celsius(raw: Column, ambient: Column, p: Calibration = CALIBRATION) -> Column:
    return calibrated_c(linear_c(raw, ambient, p), p)


def celsius_frame(counts: Column, ambient: Column, pixels: int, p: Calibration = CALIBRATION) -> Column:
    """A whole frame in one array expression; the metadata rows after ``pixels`` are cut."""
    return F.transform(F.slice(counts, 1, pixels), lambda raw: celsius(raw.cast("double"), ambient, p))


def hotspot_c(peak: Column, mean: Column) -> Column:
    return peak - mean


def stretch(value: Column, lo: Column, hi: Column) -> Column:
    """Map ``lo..hi`` to 0..255 for display, with at least half a degree of span."""
    span = F.greatest(hi - lo, F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - lo) * (F.lit(255.0) / span)))
