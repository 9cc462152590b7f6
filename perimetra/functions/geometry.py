"""Boxes, points and the projective map between the two cameras, as columns.

A box is four columns ``x, y, w, h``; a homography is nine doubles in row order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in "xywh"))


def aspect(w: Column, h: Column) -> Column:
    return w.cast("double") / F.greatest(h.cast("double"), F.lit(1.0))


def extent(area: Column, w: Column, h: Column) -> Column:
    return area / F.greatest((w * h).cast("double"), F.lit(1.0))


def merged_solidity(area: Column, w: Column, h: Column) -> Column:
    """Solidity of an object put together from several blobs."""
    return F.least(F.lit(1.0), extent(area, w, h) * 1.15)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def axis_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(b0 - a1, a0 - b1, F.lit(0).cast("double"))


def touches(a: Box, b: Box, pad: float = 0) -> Column:
    """Open-interval overlap of two boxes, one of them grown by ``pad``."""
    return (
        (a.x < b.x + b.w + pad)
        & (b.x < a.x + a.w + pad)
        & (a.y < b.y + b.h + pad)
        & (b.y < a.y + a.h + pad)
    )


def shared_area(a: Box, b: Box) -> Column:
    zero = F.lit(0).cast("double")
    dx = F.greatest(zero, F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
    dy = F.greatest(zero, F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y))
    return dx * dy


def cover(a: Box, b: Box) -> Column:
    """Shared area over the smaller of the two areas."""
    return shared_area(a, b) / F.greatest(F.lit(1.0), F.least(a.w * a.h, b.w * b.h).cast("double"))


def map_x(h: Column, x: Column, y: Column) -> Column:
    return F.try_divide(h[0] * x + h[1] * y + h[2], h[6] * x + h[7] * y + h[8])


def map_y(h: Column, x: Column, y: Column) -> Column:
    return F.try_divide(h[3] * x + h[4] * y + h[5], h[6] * x + h[7] * y + h[8])


def map_box(h: Column, b: Box) -> Box:
    """Bounds of the four mapped corners, rounded half to even."""
    corners = [(b.x, b.y), (b.x + b.w, b.y), (b.x + b.w, b.y + b.h), (b.x, b.y + b.h)]
    xs = [map_x(h, x, y) for x, y in corners]
    ys = [map_y(h, x, y) for x, y in corners]
    x0, x1, y0, y1 = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    return Box(F.rint(x0), F.rint(y0), F.rint(x1 - x0), F.rint(y1 - y0))


def with_columns_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add costly columns and stop later filters and joins from repeating their expressions.

    The columns are computed in one projection; the generator above it is a step the
    optimizer does not move filters through.
    """
    staged = df.withColumns({f"_{k}": v for k, v in cols.items()})
    held = F.inline(F.array(F.struct(*[F.col(f"_{k}").alias(k) for k in cols])))
    return staged.select(*df.columns, held)


def with_mapped_box(df: DataFrame, h: Column, box: Box, out: tuple[str, str, str, str] = ("mx", "my", "mw", "mh")) -> DataFrame:
    """Add a box mapped to the other camera."""
    return with_columns_once(df, dict(zip(out, map_box(h, box))))


def inverse(h: Column) -> Column:
    """Inverse homography by cofactors; NULL when the matrix is singular."""
    a = [h[i] for i in range(9)]
    det = a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])
    cof = [
        a[4] * a[8] - a[5] * a[7],
        a[2] * a[7] - a[1] * a[8],
        a[1] * a[5] - a[2] * a[4],
        a[5] * a[6] - a[3] * a[8],
        a[0] * a[8] - a[2] * a[6],
        a[2] * a[3] - a[0] * a[5],
        a[3] * a[7] - a[4] * a[6],
        a[1] * a[6] - a[0] * a[7],
        a[0] * a[4] - a[1] * a[3],
    ]
    return F.when(det != 0.0, F.array(*[c / F.nullif(det, F.lit(0.0)) for c in cof]))


def turned_point(x: Column, y: Column, w: int, h: int, k: int) -> tuple[Column, Column]:
    """Where a pixel of a ``w`` by ``h`` frame lands after ``k`` anticlockwise quarter turns."""
    k = k % 4
    if k == 1:
        return y, F.lit(w - 1) - x
    if k == 2:
        return F.lit(w - 1) - x, F.lit(h - 1) - y
    if k == 3:
        return F.lit(h - 1) - y, x
    return x, y


def turned_box(b: Box, w: int, h: int, k: int) -> Box:
    """Turn both inclusive corners and take their bounds."""
    ax, ay = turned_point(b.x, b.y, w, h, k)
    far_x = b.x + F.greatest(b.w - 1, F.lit(0).cast("double"))
    far_y = b.y + F.greatest(b.h - 1, F.lit(0).cast("double"))
    bx, by = turned_point(far_x, far_y, w, h, k)
    return Box(F.least(ax, bx), F.least(ay, by), F.abs(bx - ax) + 1, F.abs(by - ay) + 1)


def clipped_box(b: Box, w: int, h: int, margin: int = 0) -> Column:
    """Box grown by ``margin`` and cut to the frame, as a struct; NULL when nothing is left."""
    zero = F.lit(0).cast("double")
    x0, y0 = F.greatest(zero, _trunc(b.x) - margin), F.greatest(zero, _trunc(b.y) - margin)
    x1 = F.least(F.lit(float(w)), _trunc(b.x + b.w) + margin)
    y1 = F.least(F.lit(float(h)), _trunc(b.y + b.h) + margin)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def _trunc(v: Column) -> Column:
    return v.cast("long").cast("double")


def plausible(area: Column, w: Column, h: Column, frame_w: int, frame_h: int, p) -> Column:
    """Could a blob of this shape be an object rather than an edge of scenery?"""
    box = (w * h).cast("double")
    long_side = F.greatest(w, h).cast("double")
    short_side = F.greatest(F.least(w, h).cast("double"), F.lit(1.0))
    return (
        (box > 0)
        & (box <= p.max_box_frac * frame_w * frame_h)
        & (long_side / short_side <= p.max_side_ratio)
        & (area / F.nullif(box, F.lit(0.0)) >= p.min_fill)
    )


def cell_of(v: Column, size: int, n: int) -> Column:
    """Grid index of a coordinate, clipped to the grid."""
    return F.least(F.greatest(F.floor(v.cast("long") / F.lit(size)), F.lit(0)), F.lit(n - 1)).cast("int")


def place_key(kind: str, cx: Column, cy: Column, size: int) -> Column:
    """Quantised location used as the name of an object that does not move."""
    return F.format_string(
        f"{kind}:%d:%d", F.floor(cy.cast("long") / F.lit(size)).cast("long"), F.floor(cx.cast("long") / F.lit(size)).cast("long")
    )


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test of a point against ``ARRAY<STRUCT<x,y>>``; no polygon holds every point."""
    n = F.size(polygon)

    def crosses(corner: Column, i: Column) -> Column:
        nxt = F.get(polygon, (i + 1) % n)
        rise = nxt["y"] - corner["y"]
        at = corner["x"] + (y - corner["y"]) / F.nullif(rise, F.lit(0.0)) * (nxt["x"] - corner["x"])
        hit = ((corner["y"] > y) != (nxt["y"] > y)) & (x < at)
        return F.when(hit, 1).otherwise(0)

    crossings = F.aggregate(F.transform(polygon, crosses), F.lit(0), lambda a, v: a + v)
    return F.coalesce(n <= 0, F.lit(True)) | (crossings % 2 == 1)
