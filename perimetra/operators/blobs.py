"""From masks and pixels to detections, and from fragments to objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimetra.functions import geometry as G
from perimetra.functions.arrays import let, median_of
from perimetra.operators.matching import box_groups
from perimetra.operators.scans import keyed_scan
from perimetra.params import DETECT, SENSOR, Detect, Sensor

BLOB = "STRUCT<blob: INT, x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE, cx: DOUBLE, cy: DOUBLE, area: DOUBLE, peak: DOUBLE, mean: DOUBLE, contrast: DOUBLE, darker: BOOLEAN, thin: BOOLEAN>"

RECTANGLE = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of true pixels, in reading order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edge == 1)
    return rows, first, np.nonzero(edge == -1)[1] - 1


def label_mask(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Components of a boolean grid, joined over edges and (``corners``) corners: least flat index per component, -1 outside.

    Runs of one line meet those of the line before; what meets takes the number of the earlier run.
    """
    rows, first, last = _runs(mask)
    head = list(range(len(rows)))

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    reach = int(corners)
    begins = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    lo, hi = first.tolist(), last.tolist()
    for y in range(1, mask.shape[0]):
        i, j = begins[y - 1], begins[y]
        while i < begins[y] and j < begins[y + 1]:
            if lo[i] <= hi[j] + reach and lo[j] <= hi[i] + reach:
                a, b = root(i), root(j)
                head[max(a, b)] = min(a, b)
            if hi[i] < hi[j]:
                i += 1
            else:
                j += 1
    out = np.full(mask.size, -1, dtype=np.int64)
    if len(rows):
        least = [rows[r] * mask.shape[1] + first[r] for r in map(root, range(len(head)))]
        out[mask.ravel()] = np.repeat(least, last - first + 1)
    return out.reshape(mask.shape)


def without_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with all that its components enclose: background that no path over pixel edges leads out of."""
    apart = label_mask(~np.pad(mask, 1), corners=False)
    return (apart != 0)[1:-1, 1:-1]


def _corner_points(mask: np.ndarray) -> int:
    """Points at which the outline of one component turns, as it is walked around over pixel centres; 1 for a single pixel."""
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    p = np.pad(mask, 1)
    start = tuple(int(v) for v in np.argwhere(p)[0])

    def step(at: tuple[int, int], back: int) -> int | None:
        for k in range(1, 9):
            d = (back + k) % 8
            if p[at[0] + around[d][0], at[1] + around[d][1]]:
                return d
        return None

    first = step(start, 4)
    if first is None:
        return 1
    at, way, ways = start, first, []
    while True:
        ways.append(way)
        at = (at[0] + around[way][0], at[1] + around[way][1])
        way = step(at, (way + 4) % 8)
        if at == start and way == first:
            break
    return sum(a != b for a, b in zip(ways, ways[-1:] + ways[:-1]))


def _window(mask: np.ndarray, size: int, spread: bool) -> np.ndarray:
    """Dilate (``spread``) or erode by a square; the border counts as neutral."""
    r = size // 2
    p = np.pad(mask, r, constant_values=not spread)
    parts = [p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]] for dy in range(size) for dx in range(size)]
    return np.logical_or.reduce(parts) if spread else np.logical_and.reduce(parts)


def hull_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Area of the convex hull of some pixel centres."""
    pts = sorted(set(zip(xs.tolist(), ys.tolist())))

    def half(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2.0


def largest_outline(grey: np.ndarray) -> tuple[float, float, float, float] | None:
    """Area, width, height and solidity of the main object of a crop, split at its own best grey level."""
    levels = np.bincount(grey.ravel().astype(int).clip(0, 255), minlength=256).astype(float)
    n0, s0 = levels.cumsum(), (levels * np.arange(256)).cumsum()
    n1 = n0[-1] - n0
    with np.errstate(all="ignore"):
        split = np.nan_to_num(n0 * n1 * (s0 / n0 - (s0[-1] - s0) / n1) ** 2)
    mask = grey > int(split.argmax())
    if mask.sum() > mask.size / 2:
        mask = ~mask
    found = frame_blobs(mask, grey, grey)
    if not found:
        return None
    b = max(found, key=lambda f: f["area"])
    ys, xs = np.nonzero(label_mask(mask) == b["blob"])
    return b["area"], b["w"], b["h"], b["area"] / max(hull_area(xs, ys) or b["area"], 1.0)


def _outlines_alike(grey: np.ndarray) -> np.ndarray:
    """`largest_outline` of a stack of small crops of one shape: a row of area, width, height and solidity each, NaN where there is none."""
    n, h, w = grey.shape
    size = h * w
    of = np.repeat(np.arange(n), size)
    with np.errstate(all="ignore"):
        level = grey.reshape(n, size).astype(int).clip(0, 255)
        levels = np.bincount(of * 256 + level.ravel(), minlength=n * 256).reshape(n, 256).astype(float)
        n0, s0 = levels.cumsum(axis=1), (levels * np.arange(256)).cumsum(axis=1)
        n1 = n0[:, -1:] - n0
        split = np.nan_to_num(n0 * n1 * (s0 / n0 - (s0[:, -1:] - s0) / n1) ** 2)
        mask = grey > split.argmax(axis=1)[:, None, None]
    mask ^= (mask.sum(axis=(1, 2)) > size / 2)[:, None, None]

    def around(a: np.ndarray, corners: bool, merge: np.ufunc) -> np.ndarray:
        """Every pixel merged with those beside it."""
        out = a.copy()
        merge(out[:, 1:], a[:, :-1], out=out[:, 1:])
        merge(out[:, :-1], a[:, 1:], out=out[:, :-1])
        sides = out.copy() if corners else a
        merge(out[:, :, 1:], sides[:, :, :-1], out=out[:, :, 1:])
        merge(out[:, :, :-1], sides[:, :, 1:], out=out[:, :, :-1])
        return out

    ground = np.pad(~mask, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    outside = np.zeros_like(ground)
    outside[:, 0, 0] = True
    while True:
        more = around(outside, False, np.logical_or) & ground
        if (more == outside).all():
            break
        outside = more
    full = ~outside[:, 1:-1, 1:-1]
    label = np.where(full, np.arange(size).reshape(h, w), size)
    while True:
        less = np.where(full, around(label, True, np.minimum), size)
        if (less == label).all():
            break
        label = less

    # Every component has a slot, by its crop and its least pixel.
    slot = np.where(full, np.arange(n)[:, None, None] * size + label, -1)
    pixels = np.bincount(slot[full], minlength=n * size)
    area = np.zeros(n * size)
    if h > 1 and w > 1:
        quads = np.stack([slot[:, dy : h - 1 + dy, dx : w - 1 + dx] for dy in (0, 1) for dx in (0, 1)])
        held = (quads >= 0).sum(axis=0)
        area = np.bincount(quads.max(axis=0)[held >= 3], np.where(held[held >= 3] == 4, 1.0, 0.5), n * size)
    area[pixels == 0] = -1.0
    thin = (pixels > 0) & (area < 1.0)
    area[thin] = np.minimum(pixels[thin], 2)  # one pixel is a point, two turn at both ends
    long = np.flatnonzero(thin & (pixels > 2))
    for i in long:
        area[i] = _corner_points(slot[i // size] == i)

    area = area.reshape(n, size)
    lead = area.argmax(axis=1)
    best = label == lead[:, None, None]
    best[~mask.any(axis=(1, 2))] = False
    there = best.any(axis=(1, 2))
    rows, columns = best.any(axis=2), best.any(axis=1)
    out = np.full((n, 4), np.nan)
    out[:, 0] = area[np.arange(n), lead]
    out[:, 1] = w - columns.argmax(axis=1) - columns[:, ::-1].argmax(axis=1)
    out[:, 2] = h - rows.argmax(axis=1) - rows[:, ::-1].argmax(axis=1)
    hull = _hull_areas(best, rows)
    out[:, 3] = out[:, 0] / np.maximum(np.where(hull > 0, hull, out[:, 0]), 1.0)
    out[~there] = np.nan
    return out


def _hull_areas(best: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Areas of the convex hulls of the pixel centres of one component per crop.

    Corners lie on rows, so the hull is told by its least and greatest column on each row: the lowest of all chords between two rows.
    """
    h, w = best.shape[1:]
    far = 1e7  # stands outside of the component's rows, so that no chord from there is the lowest
    ends = (best.argmax(axis=2), best[:, :, ::-1].argmax(axis=2) - (w - 1))
    sides = []
    for end in ends:
        first = np.where(rows, end, far).astype(float)
        low = first.copy()
        for i in range(h):
            for j in range(i + 2, h):
                step = np.arange(1, j - i) / (j - i)
                chord = first[:, i, None] + (first[:, j] - first[:, i])[:, None] * step
                np.minimum(low[:, i + 1 : j], chord, out=low[:, i + 1 : j])
        sides.append(low)
    wide = np.where(rows, -sides[1] - sides[0], 0.0)
    whole = np.where(rows[:, 1:] & rows[:, :-1], wide[:, 1:] + wide[:, :-1], 0.0).sum(axis=1)
    return np.rint(whole) / 2.0  # corners are whole numbers, so twice the area is one too


#: Crops of up to so many pixels are worked as a stack of so many pixels in all; larger ones one by one.
SMALL_CROP, STACK = 1024, 1 << 18


def largest_outlines(crops: list[np.ndarray | None]) -> np.ndarray:
    """`largest_outline` of many crops, those of one small shape together; NaN where there is no crop or no object."""
    out = np.full((len(crops), 4), np.nan)
    alike: dict[tuple, list[int]] = {}
    for i, c in enumerate(crops):
        if c is not None:
            alike.setdefault(c.shape, []).append(i)
    for (h, w), members in alike.items():
        if h * w > SMALL_CROP:
            for i in members:
                found = largest_outline(crops[i])
                out[i] = np.nan if found is None else found
            continue
        most = max(1, STACK // max(h * w, 256))
        for k in range(0, len(members), most):
            part = members[k : k + most]
            out[part] = _outlines_alike(np.stack([crops[i] for i in part]))
    return out


def clean_mask(mask: np.ndarray) -> np.ndarray:
    """Drop specks (3x3 opening), then bridge small gaps (5x5 closing)."""
    opened = _window(_window(mask, 3, False), 3, True)
    return _window(_window(opened, 5, True), 5, False)


def frame_blobs(mask: np.ndarray, frame: np.ndarray, diff: np.ndarray, signed: np.ndarray | None = None) -> list[dict]:
    """Features of each blob of a mask, of all that its outer outline encloses; what lies in a hole is no blob of its own.

    Area and centre are those of the outline through pixel centres: four pixels of a square add the square, three the triangle between
    them. Where that is under one (``thin``), the number of the outline's corners stands for the area. ``signed`` tells darker from brighter.
    """
    if not mask.any():
        return []
    full = without_holes(mask)
    lab = label_mask(full)
    ids, of = np.unique(lab[full], return_inverse=True)
    ys, xs = np.nonzero(full)
    n = len(ids)
    number = np.full(full.shape, -1)
    number[full] = of
    count = np.bincount(of, minlength=n)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values[full], n) / count

    def most(values: np.ndarray, sign: int = 1) -> np.ndarray:
        out = np.full(n, -np.inf)
        np.maximum.at(out, of, sign * values)
        return sign * out

    area, mx, my = np.zeros(n), np.zeros(n), np.zeros(n)
    quads = [(0, 0), (0, 1), (1, 0), (1, 1)]
    h, w = full.shape
    parts = [number[dy : h - 1 + dy, dx : w - 1 + dx] for dy, dx in quads]
    there = np.stack([q >= 0 for q in parts])
    held = there.sum(axis=0)
    qy, qx = np.nonzero(held >= 3)
    if len(qy):
        inside = there[:, qy, qx]
        k = held[qy, qx]
        owner = np.max([q[qy, qx] for q in parts], axis=0)
        share = np.where(k == 4, 1.0, 0.5)
        px = qx + (inside * np.array([dx for _, dx in quads])[:, None]).sum(axis=0) / k
        py = qy + (inside * np.array([dy for dy, _ in quads])[:, None]).sum(axis=0) / k
        area = np.bincount(owner, share, n)
        mx, my = np.bincount(owner, share * px, n), np.bincount(owner, share * py, n)
    x0, x1, y0, y1 = most(xs, -1), most(xs), most(ys, -1), most(ys)
    bw, bh = x1 - x0 + 1, y1 - y0 + 1
    flat = area == 0
    safe = np.where(flat, 1.0, area)
    cx, cy = np.where(flat, x0 + bw / 2, mx / safe), np.where(flat, y0 + bh / 2, my / safe)
    thin = area < 1.0
    for i in np.flatnonzero(thin):
        area[i] = _corner_points(number == i)
    means, contrast, dark = mean(frame), mean(diff), mean(diff if signed is None else signed) < 0
    peaks = most(frame[full])
    columns = (ids, x0, y0, bw, bh, cx, cy, area, peaks, means, contrast)
    names = ("blob", "x", "y", "w", "h", "cx", "cy", "area", "peak", "mean", "contrast")
    return [
        {**{k: int(v) if k == "blob" else float(v) for k, v in zip(names, row)}, "darker": bool(d), "thin": bool(t)}
        for *row, d, t in zip(*columns, dark, thin)
    ]


def _cropped(frame: np.ndarray, roi: dict | None) -> tuple[np.ndarray, float, float]:
    """The part of a frame inside a rectangle (None: all of it) and where it begins."""
    if roi is None:
        return frame, 0.0, 0.0
    x, y = int(roi["x"]), int(roi["y"])
    return frame[y : y + int(roi["h"]), x : x + int(roi["w"])], float(x), float(y)


def _shifted(found: list[dict], x: float, y: float, width: int, cols: int) -> list[dict]:
    """Blobs of a part of a frame, told in pixels of the frame."""
    moved = lambda b: int((b // width + y) * cols + b % width + x)
    return [{**b, "blob": moved(b["blob"]), "x": b["x"] + x, "y": b["y"] + y, "cx": b["cx"] + x, "cy": b["cy"] + y} for b in found]


def detect_frozen(
    frames: DataFrame, rows: int, cols: int, threshold: float = DETECT.threshold_c, absolute: bool = False, clean: bool = True
) -> DataFrame:
    """Blobs of ``frames(site_id, frame_idx, values, background[, roi])`` against a fitted background.

    Every frame is independent, so the scan is the only stage. ``roi`` is a rectangle ``(x, y, w, h)`` to search in, see `footprint`.
    """

    @F.pandas_udf(f"array<{BLOB}>")
    def blobs(values: pd.Series, backs: pd.Series, rois: pd.DataFrame) -> pd.Series:
        out = []
        for v, b, roi in zip(values, backs, rois.to_dict("records")):
            frame, x, y = _cropped(np.asarray(v, float).reshape(rows, cols), None if roi["x"] != roi["x"] or roi["x"] is None else roi)
            signed = frame - _cropped(np.asarray(b, float).reshape(rows, cols), None if roi["x"] != roi["x"] or roi["x"] is None else roi)[0]
            diff = np.abs(signed) if absolute else signed
            mask = diff > threshold
            out.append(_shifted(frame_blobs(clean_mask(mask) if clean else mask, frame, diff, signed), x, y, frame.shape[1], cols))
        return pd.Series(out)

    roi = F.col("roi") if "roi" in frames.columns else F.lit(None)
    found = frames.select("site_id", "frame_idx", F.explode(blobs("values", "background", roi.cast(RECTANGLE))).alias("b"))
    return found.select("site_id", "frame_idx", "b.*")


class MotionDetector:
    """Running background of one camera; pixels under a blob do not teach it."""

    def __init__(self, rows: int, cols: int, optical: bool, p: Detect = DETECT):
        self.rows, self.cols, self.optical, self.p = rows, cols, optical, p
        self.back, self.seen = None, 0

    def feed(self, c: dict) -> dict | None:
        p = self.p
        idx, blobs, noise, line = [], [], [], []
        for f, v, roi in zip(c["frame_idx"], c["values"], c["roi"] if "roi" in c else [None] * len(c["frame_idx"])):
            frame, x, y = _cropped(np.asarray(v, float).reshape(self.rows, self.cols), roi)
            if self.back is None or self.back.shape != frame.shape:
                self.back, self.seen = frame.copy(), 1
                continue
            signed = frame - self.back
            size = np.abs(signed) if self.optical else signed
            grain = p.mad_scale * float(np.median(size[::4, ::4])) if self.optical else 0.0
            threshold = max(p.optical_threshold, p.noise_sigma * grain) if self.optical else p.threshold_c
            mask = clean_mask(size > threshold)
            quiet = ~mask
            self.back[quiet] += p.alpha * signed[quiet]
            self.seen += 1
            if self.seen >= p.warmup:
                idx.append(f)
                blobs.append(_shifted(frame_blobs(mask, frame, size, signed), x, y, frame.shape[1], self.cols))
                noise.append(grain)
                line.append(threshold)
        if not idx:
            return None
        return {"frame_idx": np.asarray(idx), "blobs": blobs, "noise": np.asarray(noise), "threshold": np.asarray(line)}

    def close(self) -> None:
        return None


def detect_adaptive(frames: DataFrame, rows: int, cols: int, optical: bool = False, p: Detect = DETECT) -> DataFrame:
    """Blobs of ``frames(site_id, frame_idx, values[, roi])`` against a background learned on the way.

    ``roi`` is a rectangle to search in, see `footprint`; where its size changes the background is learned anew.
    """
    schema = f"site_id long, frame_idx long, blobs array<{BLOB}>, noise double, threshold double"
    kept = [c for c in ("site_id", "frame_idx", "values", "roi") if c in frames.columns]
    scan = keyed_scan(frames.select(*kept), ["site_id"], ["frame_idx"], lambda: MotionDetector(rows, cols, optical, p), schema)
    return scan.select("site_id", "frame_idx", "noise", "threshold", F.explode("blobs").alias("b")).select(
        "site_id", "frame_idx", "noise", "threshold", "b.*"
    )


def merged(blobs: DataFrame, p: Detect = DETECT) -> DataFrame:
    """One detection per chain of thermal blobs: union box, summed area, area-weighted means."""
    g = box_groups(blobs, p.merge_gap_px)
    a = F.col("area")
    x0, y0 = F.min("x"), F.min("y")
    w, h = F.max(F.col("x") + F.col("w")) - x0, F.max(F.col("y") + F.col("h")) - y0
    total = F.nullif(F.sum(a), F.lit(0.0))
    out = g.groupBy("site_id", "frame_idx", "group").agg(
        x0.alias("x"), y0.alias("y"), w.alias("w"), h.alias("h"), F.sum(a).alias("area"),
        (F.sum(F.col("cx") * a) / total).alias("cx"), (F.sum(F.col("cy") * a) / total).alias("cy"),
        F.max("peak_c").alias("peak_c"), (F.sum(F.col("mean_c") * a) / total).alias("mean_c"),
        (F.sum(F.col("contrast_c") * a) / total).alias("contrast_c"), F.sum("parts").alias("parts"),
    )
    c = F.col
    return out.withColumns(
        {
            "aspect": G.aspect(c("w"), c("h")),
            "extent": G.extent(c("area"), c("w"), c("h")),
            "solidity": G.merged_solidity(c("area"), c("w"), c("h")),
        }
    )


def by_area(dets: DataFrame, out: str = "rank") -> DataFrame:
    """Largest first inside each frame."""
    w = Window.partitionBy("site_id", "frame_idx").orderBy(F.col("area").desc(), "det_id")
    return dets.withColumn(out, F.row_number().over(w))


def sized(dets: DataFrame, optical: bool = False, p: Detect = DETECT) -> DataFrame:
    lo, hi = (p.optical_min_area, p.optical_max_area) if optical else (p.min_area, p.max_area)
    return dets.filter(F.col("area").between(lo, hi))


def shape_filter(dets: DataFrame, frame_w: int, frame_h: int, p: Detect = DETECT) -> tuple[DataFrame, DataFrame]:
    """Plausible detections, and per site how many were turned away."""
    ok = G.plausible(F.col("area"), F.col("w"), F.col("h"), frame_w, frame_h, p)
    return dets.filter(ok), dets.groupBy("site_id").agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("rejected_shape"))


def noise_floor(diff: Column, rows: int, cols: int, p: Detect = DETECT) -> Column:
    """Robust grain of a difference image from every fourth pixel."""
    picked = F.filter(diff, lambda v, i: (F.floor(i / F.lit(cols)) % 4 == 0) & ((i % cols) % 4 == 0))
    return p.mad_scale * median_of(F.transform(picked, F.abs))


def effective_threshold(noise: Column, p: Detect = DETECT) -> Column:
    return F.greatest(F.lit(p.optical_threshold), p.noise_sigma * noise)


#: Frames of up to so many fragments are compared in plain numbers, as arrays cost more to make than to fill.
FEW_FRAGMENTS = 24


def _joined_few(x: list, y: list, w: list, h: list, area: list, frame_w: int, frame_h: int, p: Detect) -> list[list[int]]:
    """`joined_fragments` of a few fragments without missing numbers."""
    n = len(x)
    x1, y1 = [a + b for a, b in zip(x, w)], [a + b for a, b in zip(y, h)]
    members: list[list[int] | None] = [[i] for i in range(n)]
    most = p.max_box_frac * frame_w * frame_h

    def fits(i: int, j: int) -> bool:
        ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = x[i], y[i], x1[i], y1[i], x[j], y[j], x1[j], y1[j]
        gap = max((ax0 if ax0 > bx0 else bx0) - (ax1 if ax1 < bx1 else bx1), (ay0 if ay0 > by0 else by0) - (ay1 if ay1 < by1 else by1))
        if gap > 0 and gap > p.optical_gap_px and gap > p.optical_gap_frac * max(bx1 - bx0, by1 - by0, ax1 - ax0, ay1 - ay0):
            return False
        uw = (ax1 if ax1 > bx1 else bx1) - (ax0 if ax0 < bx0 else bx0)
        uh = (ay1 if ay1 > by1 else by1) - (ay0 if ay0 < by0 else by0)
        box = uw * uh
        if not 0 < box <= most or max(uw, uh) / max(min(uw, uh), 1) > p.max_side_ratio:
            return False
        return (area[j] + area[i]) / max(box, 1e-9) >= p.min_fill

    i = 0
    while i < n:
        other = -1 if members[i] is None else next((j for j in range(n) if j != i and members[j] is not None and fits(i, j)), -1)
        if other < 0:
            i += 1
            continue
        keep, gone = min(i, other), max(i, other)
        x[keep], y[keep] = min(x[keep], x[gone]), min(y[keep], y[gone])
        x1[keep], y1[keep] = max(x1[keep], x1[gone]), max(y1[keep], y1[gone])
        area[keep] += area[gone]
        members[keep] += members[gone]
        members[gone] = None
        i = keep
    return [m for m in members if m is not None]


def joined_fragments(x, y, w, h, area, frame_w: int, frame_h: int, p: Detect = DETECT) -> list[list[int]]:
    """Which fragments of one frame belong together: always the first fitting pair in list order joins next.

    A join changes one group only, so only that group is compared again.
    """
    if len(x) == 1:
        return [[0]]
    if len(x) <= FEW_FRAGMENTS:
        plain = [np.asarray(v, float).tolist() for v in (x, y, w, h, area)]
        if all(e == e for v in plain for e in v):
            return _joined_few(*plain, frame_w, frame_h, p)
    x0, y0 = np.asarray(x, float).copy(), np.asarray(y, float).copy()
    x1, y1 = x0 + np.asarray(w, float), y0 + np.asarray(h, float)
    size = np.asarray(area, float).copy()
    alive = np.ones(len(x0), bool)
    members = [[i] for i in range(len(x0))]

    def partners(i: int) -> np.ndarray:
        gap = np.maximum(np.maximum(x0, x0[i]) - np.minimum(x1, x1[i]), np.maximum(y0, y0[i]) - np.minimum(y1, y1[i]))
        span = np.maximum(np.maximum(x1 - x0, y1 - y0), max(x1[i] - x0[i], y1[i] - y0[i]))
        near = np.maximum(gap, 0) <= np.maximum(p.optical_gap_px, p.optical_gap_frac * span)
        uw = np.maximum(x1, x1[i]) - np.minimum(x0, x0[i])
        uh = np.maximum(y1, y1[i]) - np.minimum(y0, y0[i])
        box = uw * uh
        sane = (box > 0) & (box <= p.max_box_frac * frame_w * frame_h)
        slim = np.maximum(uw, uh) / np.maximum(np.minimum(uw, uh), 1) <= p.max_side_ratio
        full = (size + size[i]) / np.maximum(box, 1e-9) >= p.min_fill
        ok = alive & near & sane & slim & full
        ok[i] = False
        return np.flatnonzero(ok)

    i = 0
    while i < len(x0):
        if not alive[i]:
            i += 1
            continue
        found = partners(i)
        if len(found) == 0:
            i += 1
            continue
        # An earlier group that now fits takes this one; otherwise the next one in line joins.
        keep, gone = (int(found[0]), i) if found[0] < i else (i, int(found[0]))
        x0[keep], y0[keep] = min(x0[keep], x0[gone]), min(y0[keep], y0[gone])
        x1[keep], y1[keep] = max(x1[keep], x1[gone]), max(y1[keep], y1[gone])
        size[keep] += size[gone]
        members[keep] += members[gone]
        alive[gone] = False
        i = keep
    return [m for m, a in zip(members, alive) if a]


def merged_fragments(dets: DataFrame, frame_w: int, frame_h: int, p: Detect = DETECT) -> DataFrame:
    """Optical fragments joined into objects: the largest part leads, areas add up.

    Detection bounds a frame: blobs do not overlap and have a least area, so a frame has at
    most ``frame_w * frame_h / optical_min_area`` of them.
    """
    rest = [c for c in dets.columns if c not in ("site_id", "frame_idx", "det_id")]
    frames = dets.groupBy("site_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("det_id", *rest))).alias("_d"))

    @F.pandas_udf("array<array<int>>")
    def parts(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, area: pd.Series) -> pd.Series:
        return pd.Series([joined_fragments(*r, frame_w, frame_h, p) for r in zip(x, y, w, h, area)])

    lone = F.size("_d") == 1
    cols = [F.col(f"_d.{c}") for c in ("x", "y", "w", "h", "area")]
    split = frames.filter(lone).withColumn("_g", F.array(F.array(F.lit(0)))).unionByName(
        frames.filter(~lone).withColumn("_g", parts(*cols))
    )

    def whole(members: Column) -> Column:
        x0, y0 = F.array_min(F.transform(members, lambda m: m["x"])), F.array_min(F.transform(members, lambda m: m["y"]))
        x1 = F.array_max(F.transform(members, lambda m: m["x"] + m["w"]))
        y1 = F.array_max(F.transform(members, lambda m: m["y"] + m["h"]))
        area = F.aggregate(members, F.lit(0.0), lambda a, m: a + m["area"])
        lead = F.array_max(F.transform(members, lambda m: F.struct(m["area"], (-m["det_id"]).alias("o"), m.alias("m"))))["m"]
        single = F.size(members) == 1
        return F.struct(
            lead["det_id"].alias("det_id"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"), area.alias("area"),
            F.when(single, lead["cx"]).otherwise(x0 + (x1 - x0) / 2.0).alias("cx"),
            F.when(single, lead["cy"]).otherwise(y0 + (y1 - y0) / 2.0).alias("cy"),
            F.size(members).alias("fragments"),
        )

    objects = F.transform("_g", lambda g: let(F.transform(g, lambda i: F.get(F.col("_d"), i)), whole))
    return split.select("site_id", "frame_idx", F.explode(objects).alias("o")).select("site_id", "frame_idx", "o.*")


def within_footprint(frames: DataFrame, homography: DataFrame, s: Sensor = SENSOR, p: Detect = DETECT) -> DataFrame:
    """Optical frames with the ``roi`` of their site from ``homography(site_id, h)``; null, so the whole frame, where there is none."""
    known = homography.select("site_id", footprint(F.col("h"), s, p).alias("roi"))
    return frames.join(known, "site_id", "left")


def footprint(h: Column, s: Sensor = SENSOR, p: Detect = DETECT) -> Column:
    """Part of the optical frame the thermal camera can check, as a struct of bounds; null where they do not meet."""
    w, t = float(s.cols), float(s.rows)
    corners = [(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (w, 0.0), (w, t), (0.0, t))]
    xs, ys = [G.map_x(h, x, y) for x, y in corners], [G.map_y(h, x, y) for x, y in corners]
    whole = lambda v: v.cast("long").cast("double")
    x0, y0 = F.greatest(F.lit(0.0), whole(F.least(*xs)) - p.roi_pad_px), F.greatest(F.lit(0.0), whole(F.least(*ys)) - p.roi_pad_px)
    x1 = F.least(F.lit(float(s.optical_cols)), whole(F.greatest(*xs)) + p.roi_pad_px)
    y1 = F.least(F.lit(float(s.optical_rows)), whole(F.greatest(*ys)) + p.roi_pad_px)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))
