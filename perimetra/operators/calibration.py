"""Fitting and judging the map between the two cameras from noisy point pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimetra.functions.geometry import distance, map_x, map_y
from perimetra.operators.scans import chunked, keyed_scan, numbered
from perimetra.params import CHUNK_FRAMES, RIG, SENSOR, Rig, Sensor


def pair_error(h: Column) -> Column:
    """How far a mapped thermal point lands from its optical partner, in optical pixels."""
    return distance(map_x(h, F.col("tx"), F.col("ty")), map_y(h, F.col("tx"), F.col("ty")), F.col("ox"), F.col("oy"))


def reprojection(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Mean and worst error of each site's map over its pairs."""
    return (
        pairs.join(maps.select("site_id", "h"), "site_id")
        .groupBy("site_id")
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg(pair_error(F.col("h"))).alias("mean_px"), F.max(pair_error(F.col("h"))).alias("max_px"))
    )


def manual_ok(errors: DataFrame, p: Rig = RIG) -> DataFrame:
    """Hand-clicked calibrations good enough to save."""
    return errors.filter((F.col("pairs") >= 4) & (F.col("mean_px") < p.manual_px))


def corner_disagreement(h: Column, other: Column, rows: int, cols: int) -> Column:
    """Mean distance between where two maps send the corners of the frame."""
    total = F.lit(0.0)
    for x, y in ((0, 0), (cols, 0), (cols, rows), (0, rows)):
        cx, cy = F.lit(float(x)), F.lit(float(y))
        total = total + distance(map_x(h, cx, cy), map_y(h, cx, cy), map_x(other, cx, cy), map_y(other, cx, cy))
    return total / 4.0


def spread(pairs: DataFrame, p: Rig = RIG, s: Sensor = SENSOR) -> DataFrame:
    """Is each site's point cloud wide enough, and not a line?"""
    x, y = F.col("tx"), F.col("ty")
    a = pairs.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("points"),
        ((F.max(x) - F.min(x)) / F.lit(float(s.cols))).alias("across"),
        ((F.max(y) - F.min(y)) / F.lit(float(s.rows))).alias("down"),
        F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_cxy"),
    )
    half, diff = (F.col("_vx") + F.col("_vy")) / 2.0, (F.col("_vx") - F.col("_vy")) / 2.0
    least = half - F.sqrt(diff * diff + F.col("_cxy") * F.col("_cxy"))
    minor = F.sqrt(F.greatest(least, F.lit(0.0))) / F.lit(float(min(s.rows, s.cols)))
    wide = (F.col("across") >= p.min_bbox) & (F.col("down") >= p.min_bbox)
    return a.withColumn("minor", minor).withColumn(
        "spread_ok", (F.col("points") >= 4) & wide & (F.col("minor") >= p.min_minor)
    ).drop("_vx", "_vy", "_cxy")


def without_scenery(dets: DataFrame, cell: int, p: Rig = RIG, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Drop detections in cells occupied in nearly all of the last sampled frames.

    ``dets(site_id, tick, cx, cy)``: ``tick`` numbers a site's sampled frames without holes.
    """
    place = F.struct(
        F.floor(F.col("cx").cast("long") / F.lit(cell)).alias("gx"), F.floor(F.col("cy").cast("long") / F.lit(cell)).alias("gy")
    )
    rows = dets.withColumn("_cell", place)
    occupied = rows.select("site_id", "_cell", "tick").distinct()
    # At most one row per tick, so the window's rows are at most its ticks.
    ch = chunked(occupied, ["site_id", "_cell"], ["tick"], depth=p.scenery_window, span=span)
    recent = ch.part.rangeBetween(-(p.scenery_window - 1), 0)
    counts = ch.with_columns({"_seen": F.count(F.lit(1)).over(recent)}).finish()
    frames = F.least(F.col("tick"), F.lit(p.scenery_window))
    fixed = counts.filter((frames >= p.scenery_warmup) & (F.col("_seen") >= p.scenery_share * frames)).select("site_id", "_cell", "tick")
    return rows.join(fixed, ["site_id", "_cell", "tick"], "left_anti").drop("_cell")


def few_together(thermal: DataFrame, optical: DataFrame, p: Rig = RIG) -> DataFrame:
    """Each row of one camera beside each of the other's, for the site's ticks at which both see something, but few.

    Both cameras' rows are shuffled once, by tick, and counted where they meet. Rows of a busy tick go to disk, not to memory;
    only ticks with few rows become lists.
    """
    on = ["site_id", "tick"]

    def packed(df: DataFrame, name: str) -> DataFrame:
        known = F.col("site_id").isNotNull() & F.col("tick").isNotNull()
        return df.filter(known).select(*on, F.struct(*[c for c in df.columns if c not in on]).alias(name))

    at = Window.partitionBy(*on)
    rows = packed(thermal, "_t").unionByName(packed(optical, "_o"), allowMissingColumns=True)
    seen = rows.withColumns({"_nt": F.count("_t").over(at), "_no": F.count("_o").over(at)})
    few = seen.filter(F.col("_nt").between(1, p.thermal_per_frame) & F.col("_no").between(1, p.optical_per_frame))
    met = few.groupBy(*on).agg(F.collect_list("_t").alias("_t"), F.collect_list("_o").alias("_o"))
    return met.select(*on, F.explode("_t").alias("_t"), "_o").select(*on, "_t", F.explode("_o").alias("_o")).select(*on, "_t.*", "_o.*")


def mover_pairs(thermal: DataFrame, optical: DataFrame, p: Rig = RIG) -> DataFrame:
    """Candidate pairs of frames with few movers in both cameras (at most two by three a frame)."""
    on = ["site_id", "tick"]
    t = thermal.select(*on, F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    o = optical.select(*on, F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    return few_together(t, o, p)


def settled_pairs(statics: DataFrame, regions: DataFrame, p: Rig = RIG) -> DataFrame:
    """First sight of each pair of settled objects, up to a fixed number per site."""
    on = ["site_id", "tick"]
    t = statics.select(*on, F.col("key").alias("t_key"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    o = regions.select(*on, F.col("key").alias("o_key"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    first = few_together(t, o, p).groupBy("site_id", "t_key", "o_key").agg(F.min(F.struct("tick", "tx", "ty", "ox", "oy")).alias("f")).select(
        "site_id", "t_key", "o_key", "f.*"
    )
    w = Window.partitionBy("site_id").orderBy("tick", "t_key", "o_key")
    return first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= p.settled_pairs).drop("_n")


def newest_pairs(pairs: DataFrame, p: Rig = RIG) -> DataFrame:
    """The most recent evidence a fit may use, per site."""
    w = Window.partitionBy("site_id").orderBy(F.desc("tick"), F.desc("pair_id"))
    return pairs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= p.max_pairs).drop("_n")


def ticks(frames: DataFrame, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Number a site's sampled frames 1, 2, 3 without holes."""
    return numbered(frames.select("site_id", "frame_idx").distinct(), ["site_id"], ["frame_idx"], "tick", span)


class LastTaken:
    """Keeps the places of the last tick taken; a tick is taken if one of its places is at least ``apart`` from all of those."""

    def __init__(self, apart: float):
        self.apart = apart
        self.places: np.ndarray | None = None

    def feed(self, c: dict) -> dict:
        taken = []
        for tick, at in zip(c["tick"].tolist(), c["at"]):
            now = np.array([[a["cx"], a["cy"]] for a in at], dtype=float)
            if self.places is not None and not (np.hypot(*(now[:, None] - self.places[None]).transpose(2, 0, 1)).min(1) >= self.apart).any():
                continue
            self.places = now
            taken.append(tick)
        return {"tick": np.asarray(taken, np.int64)}

    def close(self) -> None:
        return None


def fresh_samples(dets: DataFrame, p: Rig = RIG) -> DataFrame:
    """Ticks where some detection stands apart from all of the last tick that was taken; the first one always counts.

    ``dets`` holds the ticks that passed the tests before this one, with few detections each.
    """
    rows = dets.groupBy("site_id", "tick").agg(F.collect_list(F.struct("cx", "cy")).alias("at"))
    schema = f"site_id {dict(dets.dtypes)['site_id']}, tick {dict(dets.dtypes)['tick']}"
    return keyed_scan(rows, ["site_id"], ["tick"], lambda: LastTaken(p.dedupe_px), schema)


def _solve(t: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Exact maps of many 4-point sets at once: ``t, o`` are (m, 4, 2); bad sets give NaN."""
    m = len(t)
    a, b = np.zeros((m, 8, 8)), np.zeros((m, 8, 1))
    x, y, u, v = t[:, :, 0], t[:, :, 1], o[:, :, 0], o[:, :, 1]
    a[:, ::2, 0], a[:, ::2, 1], a[:, ::2, 2] = x, y, 1.0
    a[:, 1::2, 3], a[:, 1::2, 4], a[:, 1::2, 5] = x, y, 1.0
    a[:, ::2, 6], a[:, ::2, 7], a[:, 1::2, 6], a[:, 1::2, 7] = -u * x, -u * y, -v * x, -v * y
    b[:, ::2, 0], b[:, 1::2, 0] = u, v
    good = np.abs(np.linalg.det(a)) > 1e-6
    h = np.full((m, 9), np.nan)
    if good.any():
        h[good, :8] = np.linalg.solve(a[good], b[good])[:, :, 0]
        h[good, 8] = 1.0
    return h


def _errors(h: np.ndarray, t: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Error of each pair under each map: (m, n)."""
    with np.errstate(all="ignore"):
        d = h[:, 6:7] * t[:, 0] + h[:, 7:8] * t[:, 1] + h[:, 8:9]
        u = (h[:, 0:1] * t[:, 0] + h[:, 1:2] * t[:, 1] + h[:, 2:3]) / d
        v = (h[:, 3:4] * t[:, 0] + h[:, 4:5] * t[:, 1] + h[:, 5:6]) / d
        return np.nan_to_num(np.hypot(u - o[:, 0], v - o[:, 1]), nan=np.inf)


def _refit(t: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Least-squares map of all given pairs, on centred and scaled points."""

    def scaling(p: np.ndarray) -> np.ndarray:
        c, s = p.mean(0), max(p.std(), 1e-9)
        return np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])

    st, so = scaling(t), scaling(o)
    one = np.ones((len(t), 1))
    x, u = np.hstack([t, one]) @ st.T, np.hstack([o, one]) @ so.T
    zero = np.zeros_like(x)
    top = np.hstack([x, zero, -u[:, :1] * x])
    low = np.hstack([zero, x, -u[:, 1:2] * x])
    h = np.linalg.inv(so) @ np.linalg.svd(np.vstack([top, low]))[2][-1].reshape(3, 3) @ st
    return (h / h[2, 2]).ravel()


def fit(pairs: DataFrame, p: Rig = RIG, seed: int = 17, blocks: int = 16) -> DataFrame:
    """Robust map per site from ``pairs(site_id, tick, pair_id, tx, ty, ox, oy)``.

    Samples of four pairs are tried in blocks, spread over the cluster; the best sample of
    each site is refitted on the pairs that agree with it. A fixed seed repeats the result.
    """
    pair = F.struct("pair_id", "tick", "tx", "ty", "ox", "oy")
    sites = newest_pairs(pairs, p).groupBy("site_id").agg(F.sort_array(F.collect_list(pair)).alias("pts")).filter(F.size("pts") >= 4)
    jobs = sites.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition("site_id", "block")
    each = max(1, p.ransac_iters // blocks)

    def points(rows: list) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[r["tx"], r["ty"]] for r in rows]), np.array([[r["ox"], r["oy"]] for r in rows])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for site, rows, block in zip(batch["site_id"], batch["pts"], batch["block"]):
                t, o = points(rows)
                rng = np.random.default_rng([seed, int(block)])
                pick = np.arange(4)[None] if len(t) == 4 else rng.random((each, len(t))).argpartition(3, axis=1)[:, :4]
                h = _solve(t[pick], o[pick])
                hits = (_errors(h, t, o) < p.ransac_px).sum(1)
                i = int(hits.argmax())
                yield pd.DataFrame({"site_id": [site], "block": [block], "inliers": [int(hits[i])], "h": [h[i].tolist()]})

    kind = dict(pairs.dtypes)["site_id"]
    found = jobs.mapInPandas(search, f"site_id {kind}, block int, inliers long, h array<double>")
    best = found.groupBy("site_id").agg(F.max_by("h", F.struct(F.col("inliers"), (-F.col("block")).alias("b"))).alias("h"))

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for site, rows, h in zip(batch["site_id"], batch["pts"], batch["h"]):
                t, o = points(rows)
                h = np.asarray(h)
                keep = _errors(h[None], t, o)[0] < p.ransac_px
                if not np.isnan(h).any() and keep.sum() > 4:
                    h = _refit(t[keep], o[keep])
                err = _errors(h[None], t[keep], o[keep])[0]
                yield pd.DataFrame(
                    {
                        "site_id": [site], "h": [h.tolist()], "pairs": [len(t)], "inliers": [int(keep.sum())],
                        "frames": [len({r["tick"] for r, k in zip(rows, keep) if k})],
                        "mean_px": [float(err.mean()) if len(err) else None],
                        "kept": [[{"tx": float(a), "ty": float(b)} for a, b in t[keep]]],
                    }
                )

    schema = (
        f"site_id {kind}, h array<double>, pairs long, inliers long, frames long, mean_px double, kept array<struct<tx: double, ty: double>>"
    )
    return sites.join(best, "site_id").mapInPandas(refine, schema)


def accepted(fits: DataFrame, p: Rig = RIG, s: Sensor = SENSOR) -> DataFrame:
    """Fits to be trusted: enough agreeing pairs, from enough frames, spread out, and close."""
    clouds = spread(fits.select("site_id", F.explode("kept").alias("k")).select("site_id", "k.*"), p, s).select("site_id", "spread_ok")
    c = F.col
    j = fits.join(clouds, "site_id", "left")
    ok = (
        (c("inliers") >= p.min_inliers)
        & (c("frames") >= p.min_frames)
        & F.coalesce(c("spread_ok"), F.lit(False))
        & (c("mean_px") <= p.accept_px)
    )
    return j.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("kept")


__all__ = [
    "accepted", "corner_disagreement", "fit", "fresh_samples", "manual_ok", "mover_pairs", "newest_pairs", "pair_error", "reprojection",
    "settled_pairs", "spread", "ticks", "without_scenery",
]
