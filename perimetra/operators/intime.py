"""Gated learning of a site, spread over time.

One rule couples all cells of a frame, so learning is a fold over the frames of a site. But once it is known which cells were odd in which
frame, the fold is linear: a chunk of frames takes the moments m at its start to D m + B. So the chunks of a site are worked at once from
guessed starts, first those of a clean scene (nothing odd). What they find odd gives each chunk its D and B, these give every chunk its
true start if the findings hold, and only chunks whose findings could differ from the new start are worked again. A chunk keeps the least
distance of any of its decisions from tipping over, which tells most of them apart without a second look. Nothing is left to do when no
decision can change any more; then the starts are those of the fold. Each round makes at least one more chunk of a site final, but where
decisions hang on each other that may be all it does. So once a round leaves more than half of the chunks open, the rest of each site, from
its first open chunk, is worked as one chunk: its start is known, and no frame is worked more often than a few times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perimetra.operators.matching import settled
from perimetra.operators.scans import keyed_scan
from perimetra.operators.site import LEARNED_MODEL, LEARNED_READS, ThermalLearner
from perimetra.operators.site import learn_frames as site_fold
from perimetra.operators.site import learn_model as site_fold_model
from perimetra.params import THERMAL_SITE, ThermalSite

#: Frames of one chunk: at 24 x 32 cells some 6 MB of readings against 50 kB of summary.
SPAN = 1024
KEYS = ["site_id", "chunk"]
ARRAYS = ("first", "second", "taken", "streak")
HEAD = "site_id long, chunk long, frames_before long, " + ", ".join(f"{a} array<double>" for a in ARRAYS)
#: Of a chunk: frames, what is left of the start (keep), what is added to both moments and to the readings taken, the sum of the steps of
#: the persistence counter and its value after a start at minus infinity, the start that was used, the least margin and the largest mean.
WORKED = (
    "site_id long, chunk long, frames long, keep array<double>, add_first array<double>, add_second array<double>, took array<double>, "
    "steps array<double>, least array<double>, from_first array<double>, from_second array<double>, from_taken array<double>, "
    "margin array<double>, top array<double>"
)
FAR = -float(1 << 40)


class Surveyed(ThermalLearner):
    """The learner from a given start; keeps what it does to any start, and how near its decisions were."""

    def begin(self, first: np.ndarray, second: np.ndarray, taken: np.ndarray, streak: np.ndarray, frames: int) -> None:
        self.moments, self.taken, self.streak, self.frames = np.stack([first, second]), taken.copy(), streak.copy(), frames
        n = len(first)
        self.keep, self.steps, self.least = np.ones(n), np.zeros(n), np.full(n, FAR)
        self.margin, self.top, self.worked = np.full(n, np.inf), np.zeros(n), 0

    def _warm_up(self, x: np.ndarray) -> list[tuple]:
        if len(x):
            self.keep = self.keep * (self.taken / (self.taken + len(x)))
            self._stepped(np.zeros(x.shape[1], bool), len(x))
        return super()._warm_up(x)

    def _noted(self, dev: np.ndarray, spread: np.ndarray, known: np.ndarray, odd: np.ndarray, share: np.ndarray) -> None:
        gap = np.abs(np.abs(dev) - np.maximum(self.p.z_enter * spread, self.p.min_dev_c))
        self.margin = np.where(known, np.minimum(self.margin, gap), self.margin)
        self.top = np.maximum(self.top, np.abs(self.moments[0]))
        self.keep = self.keep * (1 - share)
        self._stepped(odd, 1)

    def _stepped(self, odd: np.ndarray, times: int) -> None:
        step = np.where(odd, 1, -self.p.persist_decay) * times
        self.steps = self.steps + step
        self.least = np.maximum(self.least + step, 0)
        self.worked += times


class _Chunk:
    """One chunk behind its head row, which has frame_idx null and the start."""

    def __init__(self, p: ThermalSite, told: bool) -> None:
        self.told, self.work = told, Surveyed(p, final=not told)

    def feed(self, c: dict) -> dict | None:
        if c["head"][0]:
            self.start = [np.asarray(c[a][0], float) for a in ARRAYS]
            self.work.begin(*self.start[:3], self.start[3].astype(np.int64), int(c["frames_before"][0]))
            c = {k: v[1:] for k, v in c.items()}
            if not len(c["rel"]):
                return None
        return self.work.feed({"frame_idx": c["frame_idx"], "rel": c["rel"]})

    def close(self) -> dict | None:
        if self.told or not self.work.worked:
            return None
        w, (first, second, taken, _) = self.work, self.start
        out = {
            "frames": w.worked,
            "keep": w.keep,
            "add_first": w.moments[0] - w.keep * first,
            "add_second": w.moments[1] - w.keep * second,
            "took": w.taken - taken,
            "steps": w.steps,
            "least": w.least,
            "from_first": first,
            "from_second": second,
            "from_taken": taken,
            "margin": w.margin,
            "top": w.top,
        }
        return {k: [v] for k, v in out.items()}


class _Clean:
    """A chunk in which nothing is odd: one weighted sum of its frames."""

    def __init__(self, p: ThermalSite) -> None:
        self.p, self.seen, self.sums = p, 0, None

    def feed(self, c: dict) -> None:
        x = np.array([np.asarray(r, float) for r in c["rel"]])
        if self.sums is None:
            self.sums, self.keep = np.zeros((2, x.shape[1])), 1.0
        n = int(c["frames_before"][0]) + self.seen + np.arange(1, len(x) + 1)
        left = 1 - np.maximum(1 / n, self.p.alpha_floor)
        after = np.append(np.cumprod(left[::-1])[::-1][1:], 1.0)
        weights = (1 - left) * after
        self.sums = self.sums * left.prod() + np.stack([weights @ x, weights @ (x * x)])
        self.keep *= left.prod()
        self.seen += len(x)

    def close(self) -> dict | None:
        n = self.sums.shape[1]
        zero, full = np.zeros(n), np.full
        values = [self.seen, full(n, self.keep), *self.sums, full(n, float(self.seen)), zero, zero, zero, zero, zero, full(n, -1.0), zero]
        return {part.split()[0]: [v] for part, v in zip(WORKED.split(", ")[2:], values)}


class _Chain:
    """The starts of a site's chunks in order, from what each chunk does to its start; `dirty`: a decision may differ from this start."""

    def __init__(self, p: ThermalSite) -> None:
        self.p, self.state, self.frames = p, None, 0

    def feed(self, c: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("chunk", "frames_before", *ARRAYS, "dirty")}
        for i in range(len(c["chunk"])):
            v = {k: np.asarray(c[k][i], float) for k in c if k not in ("site_id", "chunk", "frames")}
            if self.state is None:
                self.state = [np.zeros(len(v["keep"])) for _ in ARRAYS]
            first, second, taken, streak = self.state
            for k, x in zip(out, (c["chunk"][i], self.frames, first, second, taken, streak, self._open(v, first, second, taken))):
                out[k].append(x)
            self.state = [
                v["keep"] * first + v["add_first"],
                v["keep"] * second + v["add_second"],
                taken + v["took"],
                np.maximum(streak + v["steps"], v["least"]),
            ]
            self.frames += int(c["frames"][i])
        return out

    def _open(self, v: dict, first: np.ndarray, second: np.ndarray, taken: np.ndarray) -> bool:
        by_first, by_second = np.abs(first - v["from_first"]), np.abs(second - v["from_second"])
        # a start off by this much moves the deviation and the threshold of any frame of the chunk by no more
        moved = by_first + self.p.z_enter / (2 * self.p.noise_floor_c) * (by_second + by_first * (2 * v["top"] + by_first))
        counted = max(self.p.min_learned, 1 / self.p.alpha_floor)
        young = (taken != v["from_taken"]) & (np.minimum(taken, v["from_taken"]) < counted)
        return bool(np.any((moved >= v["margin"]) & (moved > 0) | (v["margin"] < 0)) or np.any(young))

    def close(self) -> None:
        return None


class _Last(_Chain):
    """What a site has learned at the end of all chunks."""

    def feed(self, c: dict) -> None:
        super().feed(c)

    def close(self) -> dict:
        first, second, taken, _ = self.state
        return {"frames": [self.frames], "ref_mean": [first], "ref_var": [np.clip(second - first * first, 0.0, None)], "ref_n": [taken]}


def _chained(worked: DataFrame, p: ThermalSite) -> DataFrame:
    return keyed_scan(worked, ["site_id"], ["chunk"], lambda: _Chain(p), HEAD + ", dirty boolean")


def _worked(frames: DataFrame, heads: DataFrame, p: ThermalSite, schema: str, told: bool) -> DataFrame:
    """Work the chunks that have a head."""
    rows = frames.join(heads.select(*KEYS), KEYS, "left_semi").withColumn("head", F.lit(False))
    both = rows.unionByName(heads.drop("dirty").withColumn("head", F.lit(True)), allowMissingColumns=True)
    ordered = both.withColumn("at", F.when(~F.col("head"), F.col("frame_idx")))
    return keyed_scan(ordered, KEYS, ["at"], lambda: _Chunk(p, told), schema, drop=["at"])


def _by_chunk(frames: DataFrame, span: int) -> DataFrame:
    """Frames cut by their site's clock into stretches that hold about ``span`` frames, however far apart these are."""
    f = F.col("frame_idx")
    clock = frames.groupBy("site_id").agg(F.min(f).alias("_lo"), F.max(f).alias("_hi"), F.count(f).alias("_n"))
    width = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo") + 1) / F.col("_n")) * span
    cut = F.floor((f - F.col("_lo")) / width).cast("long").alias("chunk")
    return frames.join(clock, "site_id").select("site_id", "frame_idx", "rel", cut)


def _rounds(frames: DataFrame, p: ThermalSite, span: int) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """(frames by chunk, what chunks do, their starts) after each round; the last are those of the fold."""
    by_chunk = _by_chunk(frames, span)
    sizes = by_chunk.groupBy(*KEYS).count()
    before = Window.partitionBy("site_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = sizes.select(*KEYS, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("frames_before"))
    clean = keyed_scan(by_chunk.join(counted, KEYS), KEYS, ["frame_idx"], lambda: _Clean(p), WORKED)
    done = settled(clean)
    starts = settled(_chained(done, p))
    before = None
    while True:
        yield by_chunk, done, starts
        dirty = starts.filter("dirty")
        still = dirty.count()
        if not still:
            return
        if before is not None and 2 * still > before:
            # A chunk's start is that of the fold if none before it is open.
            tail = dirty.groupBy("site_id").agg(F.min("chunk").alias("_open"))
            joined = by_chunk.join(tail, "site_id", "left")
            by_chunk = joined.withColumn("chunk", F.least("chunk", "_open")).drop("_open")
            dirty = dirty.join(tail, "site_id").filter("chunk = _open").drop("_open")
            done = done.join(tail, "site_id", "left").filter("_open IS NULL OR chunk <= _open").drop("_open")
        before = still
        again = _worked(by_chunk, dirty, p, WORKED, told=False)
        done = settled(done.join(dirty.select(*KEYS), KEYS, "left_anti").unionByName(again))
        starts = settled(_chained(done, p))


def _one_chunk(frames: DataFrame, span: int) -> bool:
    """No site has more frames than a chunk may hold, so that a task a site is all there is to spread."""
    return frames.groupBy("site_id").count().filter(F.col("count") > span).isEmpty()


def learn_frames(frames: DataFrame, p: ThermalSite = THERMAL_SITE, span: int = SPAN) -> DataFrame:
    """`site.learn_frames` (without an operator's actions) with the frames of one site worked in many tasks: the same readings, up to rounding."""
    if _one_chunk(frames, span):
        return site_fold(frames, p)
    for by_chunk, _, starts in _rounds(frames, p, span):
        pass
    told = _worked(by_chunk, starts, p, LEARNED_READS.replace("site_id long, ", "site_id long, chunk long, "), told=True)
    return told.drop("chunk")


def learn_model(frames: DataFrame, p: ThermalSite = THERMAL_SITE, span: int = SPAN) -> DataFrame:
    """`site.learn_model` with the frames of one site worked in many tasks."""
    if _one_chunk(frames, span):
        return site_fold_model(frames, p)
    for _, done, _ in _rounds(frames, p, span):
        pass
    return keyed_scan(done, ["site_id"], ["chunk"], lambda: _Last(p), LEARNED_MODEL)


def rounds_needed(frames: DataFrame, p: ThermalSite = THERMAL_SITE, span: int = SPAN) -> list[int]:
    """How many chunks were still open after each round; the last is 0."""
    return [starts.filter("dirty").count() for _, _, starts in _rounds(frames, p, span)]
