"""One-to-one matching and grouping of boxes inside a frame, the same way for frames of any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions.geometry import distance
from perimetra.operators.scans import keyed_scan


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that spark.checkpoint.dir names; a temporary one is made only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="perimetra-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def greedy_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("site_id", "frame_idx"),
    closest_first: bool = False,
) -> DataFrame:
    """Match ``left(keys, l_id, l_ord, lx, ly, radius)`` to ``right(keys, r_id, r_ord, rx, ry)``.

    In ``l_ord`` order each left object takes the nearest right object still free, closer
    than its radius; with ``closest_first`` the closest pair of the frame goes first (radius
    inclusive). Returns ``keys, l_id, r_id, distance``. The pairs within reach stream through a task in order of
    preference, which holds the ids of one frame that are taken: the same way for frames of any size.
    """
    keys = list(keys)
    pairs = _candidates(left, right, keys, closest_first)
    types = dict(pairs.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"l_id {types['l_id']}", f"r_id {types['r_id']}", "distance double"])
    order = ["d", "l_ord", "r_ord"] if closest_first else ["l_ord", "d", "r_ord"]
    ranked = pairs.select(*keys, "l_id", "r_id", "d", F.struct(*order).alias("_rank"))
    return keyed_scan(ranked, keys, ["_rank"], _FirstCome, schema, drop=["_rank"])


def _candidates(left: DataFrame, right: DataFrame, keys: list[str], closest_first: bool, cell: float = 128.0) -> DataFrame:
    """Pairs within reach, met on the grid cells the left object's reach covers."""

    def at(v: Column) -> Column:
        return F.floor(v / F.lit(cell)).cast("int")

    asks = left.withColumn("_cx", F.explode(F.sequence(at(F.col("lx") - F.col("radius")), at(F.col("lx") + F.col("radius"))))).withColumn(
        "_cy", F.explode(F.sequence(at(F.col("ly") - F.col("radius")), at(F.col("ly") + F.col("radius"))))
    )
    offers = right.withColumns({"_cx": at(F.col("rx")), "_cy": at(F.col("ry"))})
    d = distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))
    within = F.col("d") <= F.col("radius") if closest_first else F.col("d") < F.col("radius")
    met = asks.join(offers, [*keys, "_cx", "_cy"]).withColumn("d", d).filter(within)
    return met.select(*keys, "l_id", "l_ord", "r_id", "r_ord", "d")


class _FirstCome:
    """Takes candidate pairs of one frame in order of preference; holds the ids already matched."""

    def __init__(self) -> None:
        self.left: set = set()
        self.right: set = set()

    def feed(self, c: dict) -> dict:
        kept = []
        for i, (l, r) in enumerate(zip(c["l_id"].tolist(), c["r_id"].tolist())):
            if l not in self.left and r not in self.right:
                self.left.add(l)
                self.right.add(r)
                kept.append(i)
        return {"l_id": c["l_id"][kept], "r_id": c["r_id"][kept], "distance": c["d"][kept]}

    def close(self) -> None:
        return None


def box_groups(boxes: DataFrame, gap: float, keys: Sequence[str] = ("site_id", "frame_idx")) -> DataFrame:
    """Add ``group``: boxes closer than ``gap`` share one, chains included (named by the least ``det_id``).

    A frame is one row, bounded by the pixels of its sensor; inside it boxes meet only those that reach their columns.
    """
    keys = list(keys)
    rest = [c for c in boxes.columns if c not in keys]
    frames = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("det_id", *[c for c in rest if c != "det_id"]))).alias("_b"))

    @F.pandas_udf("array<int>")
    def leaders(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([_leader(*(np.asarray(v, float) for v in box), gap) for box in zip(x, y, w, h)])

    lone = F.size("_b") == 1
    single = frames.filter(lone).withColumn("_i", F.array(F.lit(0)))
    many = frames.filter(~lone).withColumn("_i", leaders(F.col("_b.x"), F.col("_b.y"), F.col("_b.w"), F.col("_b.h")))
    labelled = F.transform("_b", lambda b, i: b.withField("group", F.get(F.col("_b"), F.get("_i", i))["det_id"]))
    out = single.unionByName(many)
    return out.select(*keys, F.explode(labelled).alias("_r")).select(*keys, "_r.*")


def _leader(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, gap: float) -> list[int]:
    """Index of the first box of each box's chain."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    x1, y1 = x + w[order] + gap, y + h[order] + gap
    # those that can touch a box start between its right edge and the widest box's width before its left one
    lo, hi = np.searchsorted(x, x - (x1 - x).max(), side="left"), np.searchsorted(x, x1, side="right")
    chain = np.full(len(x), -1)
    for first in range(len(x)):
        if chain[first] >= 0:
            continue
        chain[first], reach = first, [first]
        while reach:
            i = reach.pop()
            part = slice(lo[i], hi[i])
            near = lo[i] + np.flatnonzero((chain[part] < 0) & (x[i] <= x1[part]) & (y[part] <= y1[i]) & (y[i] <= y1[part]))
            chain[near] = first
            reach.extend(near.tolist())
    least = np.full(len(x), len(x))
    np.minimum.at(least, chain, order)
    out = np.empty(len(x), np.int64)
    out[order] = least[chain]
    return out.tolist()
