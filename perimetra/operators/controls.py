"""Operator actions as rows of the work they touch.

`operator_actions(site_id, frame_idx, t_us, action, key, kind, sensor, alert_id, x, y, w, h, reset)` is one table of what operators did, each
action behind the frame that it names. It is dealt out here to the state machines that have to know: learners, dwell records, names, alerts.
Every deal is a projection or an equi-join on the site, and a control row goes the way of the rows it acts on, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.functions.geometry import Box, inverse, map_box
from perimetra.params import OPTICAL_SITE, THERMAL_SITE, OpticalSite, ThermalSite

#: Actions on one frame are taken in this order, later ones of the same kind by key.
ORDER = ("start_learning", "accept", "clear", "ack", "forget_names", "stop_learning")
BOX = ("x", "y", "w", "h")


def _act() -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), F.col("action")).cast("int"), F.lit(len(ORDER) + 1))


def _spots(y0: Column, y1: Column, x0: Column, x1: Column, cols: int) -> Column:
    """Row-major positions of the cells from (y0, x0) to before (y1, x1)."""
    lines = F.when((y1 > y0) & (x1 > x0), F.sequence(y0, y1 - 1))
    return F.coalesce(
        F.flatten(F.transform(lines, lambda y: F.transform(F.sequence(x0, F.greatest(x1 - 1, x0)), lambda x: y * cols + x))), F.array().cast("array<int>")
    )


def thermal_cells(box: dict[str, Column], p: ThermalSite = THERMAL_SITE) -> Column:
    """Cells under a box in thermal pixels; a box outside takes the nearest border cells."""

    def edge(v: Column, n: int, low: int) -> Column:
        return F.least(F.greatest(F.floor(v / F.lit(p.cell_px)), F.lit(low)), F.lit(n)).cast("int")

    y0, x0 = edge(box["y"], p.grid_rows - 1, 0), edge(box["x"], p.grid_cols - 1, 0)
    y1, x1 = edge(box["y"] + box["h"] + p.cell_px, p.grid_rows, 1), edge(box["x"] + box["w"] + p.cell_px, p.grid_cols, 1)
    return _spots(y0, y1, x0, x1, p.grid_cols)


def optical_cells(box: dict[str, Column], p: OpticalSite = OPTICAL_SITE) -> Column:
    """Cells under a box in optical pixels; none for a box outside."""

    def cell(v: Column) -> Column:
        return F.floor(v.cast("long") / F.lit(p.cell_px)).cast("int")

    zero = F.lit(0)
    y0, x0 = F.greatest(zero, cell(box["y"])), F.greatest(zero, cell(box["x"]))
    y1 = F.least(F.lit(p.grid_rows), cell(box["y"] + box["h"]) + 1)
    x1 = F.least(F.lit(p.grid_cols), cell(box["x"] + box["w"]) + 1)
    return _spots(y0, y1, x0, x1, p.grid_cols)


def _learner_rows(marks: DataFrame, cells: Column) -> DataFrame:
    return marks.select(
        "site_id", "frame_idx", "t_us", "act", F.when(F.col("action") == "start_learning", "reset").otherwise("accept").alias("action"), cells.alias("cells")
    )


def _learner_marks(actions: DataFrame) -> DataFrame:
    starts = (F.col("action") == "start_learning") & F.coalesce("reset", F.lit(True))
    return actions.withColumn("act", _act()).filter(starts | (F.col("action") == "accept"))


def for_thermal(actions: DataFrame, homography: DataFrame | None = None, p: ThermalSite = THERMAL_SITE) -> DataFrame:
    """Actions for the thermal learner: resets, and accepted boxes as cells.

    An object found by the optical sensor has its box in that sensor's pixels: it is taken through the inverse of `homography(site_id, h)`;
    where a site has none (or a singular one) the thermal model is left alone.
    """
    marks = _learner_marks(actions)
    optical = (F.col("action") == "accept") & (F.col("sensor") == "optical")
    own = {k: F.col(k).cast("double") for k in BOX}
    direct = _learner_rows(marks.filter(~F.coalesce(optical, F.lit(False))), F.when(F.col("action") == "accept", thermal_cells(own, p)))
    if homography is None:
        return direct
    seen = marks.filter(optical).join(homography.select("site_id", inverse(F.col("h")).alias("_back")), "site_id").filter("_back IS NOT NULL")
    mapped = map_box(F.col("_back"), Box(*[own[k] for k in BOX]))
    return direct.unionByName(_learner_rows(seen, thermal_cells({k: getattr(mapped, k) for k in BOX}, p)))


def for_optical(actions: DataFrame, p: OpticalSite = OPTICAL_SITE) -> DataFrame:
    """Actions for the optical learner: resets, and boxes accepted in optical pixels."""
    marks = _learner_marks(actions).filter((F.col("action") != "accept") | (F.col("sensor") == "optical"))
    return _learner_rows(marks, F.when(F.col("action") == "accept", optical_cells({k: F.col(k).cast("double") for k in BOX}, p)))


def for_dwell(actions: DataFrame) -> DataFrame:
    """Accepted tracks by number."""
    number = F.regexp_extract("key", r"track:(\d+)$", 1)
    taken = actions.filter((F.col("action") == "accept") & (number != ""))
    return taken.select("site_id", number.cast("long").alias("track_id"), "frame_idx", "t_us", F.lit(1).alias("act"), "action")


def for_contacts(actions: DataFrame) -> DataFrame:
    """Accepted contacts of the optical sensor by key."""
    taken = actions.filter((F.col("action") == "accept") & F.col("key").startswith("optical"))
    return taken.select("site_id", "key", "frame_idx", "t_us", "action")


def for_alerts(assessed: DataFrame, actions: DataFrame) -> DataFrame:
    """Verdicts and, behind them, what ends or acknowledges the alert of their key: accepting an object clears its alert."""
    said = actions.filter(F.col("action").isin("accept", "clear") & F.col("key").isNotNull())
    rows = said.select("site_id", "key", "frame_idx", "t_us", F.lit("clear").alias("action")).distinct()
    return assessed.unionByName(rows, allowMissingColumns=True)


def acks(actions: DataFrame) -> DataFrame:
    return actions.filter((F.col("action") == "ack") & F.col("alert_id").isNotNull()).select("site_id", "alert_id", "t_us")


def forgets(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("action") == "forget_names").select("site_id", "frame_idx", "t_us").distinct()
