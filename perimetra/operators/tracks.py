"""Track features over the last forty observations, and the runs built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.functions import classify as C
from perimetra.functions.geometry import distance
from perimetra.operators.scans import CHUNK, HALO, chunked, running_count, running_max, running_sum, sessions
from perimetra.params import ALERTING, CHUNK_FRAMES, CLASSIFY, FUSION, TRACKING, Alerting, Classify, Fusion, Tracking

TRACK = ["site_id", "track_id"]


def kinematics(obs: DataFrame, p: Tracking = TRACKING, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Add speed, straightness, net travel, flap score, hits and missed frames to each observation."""
    n = p.history
    ch = chunked(obs, TRACK, ["frame_idx"], depth=n, carry={"_seen": ("sum", F.lit(1))}, span=span)
    w = ch.part
    ch = ch.with_columns(
        {
            "_step": distance(F.col("cx"), F.col("cy"), F.lag("cx").over(w), F.lag("cy").over(w)),
            "_prev_frame": F.lag("frame_idx").over(w),
        }
    )
    points, steps = ch.trailing(n - 1), ch.trailing(n - 2)
    ch = ch.with_columns(
        {
            "_n": F.count(F.lit(1)).over(points),
            "_x0": F.first("cx").over(points),
            "_y0": F.first("cy").over(points),
            "_path": F.sum("_step").over(steps),
            "_steps": F.count("_step").over(steps),
            "_mean_area": F.avg("area").over(points),
            "_sd_area": F.stddev_pop("area").over(points),
            "hits": running_count(ch, "_seen"),
        }
    )
    net = distance(F.col("cx"), F.col("cy"), F.col("_x0"), F.col("_y0"))
    path = F.coalesce("_path", F.lit(0.0))
    out = ch.with_columns(
        {
            "speed_px": F.when(F.col("_steps") > 0, path / F.nullif(F.col("_steps"), F.lit(0))).otherwise(0.0),
            "straightness": F.when((F.col("_n") < 3) | (path < 1e-6), 0.0).otherwise(
                net / F.when(path >= 1e-6, path)
            ),
            "displacement_px": F.when(F.col("_n") < 2, 0.0).otherwise(net),
            "flap_score": F.when((F.col("_n") < p.min_flap_obs) | (F.col("_mean_area") <= 0), 0.0).otherwise(
                F.col("_sd_area") / F.when(F.col("_mean_area") > 0, F.col("_mean_area"))
            ),
            "missed": F.coalesce(F.col("frame_idx") - F.col("_prev_frame") - 1, F.lit(0)),
        }
    )
    return out.finish(
        "_seen", "_step", "_prev_frame", "_n", "_x0", "_y0", "_path", "_steps", "_mean_area", "_sd_area"
    )


def classified(tracks: DataFrame, p: Classify = CLASSIFY) -> DataFrame:
    """Add label, confidence and, where one exists, the reason it cannot be an aircraft."""
    c = F.col
    hot = c("peak_c") - c("mean_c")
    is_landed = C.landed(c("aspect"), c("extent"), c("parts"), hot, c("contrast_c"), p)
    drone, bird = C.vote(
        c("flap_score"), hot, c("area"), c("aspect"), c("extent"), c("parts"), c("straightness"), p
    )
    staged = tracks.withColumns(
        {
            "hotspot_c": hot,
            "_landed": is_landed,
            "not_airborne": C.grounded_reason(c("hits"), c("displacement_px"), c("area"), is_landed, p),
            "_drone": drone,
            "_bird": bird,
        }
    )
    answer = C.verdict(
        c("hits"), c("displacement_px"), c("not_airborne"), c("_landed"), c("parts"), c("_drone"), c("_bird"), p
    )
    return (
        staged.withColumn("_v", answer)
        .withColumns({"label": c("_v.label"), "confidence": c("_v.confidence")})
        .drop("_v", "_landed", "_drone", "_bird")
    )


def alert_opens(assessed: DataFrame, p: Alerting = ALERTING, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Add the run of consecutive assessments over the line; a run reaching the limit opens an alert.

    Absence does not break a run, only a row below the line does.
    """
    over = F.col("threat") >= p.threshold
    ch = chunked(assessed, ["site_id", "key"], ["frame_idx"], carry={"_before": ("sum", F.lit(1))}, span=span)
    numbered = ch.with_columns({"_i": running_count(ch, "_before")}).finish("_before")
    below = F.when(~over, F.col("_i"))
    ch = chunked(numbered, ["site_id", "key"], ["frame_idx"], carry={"_low": ("max", below)}, span=span)
    last_low = F.coalesce(running_max(ch, "_low", below), F.lit(0))
    return ch.with_columns({"streak": F.col("_i") - last_low}).finish("_low", "_i").withColumn(
        "opens", F.col("streak") == p.open_after
    )


def contact_dwell(contacts: DataFrame, p: Fusion = FUSION, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """How long each optical contact has been in its place; a gap over the grace starts again."""
    marked = sessions(contacts, ["site_id", "key"], ["frame_idx"], "t_us", p.contact_gap_s * 1e6, "_since", span)
    return marked.withColumn("dwell_s", (F.col("t_us") - F.col("_since")) / 1e6).drop("_since")


def contact_stays(contacts: DataFrame, actions: DataFrame, p: Fusion = FUSION, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """`contact_dwell` where operators take contacts for normal: behind ``actions(site_id, key, frame_idx)`` a contact's stay starts again."""
    keys = ["site_id", "key"]
    marks = actions.select(*keys, "frame_idx").distinct().withColumn("_act", F.lit(1))
    both = contacts.withColumn("_act", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    ch = chunked(both, keys, ["frame_idx", "_act"], carry={"_before": ("sum", F.col("_act"))}, span=span)
    told = ch.with_columns({"_word": running_sum(ch, "_before", F.col("_act"))}).finish("_before").filter("_act = 0").drop("_act")
    marked = sessions(told, [*keys, "_word"], ["frame_idx"], "t_us", p.contact_gap_s * 1e6, "_since", span)
    return marked.withColumn("dwell_s", (F.col("t_us") - F.col("_since")) / 1e6).drop("_since", "_word")


def every_nth(rows: DataFrame, keys: list[str], order: str, n: int, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """The first of every ``n`` rows of a key: how slower stages sample the frame sequence."""
    ch = chunked(rows, keys, [order], carry={"_before": ("sum", F.lit(1))}, span=span)
    return ch.with_columns({"_i": running_count(ch, "_before")}).finish("_before").filter((F.col("_i") - 1) % n == 0).drop("_i")


def carried_forward(
    rows: DataFrame, keys: list[str], order: str, n: int, value: str, out: str, span: int | None = CHUNK_FRAMES
) -> DataFrame:
    """Repeat the value of the last sampled row (one in ``n``) on the rows between samples."""
    ch = chunked(rows, keys, [order], carry={"_before": ("sum", F.lit(1))}, span=span)
    numbered = ch.with_columns({"_i": running_count(ch, "_before")}).finish("_before")
    ch = chunked(numbered, keys, [order], depth=n - 1, span=span) if n > 1 else chunked(numbered, keys, [order], span=span)
    sampled = F.when((F.col("_i") - 1) % n == 0, F.struct(F.col(value).alias("v")))
    held = F.last(sampled, ignorenulls=True).over(ch.trailing(max(n - 1, 0)))
    return ch.with_columns({out: held["v"]}).finish("_i")


def rolling_mean(rows: DataFrame, keys: list[str], order: str, value: str, out: str, n: int = 30, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Mean of the last ``n`` samples, as shown for frame cost and rate.

    Samples count in whole millionths, so that the sum does not depend on the order it is taken in.
    """
    ch = chunked(rows, keys, [order], depth=n - 1, span=span)
    w = ch.trailing(n - 1)
    millionths = F.round(F.col(value) * 1_000_000).cast("long")
    return ch.with_columns({out: F.sum(millionths).over(w) / F.count(value).over(w) / 1e6}).finish()


__all__ = [
    "CHUNK",
    "HALO",
    "alert_opens",
    "carried_forward",
    "classified",
    "contact_dwell",
    "every_nth",
    "kinematics",
    "rolling_mean",
]
