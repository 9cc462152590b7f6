"""Stateful results in batch: alerts, dwell, numbers, names, tracks.

The sequential part is a scan per key that streams through sorted partitions. Before it,
each key is cut wherever its state is certain to be empty, so a busy key spreads over
tasks; rows that cannot change the answer are aggregated away first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimetra.functions.geometry import distance
from perimetra.operators.machines import Admission, AlertLife, Dwell, HeldNames, Numbers, Places, RegionNames, RequestDesk, Tracker
from perimetra.operators.scans import asof, chunked, keyed_scan, numbered, running_sum, sessions
from perimetra.params import (
    ALERTING,
    CHUNK_FRAMES,
    ESCALATE,
    FUSION,
    THREAT,
    TRACKING,
    Alerting,
    Escalate,
    Fusion,
    Threat,
    Tracking,
)

DAY_US = 86_400_000_000


def cut_where(rows: DataFrame, keys: list[str], order: list[str], cut: Column, span: int | None) -> DataFrame:
    """Add ``_part``: how many cuts a key has had up to each row."""
    flag = F.when(cut, 1).otherwise(0)
    ch = chunked(rows, keys, order, carry={"_cuts": ("sum", flag)}, span=span)
    return ch.with_columns({"_part": running_sum(ch, "_cuts", flag)}).finish("_cuts")


def _first_frame_after(rows: DataFrame, clock: DataFrame, deadline: str, span_us: int | None) -> DataFrame:
    """Add ``_next`` STRUCT: the first clock frame at or after ``deadline`` (searched backwards in time)."""
    marks = clock.select("site_id", (-F.col("t_us")).alias("_back"), F.col("frame_idx").alias("c_frame"), F.col("t_us").alias("c_us"))
    asks = rows.withColumn("_back", -F.col(deadline))
    return asof(asks, marks, ["site_id"], "_back", "_next", span_us).drop("_back")


def with_absences(
    rows: DataFrame,
    clock: DataFrame,
    gap_us: int,
    span: int | None = CHUNK_FRAMES,
    span_us: int | None = DAY_US,
    sighting: Column | None = None,
    order: tuple[str, ...] = ("frame_idx",),
) -> DataFrame:
    """Add ``away_frame, away_us``: the clock frame that found the key gone ``gap_us`` before this row.

    A row with nothing but its key follows each key's last one, so the final absence shows
    too. Only rows after a long enough silence look the clock up. ``sighting`` says which rows
    show the object; others (an operator's action) only get the absence before them.
    """
    end = clock.groupBy("site_id").agg((F.max("frame_idx") + 1).alias("frame_idx"), (F.max("t_us") + 1).alias("t_us"))
    ends = rows.select("site_id", "key").distinct().join(end, "site_id").withColumns({c: F.lit(0) for c in order if c != "frame_idx"})
    every = rows.unionByName(ends, allowMissingColumns=True)
    seen = F.col("t_us") if sighting is None else F.when(sighting, F.col("t_us"))
    ch = chunked(every, ["site_id", "key"], list(order), carry={"_seen": ("max", seen)}, span=span)
    before = F.max(seen).over(ch.part.rowsBetween(Window.unboundedPreceding, -1))
    last = before if ch.whole else F.greatest(F.col("_seen"), before)
    marked = ch.with_columns({"_due": last + gap_us}).finish("_seen")
    quiet = F.coalesce(F.col("t_us") > F.col("_due"), F.lit(False))
    found = _first_frame_after(marked.filter(quiet), clock, "_due", span_us)
    hit = F.col("_next.c_frame") < F.col("frame_idx")
    late = found.select(
        *marked.columns, F.when(hit, F.col("_next.c_frame")).alias("away_frame"), F.when(hit, F.col("_next.c_us")).alias("away_us")
    )
    rest = marked.filter(~quiet).withColumns({"away_frame": F.lit(None).cast("long"), "away_us": F.lit(None).cast("long")})
    return rest.unionByName(late).drop("_due")


ALERT_COLS = (
    "opened_frame long, opened_us long, updated_us long, closed_us long, frames long, peak_threat double, threat double, "
    "label string, dwell_s double, acked boolean, cleared boolean"
)


def alert_intervals(
    assessed: DataFrame, clock: DataFrame, p: Alerting = ALERTING, span: int | None = CHUNK_FRAMES, span_us: int | None = DAY_US
) -> DataFrame:
    """One row per alert; ``closed_us`` is NULL while it is open.

    ``assessed(site_id, key, frame_idx, t_us, threat, label, dwell_s[, action])``. A key starts
    afresh where it comes back below the line after an absence.
    """
    keep = [c for c in ("site_id", "key", "frame_idx", "t_us", "threat", "label", "dwell_s", "action") if c in assessed.columns]
    # An operator's action comes after the verdict of its frame.
    acts = F.col("action").isNotNull().cast("int") if "action" in keep else F.lit(0)
    order = ["frame_idx", "_act"]
    rows = assessed.select(*keep).withColumn("_act", acts)
    rows = with_absences(rows, clock, int(p.close_after_s * 1e6), span, span_us, F.col("threat").isNotNull(), tuple(order))
    rows = rows.withColumn("closed_us", F.col("away_us").cast("double"))
    # The closing record belongs to the part before the cut, so the cut falls one row later.
    fresh = F.col("away_us").isNotNull() & F.coalesce(F.col("threat") < p.threshold, F.lit(False))
    ch = chunked(rows.withColumn("_fresh", fresh), ["site_id", "key"], order, depth=1, span=span)
    rows = ch.with_columns({"_cut": F.coalesce(F.lag("_fresh").over(ch.part), F.lit(False))}).finish("_fresh")
    rows = cut_where(rows, ["site_id", "key"], order, F.col("_cut"), span).drop("_cut", "away_frame", "away_us")
    schema = f"site_id {dict(assessed.dtypes)['site_id']}, key string, _part long, {ALERT_COLS}"
    return keyed_scan(rows, ["site_id", "key", "_part"], order, lambda: AlertLife(p), schema).drop("_part")


def with_alert_ids(alerts: DataFrame, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Number alerts per site in order of opening."""
    return numbered(alerts, ["site_id"], ["opened_frame", "key"], "alert_id", span)


def acknowledged(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Set ``acked`` on alerts, open or closed, that ``acks(site_id, alert_id, t_us)`` name once they were opened."""
    said = acks.groupBy("site_id", "alert_id").agg(F.max("t_us").alias("_ack_us"))
    known = F.coalesce(F.col("_ack_us") >= F.col("opened_us"), F.lit(False))
    return alerts.join(said, ["site_id", "alert_id"], "left").withColumn("acked", F.col("acked") | known).drop("_ack_us")


def alert_events(alerts: DataFrame) -> DataFrame:
    """The append-only log: one row when an alert opens, one when it closes."""
    opened = alerts.withColumns({"event": F.lit("open"), "at_us": F.col("opened_us")})
    closed = alerts.filter(F.col("closed_us").isNotNull()).withColumns({"event": F.lit("close"), "at_us": F.col("closed_us")})
    return opened.unionByName(closed)


def dwell(tracks: DataFrame, p: Fusion = FUSION, span: int | None = CHUNK_FRAMES, actions: DataFrame | None = None) -> DataFrame:
    """Seconds each track has been still. A step over twice the radius always re-anchors, so it starts a new part.

    With ``actions(site_id, track_id, frame_idx, t_us, act, action)`` a track that an operator accepts starts anew behind that frame.
    """
    keys, order = ["site_id", "track_id"], ["frame_idx"]
    rows = tracks.filter(F.col("hits") >= p.settle_min_hits).select(*keys, "frame_idx", "t_us", "cx", "cy")
    if actions is not None:
        order = ["frame_idx", "act"]
        rows = rows.withColumn("act", F.lit(-1)).unionByName(actions.select(*keys, "t_us", *order, "action"), allowMissingColumns=True)
    ch = chunked(rows, keys, order, depth=1, span=span)
    step = distance(F.col("cx"), F.col("cy"), F.lag("cx").over(ch.part), F.lag("cy").over(ch.part))
    rows = ch.with_columns({"_step": step}).finish()
    rows = cut_where(rows, keys, order, F.coalesce(F.col("_step") > 2 * p.settle_radius_px, F.lit(False)), span).drop("_step")
    schema = "site_id long, track_id long, _part long, frame_idx long, dwell_s double"
    return keyed_scan(rows, [*keys, "_part"], order, lambda: Dwell(p), schema).drop("_part")


def object_numbers(
    assessed: DataFrame, clock: DataFrame, p: Alerting = ALERTING, span: int | None = CHUNK_FRAMES, span_us: int | None = DAY_US
) -> DataFrame:
    """Number of each stay of a key: lowest free one at its site, given back after a long absence.

    Rows shrink to one per stay before the only per-site sequential step.
    """
    gone = int(p.forget_number_s * 1e6) + 1
    rows = with_absences(assessed.select("site_id", "key", "frame_idx", "t_us", F.lit(True).alias("_real")), clock, gone, span, span_us)
    rows = cut_where(rows, ["site_id", "key"], ["frame_idx"], F.col("away_us").isNotNull(), span)
    stays = rows.groupBy("site_id", "key", "_part").agg(
        F.min(F.when(F.col("_real"), F.col("frame_idx"))).alias("start_frame"), F.min("away_frame").alias("_before")
    )
    ended = stays.select("site_id", "key", (F.col("_part") - 1).alias("_part"), F.col("_before").cast("double").alias("release_frame"))
    stays = stays.filter(F.col("start_frame").isNotNull()).drop("_before").join(ended, ["site_id", "key", "_part"], "left")
    schema = "site_id long, key string, start_frame long, number long"
    return keyed_scan(stays.drop("_part"), ["site_id"], ["start_frame", "key"], Numbers, schema)


def escalation_candidates(assessed: DataFrame, p: Escalate = ESCALATE) -> DataFrame:
    """Objects worth a second opinion: alarming, doubtful, or cold and still."""
    c = F.col
    unsure = c("label").isin("unknown", "") | (c("confidence") < p.unsure_conf)
    tracked = (c("threat") >= p.at) | (unsure & (c("threat") >= p.doubt_at))
    cold = F.coalesce(c("found") & ~c("warm") & (c("dwell_s") >= p.cold_dwell_s), F.lit(False))
    return assessed.filter(F.when(c("kind") == "optical", (c("threat") >= p.at) | cold).otherwise((c("kind") == "track") & tracked))


def admitted(candidates: DataFrame, p: Escalate = ESCALATE, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Requests that may go out. A site silent for the whole cooldown starts afresh."""
    rows = candidates.select("site_id", "key", "frame_idx", "t_us")
    cut = sessions(rows, ["site_id"], ["frame_idx", "key"], "t_us", p.cooldown_s * 1e6, "_since", span)
    schema = "site_id long, _since long, key string, frame_idx long, t_us long"
    return keyed_scan(cut, ["site_id", "_since"], ["frame_idx", "key"], lambda: Admission(p), schema).drop("_since")


def request_desk(candidates: DataFrame, replies: DataFrame, p: Escalate = ESCALATE) -> DataFrame:
    """What happens to requests: sent, queued, turned away or answered, as ``(site_id, key, t_us, event)``.

    ``candidates(site_id, key, t_us)`` and ``replies(site_id, key, t_us)`` of a site are one sequence; of one moment replies come first. A site is
    one task, as one service answers it; its rows stream, and what is held is the queue and the keys within their cooldown.
    """
    asks = candidates.select("site_id", "key", "t_us", F.lit(False).alias("reply"))
    both = asks.unionByName(replies.select("site_id", "key", "t_us", F.lit(True).alias("reply")))
    ordered = both.withColumn("_first", (~F.col("reply")).cast("int"))
    schema = "site_id long, key string, t_us long, event string"
    return keyed_scan(ordered, ["site_id"], ["t_us", "_first", "key"], lambda: RequestDesk(p), schema, drop=["_first"])


def held_names(found: DataFrame, p: Fusion = FUSION, span: int | None = CHUNK_FRAMES, forgets: DataFrame | None = None) -> DataFrame:
    """Names in force after each recognition pass. ``forgets(site_id, frame_idx, t_us)``: all models of the site drop theirs behind that pass.

    ``found(site_id, model, frame_idx, t_us, label, confidence, x, y, w, h)``; a recogniser
    reports a bounded number of boxes per pass, and a long silence starts afresh.
    """
    name = F.struct((-F.col("confidence")).alias("_o"), "label", "confidence", "x", "y", "w", "h")
    passes = found.groupBy("site_id", "model", "frame_idx").agg(F.min("t_us").alias("t_us"), F.sort_array(F.collect_list(name)).alias("found"))
    order = ["frame_idx"]
    if forgets is not None:
        models = passes.select("site_id", "model").distinct()
        marks = forgets.select("site_id", "frame_idx", "t_us").join(models, "site_id").withColumn("act", F.lit(1))
        passes = passes.withColumn("act", F.lit(-1)).unionByName(marks, allowMissingColumns=True)
        order = ["frame_idx", "act"]
    cut = sessions(passes, ["site_id", "model"], order, "t_us", p.hold_s * 1e6, "_since", span)
    schema = (
        "site_id long, model string, _since long, frame_idx long, label string, confidence double, "
        "x double, y double, w double, h double, seen_us long"
    )
    return keyed_scan(cut, ["site_id", "model", "_since"], order, lambda: HeldNames(p), schema).drop("_since")


def region_names(regions: DataFrame, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Stable key for each settled region ``(site_id, tick, key, x, y, w, h, dwell_s)``; a skipped tick starts afresh."""
    item = F.struct((-F.col("dwell_s")).alias("_o"), "y", "x", "key", "w", "h")
    ticks = regions.groupBy("site_id", "tick").agg(F.sort_array(F.collect_list(item)).alias("regions"))
    cut = sessions(ticks, ["site_id"], ["tick"], "tick", 1, "_since", span)
    schema = "site_id long, _since long, tick long, minted string, key string"
    return keyed_scan(cut, ["site_id", "_since"], ["tick"], RegionNames, schema).drop("_since")


def tracking_parts(dets: DataFrame, p: Tracking = TRACKING, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Add ``_part``: detections of different parts of a site are never within a track's reach of each other.

    Places are squares as wide as a track's reach; a stay in a place ends after as many empty frames as a track outlives. Stays that touch
    in space and time make a part. Only stays go through one task a site, a row for each; detections are never gathered.
    """
    reach, gap = F.lit(float(p.max_step_px)), p.max_misses + 1
    cell = lambda v: F.floor(F.col(v) / reach).cast("long")
    placed = dets.withColumns({"gx": cell("cx"), "gy": cell("cy")})
    keys = ["site_id", "gx", "gy"]
    stayed = sessions(placed, keys, ["frame_idx", "det_id"], "frame_idx", gap, "_since", span)
    stays = stayed.groupBy(*keys, F.col("_since").alias("start")).agg(F.max("frame_idx").alias("end"))
    schema = "site_id long, gx long, gy long, _since long, label long, became long"
    told = keyed_scan(stays, ["site_id"], ["start", "gx", "gy"], lambda: Places(gap), schema)
    became = told.filter("became IS NOT NULL").select("site_id", "label", "became")
    named = told.filter("became IS NULL").drop("became").join(became, ["site_id", "label"], "left").select(*keys, "_since", F.coalesce("became", "label").alias("_part"))
    return stayed.join(named, [*keys, "_since"]).drop("gx", "gy", "_since")


class _Ranked(Tracker):
    """The tracker with the rank of each detection, by which tracks are numbered afterwards."""

    def feed(self, c: dict) -> dict:
        return {**super().feed(c), "_o": c["_o"]}


def tracked(dets: DataFrame, p: Tracking = TRACKING, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """Track number of each detection ``(site_id, frame_idx, det_id, cx, cy, area)``.

    Parts of a site that no track can join run apart, each a task's own; a site's tracks are then numbered by their first detections.
    """
    rows = dets.select("site_id", "frame_idx", "det_id", "cx", "cy", (-F.col("area")).alias("_o"))
    parts = tracking_parts(rows, p, span)
    schema = f"site_id long, _part long, frame_idx long, det_id long, track_no long, _o {dict(rows.dtypes)['_o']}"
    order = ["frame_idx", "_o", "det_id"]
    scanned = keyed_scan(parts, ["site_id", "_part"], order, lambda: _Ranked(p), schema)
    first = scanned.groupBy("site_id", "_part", "track_no").agg(F.min(F.struct(*order)).alias("_first"))
    firsts = first.select("site_id", "_part", "track_no", *[F.col(f"_first.{c}").alias(c) for c in order])
    numbers = numbered(firsts, ["site_id"], order, "track_id", span).select("site_id", "_part", "track_no", F.col("track_id").cast("long").alias("track_id"))
    return scanned.join(numbers, ["site_id", "_part", "track_no"]).select("site_id", "frame_idx", "det_id", "track_id")


def with_level(alerts: DataFrame, p: Threat = THREAT) -> DataFrame:
    return alerts.withColumn(
        "level", F.when(F.col("threat") >= p.alert, "alert").when(F.col("threat") >= p.watch, "watch").otherwise("nominal")
    )
