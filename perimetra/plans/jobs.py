"""The two batch jobs of a site fleet: learn clean frames, then judge new ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perimetra.functions import geometry as G
from perimetra.functions import schedule as S
from perimetra.operators import alerts, assess, fusion, policy, regions, site, tracks
from perimetra.operators.fusion import unclaimed
from perimetra.params import ALERTING, CHUNK_FRAMES, FUSION, OPTICAL_SITE, SENSOR, THERMAL_SITE, Alerting, Fusion, OpticalSite, Sensor, ThermalSite


@dataclass
class SiteKnowledge:
    """What commissioning leaves behind."""

    model: DataFrame
    traffic: DataFrame
    features: DataFrame


@dataclass
class Optics:
    """What the optical sensor of the sites saw over the same frames; every part but the detections and maps may be missing.

    ``detections(site_id, frame_idx, det_id, x, y, w, h, cx, cy, area)`` in optical pixels, ``homography(site_id, h)``; ``celsius(site_id,
    frame_idx, celsius)`` and ``grey(site_id, frame_idx, grey)`` are whole frames for heat and shape checks; ``cells(site_id, frame_idx,
    structure, tone)`` with the learned ``model`` for what has changed in place; ``names(site_id, frame_idx, name_id, label, confidence, nx, ny,
    nw, nh)`` are recognitions.
    """

    detections: DataFrame
    homography: DataFrame
    celsius: DataFrame | None = None
    grey: DataFrame | None = None
    cells: DataFrame | None = None
    model: DataFrame | None = None
    names: DataFrame | None = None
    sensor: Sensor = SENSOR
    site: OpticalSite = OPTICAL_SITE
    fusion: Fusion = FUSION


FRAME = ["site_id", "frame_idx"]
BOX = ["x", "y", "w", "h"]


def _mapped(boxes: DataFrame, optics: Optics) -> DataFrame:
    """Thermal boxes of sites that have a map, in optical pixels ``mx, my, mw, mh``."""
    known = boxes.join(optics.homography.select("site_id", "h").withColumnRenamed("h", "_h"), "site_id")
    return G.with_mapped_box(known, F.col("_h"), G.Box.of()).drop("_h").filter("mx IS NOT NULL")


def _renamed(boxes: DataFrame) -> DataFrame:
    """Mapped boxes under the names of plain ones."""
    return boxes.drop(*BOX).withColumnsRenamed({"mx": "x", "my": "y", "mw": "w", "mh": "h"})


def _changed(optics: Optics, span: int | None) -> DataFrame | None:
    """Cells of the optical scene with how far they are off what was learned, and for how long."""
    if optics.cells is None or optics.model is None:
        return None
    z = site.read_optical(optics.cells, optics.model, optics.site)
    cells = z.select(*FRAME, F.posexplode("z").alias("pos", "z"))
    return site.hot_runs(cells, ["site_id", "pos"], F.col("z") > optics.site.z_anomalous, span=span)


def _second_opinions(scored: DataFrame, optics: Optics) -> DataFrame:
    """Add what the optical frame makes of the shape of objects worth a look: ``o_label, o_confidence, o_reason``, NULL where not asked."""
    answer = ["o_label", "o_confidence", "o_reason"]
    if optics.grey is None:
        return scored.withColumns({"o_label": F.lit(None).cast("string"), "o_confidence": F.lit(None).cast("double"), "o_reason": F.lit(None).cast("string")})
    asked = fusion.worth_a_look(scored.filter("mx IS NOT NULL"), optics.fusion)
    asked = asked.select(*FRAME, F.col("track_id").alias("det_id"), F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mw").alias("w"), F.col("mh").alias("h"))
    told = fusion.shape_checks(asked, optics.grey, optics.sensor.optical_rows, optics.sensor.optical_cols, optics.fusion)
    return scored.join(told.select(*FRAME, F.col("det_id").alias("track_id"), *answer), [*FRAME, "track_id"], "left")


def _heat(contacts: DataFrame, optics: Optics) -> DataFrame:
    """Ask the thermal frame about optical boxes ``(.., det_id, x, y, w, h)``: ``found, warm, hotspot_c, answer``, NULL where it cannot be asked."""
    blank = {"found": F.lit(None).cast("boolean"), "warm": F.lit(None).cast("boolean"), "hotspot_c": F.lit(None).cast("double"), "answer": F.lit(None).cast("string")}
    if optics.celsius is None:
        return contacts.withColumns(blank)
    back = contacts.join(optics.homography.select("site_id", G.inverse(F.col("h")).alias("_h")), "site_id").filter("_h IS NOT NULL")
    mapped = _renamed(G.with_mapped_box(back, F.col("_h"), G.Box.of()).drop("_h").filter("mx IS NOT NULL"))
    seen = fusion.heat_checks(mapped, optics.celsius, optics.sensor.rows, optics.sensor.cols, optics.fusion)
    told = seen.select(*FRAME, "det_id", "found", F.when(F.col("found"), F.col("warm")).alias("warm"), "hotspot_c", F.col("reason").alias("answer"))
    return contacts.join(told, [*FRAME, "det_id"], "left")


def _named(contacts: DataFrame, optics: Optics) -> DataFrame:
    if optics.names is None:
        return contacts.withColumns({"name": F.lit(None).cast("string"), "name_confidence": F.lit(None).cast("double")})
    return contacts.join(fusion.best_names(contacts, optics.names, optics.fusion), [*FRAME, "det_id"], "left")


def _optical_verdicts(contacts: DataFrame, optics: Optics) -> DataFrame:
    return assess.optical_assessments(_named(_heat(contacts, optics), optics)).withColumn("track_id", F.lit(None).cast("long"))


def optical_half(obs: DataFrame, clock: DataFrame, optics: Optics, changed: DataFrame | None, gate, span: int | None) -> list[DataFrame]:  # noqa: ANN001
    """Verdicts on what only the optical sensor has: contacts that no thermal detection claims, and patches that changed and stay.

    Contacts are judged where the site has a map, since without one the other sensor cannot be asked. Patches need none; where there is a
    map, those under a live thermal detection are left to it. ``gate`` keeps what may be called settled.
    """
    c, p = F.col, optics.fusion
    live = _mapped(obs.select(*FRAME, F.col("track_id").alias("det_id"), "area", *BOX), optics)
    mappable = optics.detections.join(optics.homography.select("site_id"), "site_id", "left_semi")
    alone = fusion.optical_only(mappable, fusion.associate(live, mappable, p)).join(clock, FRAME)
    contacts = alone.withColumn("key", G.place_key("optical", c("cx"), c("cy"), p.contact_cell_px))
    # two contacts in one place are one stay
    stays = tracks.contact_dwell(contacts.select("site_id", "key", "frame_idx", "t_us").distinct(), p, span)
    found = [_optical_verdicts(contacts.join(stays.select("site_id", "key", "frame_idx", "dwell_s"), ["site_id", "key", "frame_idx"]), optics)]
    if changed is not None:
        patches = gate(regions.optical_regions(changed, optics.site).join(clock, FRAME))
        boxes = live.select(*FRAME, c("mx").alias("bx"), c("my").alias("by"), c("mw").alias("bw"), c("mh").alias("bh"))
        patches = unclaimed(patches, boxes, p.optical_pad_px).withColumn("det_id", F.xxhash64("key"))
        found.append(_optical_verdicts(patches, optics))
    return found


def commission(frames: DataFrame, obs: DataFrame, p: ThermalSite = THERMAL_SITE, span: int | None = CHUNK_FRAMES) -> SiteKnowledge:
    """Fit the site model from clean ``frames(site_id, frame_idx, cells)`` and track observations."""
    moving = tracks.kinematics(obs, span=span).withColumn("hotspot_c", F.col("peak_c") - F.col("mean_c"))
    rel = frames.select("site_id", "frame_idx", site.relative(F.col("cells")).alias("rel"))
    normal = site.traffic(moving, p)
    return SiteKnowledge(
        model=site.fit_site_model(rel, p, span),
        traffic=site.traffic_grids(site.activity_grid(site.activity_cells(normal, p), p), p),
        features=site.feature_stats(normal, moving, p, span),
    )


def watch(
    frames: DataFrame,
    obs: DataFrame,
    known: SiteKnowledge,
    zones: DataFrame | None = None,
    rules: DataFrame | None = None,
    zones_tz: str = "UTC",
    p: ThermalSite = THERMAL_SITE,
    span: int | None = CHUNK_FRAMES,
    optics: Optics | None = None,
    sessions: DataFrame | None = None,
) -> DataFrame:
    """Verdicts on every tracked object and settled patch, judged against a frozen model; with ``optics`` the two sensors ask each other.

    ``frames(site_id, frame_idx, t_us, cells)``; ``obs`` carries the detection features and its box
    ``x, y, w, h`` on the same frame clock. Nothing is settled during learning ``sessions``, see `assess.settled_ready`.
    """
    c = F.col
    rel = frames.select("site_id", "frame_idx", site.relative(c("cells")).alias("rel"))
    reads = site.read_against(rel, known.model, p)
    persisted = site.persistence(reads, p, span)
    objects = tracks.classified(tracks.kinematics(obs, span=span))
    objects = objects.join(alerts.dwell(objects, span=span), ["site_id", "track_id", "frame_idx"], "left").fillna(0.0, ["dwell_s"])
    objects = site.feature_novelty(site.path_familiarity(objects, known.traffic, p, span=span), known.features, p)
    pos = site.cell_of(c("cy"), p.cell_px, p.grid_rows) * p.grid_cols + site.cell_of(c("cx"), p.cell_px, p.grid_cols)
    frame = ["site_id", "frame_idx"]
    at_cell = reads.select(*frame, c("z").alias("_zs"))
    kept = persisted.select(*frame, "pos", "persist")
    learned = known.model.select("site_id", F.least(F.lit(1.0), c("frames") / F.lit(float(p.scene_frames))).alias("scene_maturity"))
    objects = (
        objects.withColumn("pos", pos)
        .join(at_cell, frame, "left")
        .join(kept, [*frame, "pos"], "left")
        .join(learned, "site_id", "left")
        .withColumns({"z": F.coalesce(F.get("_zs", c("pos")), F.lit(0.0)), "persist": F.coalesce("persist", F.lit(0))})
        .drop("_zs")
        .fillna(0.0, ["scene_maturity"])
    )
    changed, learned_sites = None, known.model.select("site_id", (c("frames") >= p.scene_frames).alias("thermal_learned"))
    if optics is not None:
        changed = _changed(optics, span)
        where = _mapped(obs.select(*frame, "track_id", *BOX), optics)
        objects = objects.join(where.select(*frame, "track_id", "mx", "my", "mw", "mh"), [*frame, "track_id"], "left")
        if changed is not None:
            optical = site.optical_maturity(optics.model, optics.site)
            learned_sites = learned_sites.join(optical.select("site_id", "optical_learned"), "site_id", "left")
            trusted = _renamed(where).join(optical.filter("optical_learned").select("site_id"), "site_id", "left_semi").withColumnRenamed("track_id", "box_id")
            odd = site.optical_box_novelty(trusted, changed, optics.site).withColumnRenamed("box_id", "track_id")
            objects = objects.join(odd.select(*frame, "track_id", "optical_novelty", "optical_reasons"), [*frame, "track_id"], "left")
    scored = site.score(objects, p, optical=changed is not None)
    if zones is not None and rules is not None:
        ts = F.timestamp_micros("t_us")
        zone = F.lit(zones_tz)
        timed = scored.withColumns({"hour": S.local_hour(ts, zone), "weekday": S.local_weekday(ts, zone)})
        scored = policy.judge(timed, zones, rules)
    else:
        scored = scored.withColumn(
            "policy",
            F.lit(None).cast("struct<risk:double,verdict:string,reasons:array<string>,rule_ids:array<string>,suppresses_novelty:boolean>"),
        )
    if optics is None:
        text = F.lit(None).cast("string")
        scored = scored.withColumns({"o_label": text, "o_confidence": F.lit(None).cast("double"), "o_reason": text})
    else:
        scored = _second_opinions(scored, optics)
    clock = frames.select(*frame, "t_us")

    def gate(rows: DataFrame) -> DataFrame:
        return assess.settled_ready(rows, learned_sites, sessions)

    live = obs.select(*frame, c("x").alias("bx"), c("y").alias("by"), c("w").alias("bw"), c("h").alias("bh"))
    patches = unclaimed(gate(regions.thermal_regions(persisted, p).join(clock, frame)), live, FUSION.static_pad_px)
    verdicts = [assess.track_assessments(scored), assess.static_assessments(patches)]
    if optics is not None:
        verdicts += optical_half(obs, clock, optics, changed, gate, span)
    return assess.union(*verdicts)


def raise_alerts(assessed: DataFrame, clock: DataFrame, p: Alerting = ALERTING, span: int | None = CHUNK_FRAMES) -> DataFrame:
    """One row per object for as long as it is there."""
    intervals = alerts.alert_intervals(assessed, clock, p, span, None if span is None else alerts.DAY_US)
    return alerts.with_level(alerts.with_alert_ids(intervals, span))
