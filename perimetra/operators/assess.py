"""One list of verdicts, and the short lists people look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perimetra.functions import threat as T
from perimetra.functions.geometry import with_columns_once
from perimetra.functions.text import num, words
from perimetra.params import ALERTING, THREAT, Alerting, Threat

COLUMNS = (
    "site_id", "frame_idx", "t_us", "key", "kind", "track_id", "label", "confidence", "threat", "identity_risk", "site_risk",
    "policy_risk", "dwell_s", "sensors", "reasons",
)


def track_assessments(objects: DataFrame) -> DataFrame:
    """Verdicts on tracked movers.

    Needs the identity (``label, confidence``), the optical answer (``o_label, o_confidence,
    o_reason``, NULL when not asked), ``site_risk, novelty_reasons``, the ``policy`` struct and
    ``not_airborne``.
    """
    c = F.col
    fused = T.fused_identity(c("label"), c("confidence"), c("o_label"), c("o_confidence"), c("o_reason"))
    asked = c("o_reason").isNotNull()
    f = with_columns_once(objects, {"_f": fused}).withColumns(
        {
            "label": F.when(asked, c("_f.label")).otherwise(c("label")),
            "confidence": F.when(asked, c("_f.confidence")).otherwise(c("confidence")),
            "_note": F.when(asked, c("_f.note")),
        }
    )
    ident = T.identity_risk(c("label"), c("confidence"))
    site, risk = F.coalesce("site_risk", F.lit(0.0)), F.coalesce("policy.risk", F.lit(0.0))
    allowed = F.coalesce("policy.suppresses_novelty", F.lit(False))
    why = T.track_reasons(
        c("label"), c("confidence"), c("_note"), c("novelty_reasons"), c("policy.verdict"), c("policy.reasons"), c("not_airborne")
    )
    return f.withColumns({"identity_risk": ident, "policy_risk": risk}).withColumns(
        {
            "key": F.format_string("track:%d", "track_id"),
            "kind": F.lit("track"),
            "threat": T.track_threat(c("identity_risk"), site, c("policy_risk"), allowed),
            "site_risk": site * F.when(allowed, THREAT.site_when_permitted).otherwise(1.0),
            "sensors": F.when(F.coalesce(c("o_confidence") > 0, F.lit(False)), "thermal+optical").otherwise("thermal"),
            "reasons": why,
        }
    )


def static_assessments(regions: DataFrame) -> DataFrame:
    """Verdicts on settled thermal patches nothing else claims."""
    c = F.col
    risk = T.static_threat(c("dwell_s"), c("peak_dev_c"))
    return regions.withColumns(
        {
            "kind": F.lit("static"), "label": F.lit("settled object"), "confidence": F.lit(0.0), "threat": risk, "site_risk": risk,
            "identity_risk": F.lit(0.0), "policy_risk": F.lit(0.0), "sensors": F.lit("thermal"),
            "reasons": T.static_reasons(c("dwell_s"), c("peak_dev_c"), c("cells")),
        }
    )


def optical_assessments(contacts: DataFrame) -> DataFrame:
    """Verdicts on contacts or settled patches only the optical camera has.

    ``found, warm, hotspot_c, answer`` are the thermal camera's reply, NULL when it could not be
    asked; ``name, name_confidence`` what a recogniser calls it, NULL when nothing.
    """
    c = F.col
    risk = T.optical_threat(c("found"), c("warm"), c("hotspot_c"), c("dwell_s"))
    named = F.when(c("name").isNotNull(), words("optical recognises it as a ", c("name"), " (", num(c("name_confidence"), 2), ")"))
    why = T.optical_reasons(c("found"), c("warm"), c("answer"), c("dwell_s"))
    return contacts.withColumns(
        {
            "kind": F.lit("optical"), "confidence": F.lit(0.0), "threat": risk, "identity_risk": risk, "site_risk": F.lit(0.0),
            "policy_risk": F.lit(0.0), "sensors": F.lit("optical"),
            "label": F.coalesce(c("name"), T.optical_label(c("found"), c("warm"), c("dwell_s"))),
            "reasons": F.concat(why, F.array_compact(F.array(named))),
        }
    )


def union(*parts: DataFrame, p: Threat = THREAT) -> DataFrame:
    """All verdicts of a frame in one table, with the level of each."""
    out = None
    for part in parts:
        cut = part.select(*[c for c in COLUMNS if c in part.columns])
        out = cut if out is None else out.unionByName(cut, allowMissingColumns=True)
    return out.withColumn("level", T.level(F.col("threat"), p))


def settled_ready(rows: DataFrame, sites: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Keep settled objects of sites that have been learned, at moments outside any learning session.

    ``sites(site_id, thermal_learned[, optical_learned])``; an optical model counts where there is one. ``sessions(site_id, started_us, ended_us)``
    is what `site.learning_sessions` gives; one without an end lasts. ``rows`` carry ``t_us``.
    """
    optical = F.coalesce("optical_learned", F.lit(True)) if "optical_learned" in sites.columns else F.lit(True)
    ready = rows.join(sites.filter(F.col("thermal_learned") & optical).select("site_id"), "site_id", "left_semi")
    if sessions is None:
        return ready
    s = sessions.select(F.col("site_id").alias("_site"), F.col("started_us").alias("_from"), F.col("ended_us").alias("_to"))
    inside = (F.col("site_id") == F.col("_site")) & (F.col("t_us") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("t_us") < F.col("_to")))
    return ready.join(s, inside, "left_anti")


def top_per(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` of each group; the limit reaches below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def watch_list(assessed: DataFrame, p: Alerting = ALERTING) -> DataFrame:
    """What arrived and has not left, worst first."""
    still = assessed.filter(F.col("kind").isin("static", "optical") & (F.col("dwell_s") >= p.watch_min_dwell_s))
    order = [F.desc("threat"), F.desc("dwell_s"), F.col("key"), F.col("frame_idx")]
    top = top_per(still, ["site_id"], order, p.watch_limit)
    return top.withColumn("reasons", F.slice("reasons", 1, 3)) if "reasons" in top.columns else top


def top_contacts(optical: DataFrame, n: int = ALERTING.optical_shown) -> DataFrame:
    """Largest optical contacts of a frame, with how many are left unnumbered."""
    totals = optical.groupBy("site_id", "frame_idx").agg(F.count(F.lit(1)).alias("_all"))
    top = top_per(optical, ["site_id", "frame_idx"], [F.desc("area"), F.col("det_id")], n)
    hidden = F.greatest(F.col("_all") - n, F.lit(0))
    return top.join(totals, ["site_id", "frame_idx"]).withColumn("hidden", hidden).drop("_all")


def alert_history(alerts: DataFrame, p: Alerting = ALERTING) -> DataFrame:
    """Closed alerts, newest first."""
    closed = alerts.filter(F.col("closed_us").isNotNull())
    return top_per(closed, ["site_id"], [F.desc("closed_us"), F.desc("opened_us"), F.col("key")], p.keep_closed)


def active_alerts(alerts: DataFrame) -> DataFrame:
    """Open alerts with their rank by threat."""
    w = Window.partitionBy("site_id").orderBy(F.desc("threat"), "key")
    return alerts.filter(F.col("closed_us").isNull()).withColumn("rank", F.row_number().over(w))


def alert_board(alerts: DataFrame, n: int = 3) -> DataFrame:
    """The newest few of each level, each with the true total of its level."""
    totals = alerts.groupBy("site_id", "level").agg(F.count(F.lit(1)).alias("of_level"))
    order = [F.desc("opened_us"), F.col("key")]
    return top_per(alerts, ["site_id", "level"], order, n).join(totals, ["site_id", "level"])


def cross_trail(*producers: DataFrame, p: Alerting = ALERTING) -> DataFrame:
    """Newest questions between the cameras, from all three producers."""
    rows = producers[0]
    for other in producers[1:]:
        rows = rows.unionByName(other)
    return top_per(rows, ["site_id"], [F.desc("frame_idx"), F.col("key")], p.trail_limit)


def current_state(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Newest row per key, with a partial maximum on the map side."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(order, *values)).alias("_v"))
    return newest.select(*keys, "_v.*")


def with_details(dets: DataFrame, tracks: DataFrame, assessed: DataFrame) -> DataFrame:
    """Detections with what is known of their track and verdict; both may be missing."""
    on = ["site_id", "frame_idx", "track_id"]
    return dets.join(tracks, on, "left").join(assessed, on, "left")


def annotated(rows: DataFrame, identifications: DataFrame) -> DataFrame:
    """Add the outside opinion on a key, where one has come back."""
    return rows.join(identifications, ["site_id", "key"], "left")


def worth_showing(assessed: DataFrame) -> DataFrame:
    return assessed.filter(F.col("level") != "nominal")


def site_levels(assessed: DataFrame) -> DataFrame:
    """Verdicts per site and level."""
    return assessed.groupBy("site_id", "level").agg(F.count(F.lit(1)).alias("objects"), F.max("threat").alias("peak"))


def service_counters(candidates: DataFrame, admitted: DataFrame, answers: DataFrame) -> DataFrame:
    """Per site: requests wanted, sent, answered, failed and still open."""
    wanted = candidates.groupBy("site_id").agg(F.count(F.lit(1)).alias("wanted"))
    sent = admitted.groupBy("site_id").agg(F.count(F.lit(1)).alias("sent"))
    got = answers.groupBy("site_id").agg(F.count_if("ok").alias("calls"), F.count_if(~F.col("ok")).alias("failures"))
    j = wanted.join(sent, "site_id", "left").join(got, "site_id", "left").fillna(0, ["sent", "calls", "failures"])
    return j.withColumn("pending", F.greatest(F.col("sent") - F.col("calls") - F.col("failures"), F.lit(0)))
