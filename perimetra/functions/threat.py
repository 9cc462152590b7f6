"""From evidence to one threat number with its level and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perimetra.functions.text import joined, num, reasons, words
from perimetra.params import FUSION, THREAT, Fusion, Threat


def level(threat: Column, p: Threat = THREAT) -> Column:
    return F.when(threat >= p.alert, "alert").when(threat >= p.watch, "watch").otherwise("nominal")


def identity_risk(label: Column, confidence: Column, p: Threat = THREAT) -> Column:
    return F.when(label == "drone", confidence).when(label == "bird", 0.0).otherwise(p.unknown_risk)


def noisy_or(*risks: Column) -> Column:
    quiet = F.lit(1.0)
    for r in risks:
        quiet = quiet * (1.0 - r)
    return 1.0 - quiet


def track_threat(ident: Column, site: Column, policy: Column, permitted: Column, p: Threat = THREAT) -> Column:
    """Any one of identity, site novelty or policy is enough; a permission only damps novelty."""
    damped = site * F.when(permitted, p.site_when_permitted).otherwise(1.0)
    return noisy_or(ident, damped, policy)


def track_reasons(
    label: Column,
    confidence: Column,
    note: Column,
    novelty_reasons: Column,
    policy_verdict: Column,
    policy_reasons: Column,
    ruling: Column,
) -> Column:
    """Prohibition first, permission last, the classifier's own ruling at the end."""
    name = F.when(
        (label == "drone") & (confidence > 0.5), words("classified drone (", num(confidence, 2), ")")
    ).when(label == "unknown", "unclassified mover")
    return joined(
        F.when(policy_verdict == "prohibited", policy_reasons),
        reasons(name, note),
        novelty_reasons,
        F.when(policy_verdict == "permitted", policy_reasons),
        reasons(ruling),
    )


def static_threat(dwell_s: Column, peak_dev_c: Column) -> Column:
    """A settled patch the site model did not know: longer and hotter is worse."""
    stay = F.least(F.lit(1.0), dwell_s / 30.0)
    heat = F.least(F.lit(1.0), F.abs(peak_dev_c) / 8.0)
    return F.least(F.lit(1.0), 0.60 + 0.25 * stay + 0.15 * heat)


def static_reasons(dwell_s: Column, peak_dev_c: Column, cells: Column) -> Column:
    return reasons(
        words("object at rest ", num(dwell_s), " s where the learned site is empty"),
        words(num(peak_dev_c, 1, signed=True), " C off baseline over ", cells.cast("string"), " cells"),
    )


def optical_threat(found: Column, warm: Column, hotspot: Column, dwell_s: Column, p: Threat = THREAT) -> Column:
    """A contact only the optical camera has: confirmed warm, checked cold, or out of view."""
    settled = F.least(F.lit(1.0), dwell_s / 60.0)
    return (
        F.when(F.coalesce(warm, F.lit(False)), 0.55 + 0.25 * F.least(F.lit(1.0), hotspot / p.hot_hint_c))
        .when(F.coalesce(found, F.lit(False)), 0.12 + 0.58 * settled)
        .otherwise(0.20 + 0.45 * settled)
    )


def optical_label(found: Column, warm: Column, dwell_s: Column) -> Column:
    cold = F.coalesce(found, F.lit(False)) & ~F.coalesce(warm, F.lit(False))
    return F.when(cold & (F.least(F.lit(1.0), dwell_s / 60.0) > 0.25), "cold contact").otherwise("unverified contact")


def optical_reasons(found: Column, warm: Column, answer: Column, dwell_s: Column) -> Column:
    warm, found = F.coalesce(warm, F.lit(False)), F.coalesce(found, F.lit(False))
    staying = F.when(
        F.least(F.lit(1.0), dwell_s / 60.0) > 0.15,
        words("still in the same place after ", num(dwell_s), " s - clutter usually is not"),
    )
    return (
        F.when(warm, reasons(F.lit("optical found it first, thermal confirmed heat"), answer))
        .when(found, reasons(F.lit("optical-only contact, no heat where thermal looked"), answer, staying))
        .otherwise(
            F.array(
                F.lit("optical-only contact, outside the thermal field of view"),
                F.lit("cannot be cross-checked on a fixed mount"),
            )
        )
    )


def fused_identity(label: Column, confidence: Column, o_label: Column, o_conf: Column, o_reason: Column) -> Column:
    """Combine both sensors' names: agreement raises confidence, disagreement halves it."""
    usable = F.coalesce(o_conf > 0.0, F.lit(False))
    agree = usable & (o_label == label)
    open_optical = usable & (o_label == "unknown")
    open_thermal = usable & (label == "unknown")
    stronger = usable & (o_conf > confidence)

    def out(lab: Column, conf: Column, note: Column) -> Column:
        return F.struct(lab.alias("label"), conf.cast("double").alias("confidence"), note.alias("note"))

    return (
        F.when(~usable, out(label, confidence, words("thermal only (", F.coalesce(o_reason, F.lit("no optical check")), ")")))
        .when(agree, out(label, noisy_or(confidence, o_conf), words("optical agrees: ", o_reason)))
        .when(open_optical, out(label, confidence, words("optical inconclusive: ", o_reason)))
        .when(open_thermal, out(o_label, o_conf * 0.8, words("optical led: ", o_reason)))
        .when(
            stronger,
            out(o_label, o_conf * 0.5, words("SENSORS DISAGREE - thermal said ", label, ", optical says ", o_label)),
        )
        .otherwise(
            out(label, confidence * 0.5, words("SENSORS DISAGREE - optical said ", o_label, ", thermal holds ", label))
        )
    )


def shape_verdict(area: Column, aspect: Column, solidity: Column, p: Fusion = FUSION) -> Column:
    """Name an outline cut from the optical frame: ``STRUCT<label, confidence, reason>``."""
    scale = F.least(F.lit(1.0), (area - p.min_shape_px) / F.lit(p.good_shape_px - p.min_shape_px))
    long_outline, ragged = aspect >= p.bird_aspect, solidity <= p.bird_solidity
    compact = aspect.between(p.drone_aspect_lo, p.drone_aspect_hi) & (solidity >= p.drone_solidity)
    bird = 0.55 + 0.35 * F.least(
        F.lit(1.0),
        F.when(long_outline, (aspect - p.bird_aspect) / 1.5).otherwise((p.bird_solidity - solidity) / 0.3),
    )
    drone = 0.55 + 0.35 * F.least(F.lit(1.0), (solidity - p.drone_solidity) / 0.3)
    measured = words("(aspect ", num(aspect, 2), ", solidity ", num(solidity, 2), ")")
    px = words("; ", num(area), " px on target")
    named = F.when(long_outline | ragged, "bird").when(compact, "drone").otherwise("unknown")
    strength = F.when(long_outline | ragged, bird).when(compact, drone).otherwise(0.0)
    why = (
        F.when(long_outline | ragged, words("elongated/ragged outline ", measured, " - wings"))
        .when(compact, words("compact solid outline ", measured, " - rigid airframe"))
        .otherwise("shape is not distinctive")
    )
    small = area < p.min_shape_px
    return F.struct(
        F.when(small, "unknown").otherwise(named).alias("label"),
        F.when(small, 0.0).otherwise(F.bround(strength * scale, 3)).alias("confidence"),
        F.when(small, words("only ", num(area), " px on target - too few to judge shape"))
        .otherwise(words(why, px))
        .alias("reason"),
    )


def heat_verdict(peak: Column, mean: Column, background: Column, p: Fusion = FUSION) -> Column:
    """Is a patch warm against its ring, and has it a powered core?"""
    contrast, hotspot = mean - background, peak - mean
    warm = contrast >= p.warm_c
    core = warm & (hotspot >= p.hot_core_c)
    plus = num(contrast, 1, signed=True)
    return F.struct(
        peak.alias("peak_c"),
        mean.alias("mean_c"),
        contrast.alias("contrast_c"),
        hotspot.alias("hotspot_c"),
        warm.alias("warm"),
        F.when(core, 0.85).when(warm, 0.6).otherwise(0.25).alias("confidence"),
        F.when(core, words("warm (", plus, " C over surround) with a ", num(hotspot, 1), " C core - powered"))
        .when(warm, words("warm, ", plus, " C over its surround"))
        .otherwise(words("no heat signature (", plus, " C) - clutter, or cold-soaked"))
        .alias("reason"),
    )


def thermal_answer(asked: Column, found: Column, warm: Column, peak: Column, contrast: Column, reason: Column) -> Column:
    """What thermal said back, as one sentence for the trail."""
    plus = num(contrast, 1, signed=True)
    return (
        F.when(~F.coalesce(asked, F.lit(False)), "not asked")
        .when(~F.coalesce(found, F.lit(False)), F.coalesce(F.nullif(reason, F.lit("")), F.lit("outside the thermal field of view")))
        .when(warm, words("warm - ", num(peak, 1), " C peak, ", plus, " C above surroundings"))
        .otherwise(words("NOT warm - ", num(peak, 1), " C peak, only ", plus, " C above surroundings"))
    )


def optical_answer(
    asked: Column,
    found: Column,
    label: Column,
    confidence: Column,
    solidity: Column,
    aspect: Column,
    pixels: Column,
    reason: Column,
    name: Column,
    name_conf: Column,
) -> Column:
    """What optical said back; a recognised name leads, the measurements follow."""
    head = F.when(name.isNotNull(), words("it is a ", name, " (", num(name_conf, 2), ")"))
    shape = words("solidity ", num(solidity, 2), ", aspect ", num(aspect, 2), ", ", F.floor(pixels).cast("string"), " px")
    return (
        F.when(~F.coalesce(asked, F.lit(False)), F.coalesce(head, F.lit("not asked")))
        .when(~F.coalesce(found, F.lit(False)), F.coalesce(head, F.nullif(reason, F.lit("")), F.lit("nothing there")))
        .when(head.isNotNull(), words(head, " - ", shape))
        .when(
            label.isNotNull() & (label != "unknown"),
            words("looks like ", label, " (", num(confidence, 2), ") - ", shape),
        )
        .otherwise(words("shape unclear - ", shape))
    )


def combined_novelty(*channels: Column) -> Column:
    """0.8 of the strongest channel plus 0.2 of the mean; a NULL channel has no vote."""
    given = F.array_compact(F.array(*[c.cast("double") for c in channels]))
    mean = F.aggregate(given, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(given), F.lit(0))
    return 0.8 * F.array_max(given) + 0.2 * mean
