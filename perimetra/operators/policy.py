"""What is allowed where and when: authored rules judged against objects.

A site's zones and rules travel as one array per site, so judging an object is one join on
``site_id`` and row-local array work; objects are never multiplied by rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perimetra.functions import schedule as S
from perimetra.functions.arrays import let
from perimetra.functions.geometry import inside, with_columns_once
from perimetra.functions.text import words

ANY = "*"


def zone_lists(zones: DataFrame) -> DataFrame:
    """One row per site: its zones in file order."""
    z = F.struct("ord", "name", "polygon")
    return zones.groupBy("site_id").agg(F.sort_array(F.collect_list(z)).alias("_zones"))


def rule_lists(rules: DataFrame) -> DataFrame:
    """One row per site: its rules in file order."""
    r = F.struct(
        "ord", "id", "zone", F.transform("classes", F.lower).alias("classes"), "verdict", "severity", "hours", "days",
        "max_dwell_s", "min_speed_px", "reason",
    )
    return rules.groupBy("site_id").agg(F.sort_array(F.collect_list(r)).alias("_rules"))


def zone_of(objects: DataFrame, zones: DataFrame) -> DataFrame:
    """Add ``zone``: the first named zone in file order that holds the object, NULL if none."""
    j = objects.join(zone_lists(zones), "site_id", "left")
    named = F.filter("_zones", lambda z: (z["name"] != ANY) & inside(F.col("cx"), F.col("cy"), z["polygon"]))
    return with_columns_once(j, {"zone": F.get(named, F.lit(0))["name"]}).drop("_zones")


def judged(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``policy`` STRUCT<risk, verdict, reasons, rule_ids, suppresses_novelty>.

    Needs ``label, zone, hour, weekday, dwell_s, speed_px``.
    """
    c = F.col
    label = F.coalesce(c("label"), F.lit("unknown"))
    where = F.coalesce(F.concat(F.lit(" in "), c("zone")), F.lit(""))

    def concerns(r: Column) -> Column:
        by_class = F.array_contains(r["classes"], ANY) | F.array_contains(r["classes"], F.lower(label))
        return by_class & ((r["zone"] == ANY) | F.coalesce(r["zone"] == c("zone"), F.lit(False)))

    def ruled(r: Column) -> Column:
        covered = S.in_window(r["hours"], r["days"], c("hour"), c("weekday"))
        limits = S.within_limits(r["max_dwell_s"], r["min_speed_px"], c("dwell_s"), c("speed_px"))
        return let(F.struct(covered.alias("now"), limits.alias("inside")), lambda s: let(effect(r, s), lambda e: hit(r, s, e)))

    def effect(r: Column, s: Column) -> Column:
        return (
            F.when((r["verdict"] == "prohibited") & s["now"], "forbid")
            .when((r["verdict"] == "permitted") & s["now"] & s["inside"], "allow")
            .when(r["verdict"] == "permitted", "lapse")
            .when((r["verdict"] == "restricted") & s["now"] & ~s["inside"], "exceed")
        )

    def hit(r: Column, s: Column, e: Column) -> Column:
        stated = F.nullif(r["reason"], F.lit(""))
        lapse = S.out_of_scope(label, where, s["now"], r["hours"], r["max_dwell_s"], r["min_speed_px"], c("dwell_s"), c("speed_px"))
        sentence = (
            F.when(e == "forbid", F.coalesce(stated, words(label, " not permitted", where)))
            .when(e == "allow", F.coalesce(stated, words(label, " expected", where)))
            .when(e.isNotNull(), lapse)
        )
        risk = F.when(e == "allow", 0.0).when(e == "lapse", r["severity"] * 0.5).otherwise(r["severity"])
        return F.struct(e.alias("effect"), risk.alias("risk"), sentence.alias("reason"), r["id"].alias("id"))

    def summed(hits: Column) -> Column:
        forbidden = F.exists(hits, lambda h: h["effect"] != "allow")
        allowed = F.exists(hits, lambda h: h["effect"] == "allow")
        return F.struct(
            F.coalesce(F.greatest(F.array_max(F.transform(hits, lambda h: h["risk"])), F.lit(0.0)), F.lit(0.0)).alias("risk"),
            F.when(forbidden, "prohibited").when(allowed, "permitted").otherwise("unstated").alias("verdict"),
            F.transform(hits, lambda h: h["reason"]).alias("reasons"),
            F.transform(hits, lambda h: h["id"]).alias("rule_ids"),
            (allowed & ~forbidden).alias("suppresses_novelty"),
        )

    applied = F.filter(F.transform(F.filter("_rules", concerns), ruled), lambda h: h["effect"].isNotNull())
    none = F.filter(F.transform(F.array(F.lit(0)), lambda _: F.struct(
        F.lit("").alias("effect"), F.lit(0.0).alias("risk"), F.lit("").alias("reason"), F.lit("").alias("id"))), lambda h: F.lit(False))
    j = objects.join(rule_lists(rules), "site_id", "left")
    return with_columns_once(j, {"policy": let(F.coalesce(applied, none), summed)}).drop("_rules")


def judge(objects: DataFrame, zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Find each object's zone, then what the rules say about it."""
    return judged(zone_of(objects, zones), rules)


def lint(zones: DataFrame, rules: DataFrame) -> DataFrame:
    """Problems a person should see before a policy governs anything."""
    known = zones.select("site_id", F.col("name").alias("zone")).distinct()
    head = F.concat(F.lit("rule '"), F.col("id"), F.lit("' "))
    unknown_zone = rules.filter(F.col("zone") != ANY).join(known, ["site_id", "zone"], "left_anti").select(
        "site_id", words(head, "references unknown zone '", F.col("zone"), "' - it will never match").alias("problem")
    )
    in_rule = F.array_compact(
        F.array(
            F.when(
                ~F.col("verdict").isin("permitted", "prohibited", "restricted"),
                words(head, "has unknown verdict '", F.col("verdict"), "' - it will be ignored"),
            ),
            F.when(~F.col("severity").between(0.0, 1.0), words(head, "severity ", F.col("severity").cast("string"), " outside 0-1")),
            F.when(
                (F.col("verdict") == "restricted") & F.col("max_dwell_s").isNull() & F.col("min_speed_px").isNull(),
                words(head, "is 'restricted' but states no limit, so nothing can exceed it"),
            ),
        )
    )
    rule_rows = rules.select("site_id", F.explode(in_rule).alias("problem"))
    corners = F.size("polygon")
    thin = zones.filter((F.col("name") != ANY) & corners.between(1, 2)).select(
        "site_id", words("zone '", F.col("name"), "' has fewer than 3 points").alias("problem")
    )
    boundless = zones.filter((F.col("name") != ANY) & (corners <= 0)).select(
        "site_id", words("zone '", F.col("name"), "' has no polygon, so it holds every point").alias("problem")
    )
    return unknown_zone.unionByName(rule_rows).unionByName(thin).unionByName(boundless)


def described(rules: DataFrame) -> DataFrame:
    """One line per rule, for reviewing what will be enforced."""
    line = F.concat_ws(
        " ",
        F.concat(F.lit("["), F.col("id"), F.lit("]")),
        F.rpad("verdict", 10, " "),
        F.concat(F.array_join("classes", "/"), F.lit(" in "), F.col("zone")),
        F.when(F.col("hours").isNotNull(), F.format_string("hours %.0f-%.0f", F.col("hours.start"), F.col("hours.end"))),
        F.when(F.col("max_dwell_s").isNotNull(), F.format_string("max dwell %.0fs", F.col("max_dwell_s"))),
        F.when(F.col("severity") != 0, F.format_string("severity %.2f", F.col("severity"))),
    )
    return rules.select("site_id", "ord", line.alias("line"), F.col("reason"))
