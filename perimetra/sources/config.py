"""Authored and fitted configuration: policies, homographies, class names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.functions.classify import AIRBORNE, AIRCRAFT, CAN_OVERRULE, FURNITURE

POLICY_DDL = (
    "site STRING, source_text STRING, "
    "zones ARRAY<STRUCT<name: STRING, polygon: ARRAY<ARRAY<DOUBLE>>, description: STRING>>, "
    "rules ARRAY<STRUCT<id: STRING, zone: STRING, classes: ARRAY<STRING>, verdict: STRING, severity: DOUBLE, "
    "hours: ARRAY<DOUBLE>, days: ARRAY<INT>, max_dwell_s: DOUBLE, min_speed_px: DOUBLE, reason: STRING>>"
)
HOMOGRAPHY_DDL = "H ARRAY<ARRAY<DOUBLE>>, source STRING, n_points INT, reprojection_mean_px DOUBLE, reprojection_max_px DOUBLE"


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Policy files, one JSON document each; the file name without its ending is the site."""
    raw = spark.read.schema(POLICY_DDL).option("multiLine", True).json(path)
    return raw.withColumn("site_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def parse_policies(texts: DataFrame, text: str = "text") -> DataFrame:
    """Policy documents held in a column; a document that does not parse gives NULL fields."""
    doc = F.from_json(text, POLICY_DDL)
    return texts.withColumn("_doc", doc).select("*", "_doc.*").drop("_doc", text)


def _tidy(v: Column) -> Column:
    return F.replace(F.lower(F.trim(v)), F.lit(" "), F.lit("_"))


def zone_table(policies: DataFrame) -> DataFrame:
    """Zones in file order, names normalised; a zone without a name is left out."""
    z = policies.select("site_id", F.posexplode("zones").alias("ord", "z"))
    name = _tidy(F.col("z.name"))
    points = F.transform(
        F.coalesce(F.col("z.polygon"), F.array().cast("array<array<double>>")), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    )
    return z.filter(F.coalesce(name, F.lit("")) != "").select(
        "site_id", "ord", name.alias("name"), points.alias("polygon"), F.coalesce("z.description", F.lit("")).alias("description")
    )


def rule_table(policies: DataFrame) -> DataFrame:
    """Rules in file order with their defaults filled in."""
    r = policies.select("site_id", F.posexplode("rules").alias("ord", "r"))
    c = F.col
    return r.select(
        "site_id",
        "ord",
        F.coalesce(F.nullif(c("r.id"), F.lit("")), F.format_string("rule-%d", c("ord") + 1)).alias("id"),
        F.coalesce(_tidy(c("r.zone")), F.lit("*")).alias("zone"),
        F.transform(
            F.when(F.size("r.classes") > 0, c("r.classes")).otherwise(F.array(F.lit("*"))), F.lower
        ).alias("classes"),
        F.coalesce("r.verdict", F.lit("prohibited")).alias("verdict"),
        F.coalesce("r.severity", F.lit(0.8)).alias("severity"),
        F.when(
            F.size("r.hours") > 0, F.struct(F.get("r.hours", F.lit(0)).alias("start"), F.get("r.hours", F.lit(1)).alias("end"))
        ).alias("hours"),
        F.when(F.size("r.days") > 0, c("r.days")).alias("days"),
        c("r.max_dwell_s").alias("max_dwell_s"),
        c("r.min_speed_px").alias("min_speed_px"),
        F.coalesce("r.reason", F.lit("")).alias("reason"),
    )


def policy_documents(zones: DataFrame, rules: DataFrame, site_names: DataFrame) -> DataFrame:
    """Back to one JSON document per site, ready for a text sink."""
    z = zones.groupBy("site_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "ord", "name", F.transform("polygon", lambda p: F.array(p["x"], p["y"])).alias("polygon"), "description"
                )
            )
        ).alias("zones")
    )
    r = rules.groupBy("site_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "ord", "id", "zone", "classes", "verdict", "severity",
                    F.when(F.col("hours").isNotNull(), F.array("hours.start", "hours.end")).alias("hours"),
                    "days", "max_dwell_s", "min_speed_px", "reason",
                )
            )
        ).alias("rules")
    )
    doc = F.struct(
        "site",
        F.transform("zones", lambda v: v.dropFields("ord")).alias("zones"),
        F.transform("rules", lambda v: v.dropFields("ord")).alias("rules"),
    )
    return site_names.join(z, "site_id", "left").join(r, "site_id", "left").select("site_id", F.to_json(doc).alias("value"))


def read_homographies(spark: SparkSession, path: str) -> DataFrame:
    """Fitted camera-to-camera maps, one JSON file per site, as nine doubles in row order."""
    raw = spark.read.schema(HOMOGRAPHY_DDL).option("multiLine", True).json(path)
    return raw.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("site_id"),
        F.flatten("H").alias("h"),
        "n_points",
        "reprojection_mean_px",
    )


def write_homographies(maps: DataFrame, path: str) -> None:
    """Append maps as JSON lines partitioned by site."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice("h", i * 3 + 1, 3))
    others = [c for c in maps.columns if c != "h"]
    maps.select(*others, rows.alias("H")).write.mode("overwrite").partitionBy("site_id").json(path)


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """Class names of a recogniser, one per line, with what each name may do."""
    lines = spark.read.format("text").option("wholetext", True).load(path)
    names = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda n: n != "")
    return lines.select(F.posexplode(names).alias("id", "label")).transform(with_roles)


def with_roles(names: DataFrame) -> DataFrame:
    label = F.col("label")
    return names.withColumns(
        {
            "aircraft": label.isin(*AIRCRAFT),
            "can_overrule": label.isin(*CAN_OVERRULE),
            "furniture": label.isin(*FURNITURE),
            "airborne": label.isin(*AIRBORNE),
        }
    )
