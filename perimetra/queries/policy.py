"""Policy queries over event stand-ins and one authored document per site."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import policy
from perimetra.queries import REGISTRY
from perimetra.sources.adapters import micros, table
from perimetra.sources.config import parse_policies, rule_table, zone_table

DOCUMENT = json.dumps(
    {
        "site": "north yard",
        "zones": [
            {"name": "Loading Yard", "polygon": [[40, 20], [210, 30], [200, 120], [60, 140]], "description": "guarded"},
            {"name": "gate", "polygon": [[0, 100], [80, 90], [90, 192], [0, 192]]},
            {"name": "strip", "polygon": [[100, 150], [240, 150]]},
        ],
        "rules": [
            {"id": "no-air", "zone": "loading_yard", "classes": ["Drone"], "verdict": "prohibited", "severity": 1.0, "reason": "no aircraft over the yard"},
            {"id": "birds", "classes": ["bird"], "verdict": "permitted", "severity": 0.0, "reason": "birds are common"},
            {"id": "cars-by-day", "zone": "gate", "classes": ["vehicle"], "verdict": "permitted", "severity": 0.4, "hours": [6, 22], "max_dwell_s": 200},
            {"id": "night", "zone": "gate", "classes": ["person"], "verdict": "prohibited", "severity": 0.7, "hours": [22, 6], "days": [0, 1, 2, 3, 4]},
            {"zone": "loading_yard", "verdict": "restricted", "severity": 0.85, "max_dwell_s": 120},
            {"id": "keep-moving", "zone": "gate", "classes": ["unknown"], "verdict": "restricted", "severity": 0.5, "min_speed_px": 1.5},
            {"id": "odd", "zone": "roof", "verdict": "maybe", "severity": 1.4},
            {"id": "loose", "zone": "strip", "verdict": "restricted", "severity": 0.2},
        ],
    }
)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(10)).cast("long").alias("site_id")).distinct()
    return parse_policies(sites.withColumn("text", F.lit(DOCUMENT)))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    label = F.create_map(*[F.lit(v) for v in ("click", "bird", "view", "vehicle", "purchase", "drone", "signup", "person")])
    minutes = F.floor(micros("ts") / 60000000)
    return table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(10)).cast("long").alias("site_id"),
        "event_id",
        F.coalesce(F.try_element_at(label, F.col("event_type")), F.lit("unknown")).alias("label"),
        (k * 2.56).alias("cx"),
        F.pmod("value", F.lit(192.0)).alias("cy"),
        (k * 3.0 + 0.2).alias("dwell_s"),
        F.pmod("value", F.lit(5.0)).alias("speed_px"),
        (F.floor(minutes / 60) % 24 + (minutes % 60) / 60.0).alias("hour"),
        ((F.floor(minutes / 1440) + 3) % 7).cast("int").alias("weekday"),
    )


OBJECTS_SQL = """
objects AS (
  SELECT user_id % 10 AS site_id, event_id,
         CASE event_type WHEN 'click' THEN 'bird' WHEN 'view' THEN 'vehicle' WHEN 'purchase' THEN 'drone' WHEN 'signup' THEN 'person' ELSE 'unknown' END AS label,
         k * 2.56::DOUBLE AS cx, value % 192.0::DOUBLE AS cy, k * 3.0::DOUBLE + 0.2::DOUBLE AS dwell_s, value % 5.0::DOUBLE AS speed_px,
         (epoch_us(ts) // 60000000 // 60) % 24 + ((epoch_us(ts) // 60000000) % 60) / 60.0::DOUBLE AS hour,
         (epoch_us(ts) // 60000000 // 1440 + 3) % 7 AS weekday
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
), corners(ord, name, i, x, y) AS (VALUES
  (0, 'loading_yard', 0, 40.0::DOUBLE, 20.0::DOUBLE), (0, 'loading_yard', 1, 210, 30), (0, 'loading_yard', 2, 200, 120), (0, 'loading_yard', 3, 60, 140),
  (1, 'gate', 0, 0, 100), (1, 'gate', 1, 80, 90), (1, 'gate', 2, 90, 192), (1, 'gate', 3, 0, 192),
  (2, 'strip', 0, 100, 150), (2, 'strip', 1, 240, 150)
), edges AS (
  SELECT a.ord, a.name, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1
  FROM corners a JOIN corners b ON a.ord = b.ord AND b.i = (a.i + 1) % (SELECT count(*) FROM corners c WHERE c.ord = a.ord)
), hits AS (
  SELECT event_id, ord, name FROM objects, edges
  WHERE (y0 > cy) <> (y1 > cy) AND cx < x0 + (cy - y0) / nullif(y1 - y0, 0) * (x1 - x0)
  GROUP BY event_id, ord, name HAVING count(*) % 2 = 1
), zoned AS (
  SELECT o.*, z.name AS zone FROM objects o LEFT JOIN (SELECT event_id, min_by(name, ord) AS name FROM hits GROUP BY event_id) z USING (event_id)
)"""


@REGISTRY.add("zone_lookup", "WITH " + OBJECTS_SQL + " SELECT site_id, event_id, zone FROM zoned")
def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.zone_of(objects(spark, sf_dir), zone_table(policies(spark, sf_dir))).select("site_id", "event_id", "zone")


@REGISTRY.add(
    "policy_judge",
    "WITH " + OBJECTS_SQL + """
, fired AS (
  SELECT event_id, 0 AS ord, 'no-air' AS id, 'forbid' AS effect, 1.0::DOUBLE AS risk, 'no aircraft over the yard' AS reason
  FROM zoned WHERE zone = 'loading_yard' AND label = 'drone'
  UNION ALL SELECT event_id, 1, 'birds', 'allow', 0, 'birds are common' FROM zoned WHERE label = 'bird'
  UNION ALL SELECT event_id, 2, 'cars-by-day', CASE WHEN hour >= 6 AND hour < 22 AND dwell_s <= 200 THEN 'allow' ELSE 'lapse' END,
    CASE WHEN hour >= 6 AND hour < 22 AND dwell_s <= 200 THEN 0 ELSE 0.2 END,
    CASE WHEN NOT (hour >= 6 AND hour < 22) THEN 'vehicle in gate outside permitted hours 06:00-22:00'
         WHEN dwell_s > 200 THEN 'vehicle in gate stationary ' || printf('%.0f', dwell_s) || ' s, over the 200 s limit'
         ELSE 'vehicle expected in gate' END
    FROM zoned WHERE zone = 'gate' AND label = 'vehicle'
  UNION ALL SELECT event_id, 3, 'night', 'forbid', 0.7, 'person not permitted in gate' FROM zoned
    WHERE zone = 'gate' AND label = 'person' AND weekday <= 4 AND (hour >= 22 OR hour < 6)
  UNION ALL SELECT event_id, 4, 'rule-5', 'exceed', 0.85, label || ' in loading_yard stationary ' || printf('%.0f', dwell_s) || ' s, over the 120 s limit'
    FROM zoned WHERE zone = 'loading_yard' AND dwell_s > 120
  UNION ALL SELECT event_id, 5, 'keep-moving', 'exceed', 0.5, 'unknown in gate not moving as expected'
    FROM zoned WHERE zone = 'gate' AND label = 'unknown' AND speed_px < 1.5
), summed AS (
  SELECT event_id, max(risk) AS risk, bool_or(effect <> 'allow') AS forbidden, string_agg(reason, ' | ' ORDER BY ord) AS reasons,
         string_agg(id, ',' ORDER BY ord) AS rule_ids FROM fired GROUP BY event_id
)
SELECT z.site_id, z.event_id, z.zone, coalesce(risk, 0.0)::DOUBLE AS risk,
       CASE WHEN forbidden THEN 'prohibited' WHEN forbidden = false THEN 'permitted' ELSE 'unstated' END AS verdict,
       coalesce(reasons, '') AS reasons, coalesce(rule_ids, '') AS rule_ids, coalesce(NOT forbidden, false) AS suppresses
FROM zoned z LEFT JOIN summed s USING (event_id)""",
)
def policy_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = policies(spark, sf_dir)
    j = policy.judge(objects(spark, sf_dir), zone_table(doc), rule_table(doc))
    return j.select(
        "site_id",
        "event_id",
        "zone",
        F.col("policy.risk").alias("risk"),
        F.col("policy.verdict").alias("verdict"),
        F.array_join("policy.reasons", " | ").alias("reasons"),
        F.array_join("policy.rule_ids", ",").alias("rule_ids"),
        F.col("policy.suppresses_novelty").alias("suppresses"),
    )


SITES_SQL = "sites AS (SELECT DISTINCT user_id % 10 AS site_id FROM events)"


@REGISTRY.add(
    "policy_lint",
    "WITH " + SITES_SQL + """, problems(problem) AS (VALUES
  ('rule ''odd'' references unknown zone ''roof'' - it will never match'),
  ('rule ''odd'' has unknown verdict ''maybe'' - it will be ignored'),
  ('rule ''odd'' severity 1.4 outside 0-1'),
  ('rule ''loose'' is ''restricted'' but states no limit, so nothing can exceed it'),
  ('zone ''strip'' has fewer than 3 points'))
SELECT site_id, problem FROM sites, problems""",
)
def policy_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = policies(spark, sf_dir)
    return policy.lint(zone_table(doc), rule_table(doc))


@REGISTRY.add(
    "policy_lines",
    "WITH " + SITES_SQL + """, lines(ord, line) AS (VALUES
  (0, '[no-air] prohibited drone in loading_yard severity 1.00'), (1, '[birds] permitted  bird in *'),
  (2, '[cars-by-day] permitted  vehicle in gate hours 6-22 max dwell 200s severity 0.40'),
  (3, '[night] prohibited person in gate hours 22-6 severity 0.70'),
  (4, '[rule-5] restricted * in loading_yard max dwell 120s severity 0.85'),
  (5, '[keep-moving] restricted unknown in gate severity 0.50'), (6, '[odd] maybe      * in roof severity 1.40'),
  (7, '[loose] restricted * in strip severity 0.20'))
SELECT site_id, ord, line FROM sites, lines""",
)
def policy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.described(rule_table(policies(spark, sf_dir))).select("site_id", "ord", "line")
