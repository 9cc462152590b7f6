"""Site-model queries: cell statistics, persistence, traffic, novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.operators import intime, site, tracks
from perimetra.operators.scans import asof, chunk_span, ewma
from perimetra.params import OpticalSite, ThermalSite
from perimetra.queries import REGISTRY
from perimetra.queries.tracks import KINEMATICS_SQL
from perimetra.sources.adapters import CELL_FRAMES_SQL, cell_frames, track_obs, track_obs_sql

# The stand-in frames are 8x8 cells and a few dozen per site, so the thresholds shrink with them.
SMALL = ThermalSite(
    min_learned=10, z_enter=2.0, min_dev_c=1.0, persist_s=0.08, adapt_s=1.2, scene_frames=100, grid_rows=8, grid_cols=8, max_region_cells=20
)
SMALL_OPTICAL = OpticalSite(
    min_learned=20, adapt_s=1.2, persist_s=0.04, z_anomalous=2.0, z_full=4.0, grid_rows=8, grid_cols=8, min_region_cells=1, fps=25.0
)

CELLS_SQL = CELL_FRAMES_SQL + """,
cells AS (
  SELECT site_id, frame_idx, generate_subscripts(cells, 1) - 1 AS pos, unnest(cells) AS c FROM cell_frames
), levels AS (
  SELECT site_id, frame_idx, median(c) AS level FROM cells GROUP BY ALL
), rel AS (
  SELECT site_id, frame_idx, pos, c, c - level AS v FROM cells JOIN levels USING (site_id, frame_idx)
)"""

MODEL_SQL = """,
frame_no AS (
  SELECT site_id, frame_idx, row_number() OVER (PARTITION BY site_id ORDER BY frame_idx) AS i,
         count(*) OVER (PARTITION BY site_id) AS n
  FROM cell_frames
), weights AS (
  SELECT *, CASE WHEN n <= 30 THEN 1.0::DOUBLE / n WHEN i <= 30 THEN pow(1 - 1/30.0::DOUBLE, n - 30) / 30
                 ELSE 1/30.0::DOUBLE * pow(1 - 1/30.0::DOUBLE, n - i) END AS w
  FROM frame_no
), model AS (
  SELECT site_id, pos, max(n) AS ref_n, sum(w * v) AS ref_mean, greatest(0, sum(w * v * v) - sum(w * v) * sum(w * v)) AS ref_var
  FROM rel JOIN weights USING (site_id, frame_idx) GROUP BY ALL
), scored AS (
  SELECT site_id, frame_idx, pos, v - ref_mean AS dev,
         CASE WHEN ref_n >= 10 THEN abs(v - ref_mean) / greatest(sqrt(ref_var), 0.35) ELSE 0 END AS z
  FROM rel JOIN model USING (site_id, pos)
), flagged AS (
  SELECT *, (z > 2.0 AND abs(dev) > 1.0) AS odd FROM scored
), reads AS (
  SELECT *, odd AND NOT (avg(odd::INT) OVER (PARTITION BY site_id, frame_idx) > 0.10) AS anom FROM flagged
)"""

PERSIST_SQL = """,
stepped AS (
  SELECT *, sum(CASE WHEN anom THEN 1 ELSE -3 END) OVER (PARTITION BY site_id, pos ORDER BY frame_idx) AS s,
         bool_or(anom) OVER (PARTITION BY site_id, pos) AS ever
  FROM reads
), persisted AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY site_id, pos ORDER BY frame_idx)) AS persist FROM stepped WHERE ever
)"""


def rel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_frames(spark, sf_dir).withColumn("rel", site.relative(F.col("cells")))


def small_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    frames = rel_frames(spark, sf_dir)
    span = chunk_span(frames)
    return site.read_against(frames, site.fit_site_model(frames, SMALL, span), SMALL), span


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@REGISTRY.add(
    "cell_means",
    "WITH " + CELLS_SQL + """
SELECT site_id, frame_idx, ((pos // 8) // 2) * 4 + (pos % 8) // 2 AS cell, round(avg(c), 6) AS mean_c FROM cells GROUP BY ALL""",
)
def cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cell_frames(spark, sf_dir).withColumn("g", site.grid_means(F.col("cells"), 8, 8, 2))
    return g.select("site_id", "frame_idx", F.posexplode("g").alias("p", "mean_c")).select(
        "site_id", "frame_idx", F.col("p").cast("long").alias("cell"), *r6("mean_c")
    )


def exploded(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.select("site_id", "frame_idx", F.posexplode(value).alias("p", out)).select(
        "site_id", "frame_idx", F.col("p").cast("long").alias("pos"), *r6(out)
    )


@REGISTRY.add("relative_cells", "WITH " + CELLS_SQL + " SELECT site_id, frame_idx, pos, round(v, 6) AS rel_c FROM rel")
def relative_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(rel_frames(spark, sf_dir), "rel", "rel_c")


@REGISTRY.add(
    "tone_cells",
    "WITH " + CELLS_SQL + """
, spread AS (SELECT site_id, frame_idx, 1.4826 * median(abs(v)) AS mad FROM rel GROUP BY ALL)
SELECT site_id, frame_idx, pos, round(v / greatest(mad, 1e-3), 6) AS tone FROM rel JOIN spread USING (site_id, frame_idx)""",
)
def tone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(cell_frames(spark, sf_dir).withColumn("t", site.tone(F.col("cells"))), "t", "tone")


@REGISTRY.add(
    "structure_cells",
    "WITH " + CELLS_SQL + """
, px AS (SELECT *, pos // 8 AS y, pos % 8 AS x FROM cells
), ring AS (
  SELECT p.site_id, p.frame_idx, p.pos, p.y, p.x, dx, dy, q.c
  FROM px p, range(-1, 2) a(dx), range(-1, 2) b(dy), px q
  WHERE q.site_id = p.site_id AND q.frame_idx = p.frame_idx
    AND q.x = CASE WHEN p.x + dx < 0 THEN 1 WHEN p.x + dx > 7 THEN 6 ELSE p.x + dx END
    AND q.y = CASE WHEN p.y + dy < 0 THEN 1 WHEN p.y + dy > 7 THEN 6 ELSE p.y + dy END
), grad AS (
  SELECT site_id, frame_idx, pos, y, x, sum(c * dx * (2 - abs(dy))) AS gx, sum(c * dy * (2 - abs(dx))) AS gy FROM ring GROUP BY ALL
), cell AS (
  SELECT site_id, frame_idx, (y // 2) * 4 + x // 2 AS cell, avg(sqrt(gx * gx + gy * gy)) AS g FROM grad GROUP BY ALL
)
SELECT site_id, frame_idx, cell AS pos, round(g / greatest(median(g) OVER (PARTITION BY site_id, frame_idx), 1e-3), 6) AS structure FROM cell""",
)
def structure_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(cell_frames(spark, sf_dir).withColumn("s", site.structure(F.col("cells"), 8, 8, 2)), "s", "structure")


@REGISTRY.add(
    "running_moments",
    "WITH " + CELLS_SQL + """
SELECT site_id, frame_idx, pos, count(*) OVER w AS n, round(avg(v) OVER w, 6) AS mean, round(var_pop(v) OVER w, 6) AS var
FROM rel WINDOW w AS (PARTITION BY site_id, pos ORDER BY frame_idx)""",
)
def running_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rel_frames(spark, sf_dir)
    long = frames.select("site_id", "frame_idx", F.posexplode("rel").alias("p", "v")).withColumn("pos", F.col("p").cast("long")).drop("p")
    m = site.running_moments(long, ["site_id", "pos"], "v", span=chunk_span(frames))
    return m.select("site_id", "frame_idx", "pos", "n", *r6("mean", "var"))


@REGISTRY.add(
    "site_model_fit",
    "WITH " + CELLS_SQL + MODEL_SQL + """
SELECT site_id, pos, ref_n::DOUBLE AS ref_n, round(ref_mean, 6) AS ref_mean, round(ref_var, 6) AS ref_var FROM model""",
)
def site_model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rel_frames(spark, sf_dir)
    m = site.fit_site_model(frames, SMALL, chunk_span(frames))
    return m.select("site_id", F.posexplode(F.arrays_zip("ref_n", "ref_mean", "ref_var")).alias("p", "m")).select(
        "site_id",
        F.col("p").cast("long").alias("pos"),
        "m.ref_n",
        F.round("m.ref_mean", 6).alias("ref_mean"),
        F.round("m.ref_var", 6).alias("ref_var"),
    )


@REGISTRY.add(
    "cell_zscores",
    "WITH " + CELLS_SQL + MODEL_SQL + " SELECT site_id, frame_idx, pos, round(z, 6) AS z, anom FROM reads",
)
def cell_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, _ = small_reads(spark, sf_dir)
    return reads.select("site_id", "frame_idx", F.posexplode(F.arrays_zip("z", "anom")).alias("p", "m")).select(
        "site_id", "frame_idx", F.col("p").cast("long").alias("pos"), F.round("m.z", 6).alias("z"), "m.anom"
    )


@REGISTRY.add(
    "thermal_persistence",
    "WITH " + CELLS_SQL + MODEL_SQL + PERSIST_SQL + " SELECT site_id, frame_idx, pos, persist::BIGINT AS persist FROM persisted",
)
def thermal_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, span = small_reads(spark, sf_dir)
    p = site.persistence(reads, SMALL, span)
    return p.select("site_id", "frame_idx", F.col("pos").cast("long").alias("pos"), "persist")


@REGISTRY.add(
    "optical_persistence",
    "WITH " + CELLS_SQL + """
, placed AS (SELECT *, row_number() OVER w AS i FROM rel WINDOW w AS (PARTITION BY site_id, pos ORDER BY frame_idx))
SELECT site_id, frame_idx, pos,
       i - coalesce(max(CASE WHEN NOT abs(v) > 0.5 THEN i END) OVER (PARTITION BY site_id, pos ORDER BY frame_idx), 0) AS persist
FROM placed""",
)
def optical_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rel_frames(spark, sf_dir)
    long = frames.select("site_id", "frame_idx", F.posexplode("rel").alias("p", "v")).withColumn("pos", F.col("p").cast("long"))
    runs = site.hot_runs(long, ["site_id", "pos"], F.abs("v") > 0.5, span=chunk_span(frames))
    return runs.select("site_id", "frame_idx", "pos", "persist")


@REGISTRY.add(
    "optical_activity",
    "WITH RECURSIVE " + CELLS_SQL + """
, placed AS (SELECT site_id, frame_idx, pos, (abs(v) > 0.5)::INT AS hot, row_number() OVER w AS i FROM rel
             WINDOW w AS (PARTITION BY site_id, pos ORDER BY frame_idx)
), walk AS (
  SELECT site_id, frame_idx, pos, i, 0.01::DOUBLE * hot AS a FROM placed WHERE i = 1
  UNION ALL
  SELECT p.site_id, p.frame_idx, p.pos, p.i, w.a + 0.01::DOUBLE * (p.hot - w.a)
  FROM walk w JOIN placed p ON p.site_id = w.site_id AND p.pos = w.pos AND p.i = w.i + 1
)
SELECT site_id, frame_idx, pos, round(a, 6) AS activity FROM walk""",
)
def optical_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rel_frames(spark, sf_dir)
    long = frames.select("site_id", "frame_idx", F.posexplode("rel").alias("p", "v")).withColumn("pos", F.col("p").cast("long"))
    hot = F.when(F.abs("v") > 0.5, 1.0).otherwise(0.0)
    a = ewma(long, ["site_id", "pos"], ["frame_idx"], hot, 0.01, "activity")
    return a.select("site_id", "frame_idx", "pos", *r6("activity"))


LEARN_SQL = """
, ordered AS (
  SELECT site_id, frame_idx, row_number() OVER (PARTITION BY site_id ORDER BY frame_idx) AS i,
         list_transform(cells, lambda c: c - level) AS rel
  FROM cell_frames JOIN levels USING (site_id, frame_idx)
), walk AS (
  SELECT site_id, 0::BIGINT AS frame_idx, 0::BIGINT AS i, list_transform(range(64), lambda x: 0.0::DOUBLE) AS m,
         list_transform(range(64), lambda x: 0.0::DOUBLE) AS va, list_transform(range(64), lambda x: 0.0::DOUBLE) AS n,
         list_transform(range(64), lambda x: 0::BIGINT) AS p, list_transform(range(64), lambda x: 0.0::DOUBLE) AS z
  FROM ordered GROUP BY site_id
  UNION ALL
  SELECT site_id, frame_idx, i,
         list_transform(range(64), lambda k: m[k+1] + rate[k+1] * dev[k+1]),
         list_transform(range(64), lambda k: (1 - rate[k+1]) * (va[k+1] + rate[k+1] * dev[k+1] * dev[k+1])),
         n2,
         list_transform(range(64), lambda k: CASE WHEN anom[k+1] THEN p[k+1] + 1 ELSE greatest(p[k+1] - 3, 0) END),
         z2
  FROM (
    SELECT *, list_transform(range(64), lambda k: CASE WHEN anom[k+1] THEN (1/30.0::DOUBLE) / 40
                     ELSE greatest(1.0::DOUBLE / greatest(n2[k+1], 1), 1/30.0::DOUBLE) END) AS rate
    FROM (
      SELECT *, list_transform(range(64), lambda k: n[k+1] + CASE WHEN anom[k+1] THEN 0 ELSE 1 END) AS n2
      FROM (
        SELECT *, list_transform(odd, lambda o: o AND NOT (len(list_filter(odd, lambda q: q)) / 64.0 > 0.10)) AS anom
        FROM (
          SELECT *, list_transform(range(64), lambda k: z2[k+1] > 2.0 AND abs(dev[k+1]) > 1.0) AS odd
          FROM (
            SELECT o.site_id, o.frame_idx, o.i, w.m, w.va, w.n, w.p, o.rel,
                   list_transform(range(64), lambda k: o.rel[k+1] - w.m[k+1]) AS dev,
                   list_transform(range(64), lambda k: CASE WHEN w.n[k+1] >= 10
                       THEN abs(o.rel[k+1] - w.m[k+1]) / greatest(sqrt(w.va[k+1]), 0.35) ELSE 0 END::DOUBLE) AS z2
            FROM walk w JOIN ordered o ON o.site_id = w.site_id AND o.i = w.i + 1
          )
        )
      )
    )
  )
)"""


LEARNED_SQL = "WITH RECURSIVE " + CELLS_SQL + LEARN_SQL + """
SELECT site_id, frame_idx, round(list_max(z), 6) AS top_z, list_max(p)::BIGINT AS longest, list_sum(p)::BIGINT AS persist_sum
FROM walk WHERE i > 0"""


def learned(spark: SparkSession, sf_dir: str, span: int) -> DataFrame:
    return intime.learn_frames(rel_frames(spark, sf_dir), SMALL, span).select(
        "site_id",
        "frame_idx",
        F.round(F.array_max("z"), 6).alias("top_z"),
        F.array_max("persist").alias("longest"),
        F.aggregate("persist", F.lit(0).cast("long"), lambda a, v: a + v).alias("persist_sum"),
    )


@REGISTRY.add("learned_site", LEARNED_SQL)
def learned_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned(spark, sf_dir, intime.SPAN)


@REGISTRY.add("learned_site_spread", LEARNED_SQL)
def learned_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in chunks of 16 frames, each a task of its own."""
    return learned(spark, sf_dir, 16)


OPTICAL_SQL = """
, spread AS (SELECT site_id, frame_idx, 1.4826 * median(abs(v)) AS mad FROM rel GROUP BY ALL
), ordered AS (
  SELECT site_id, frame_idx, pos, c / 20.0::DOUBLE AS s, v / greatest(mad, 1e-3) AS t,
         row_number() OVER (PARTITION BY site_id, pos ORDER BY frame_idx) AS i
  FROM rel JOIN spread USING (site_id, frame_idx)
), walk AS (
  SELECT site_id, pos, 0::BIGINT AS frame_idx, 0::BIGINT AS i, 0.0::DOUBLE AS sm, 0.0::DOUBLE AS sv, 0.0::DOUBLE AS tm, 0.0::DOUBLE AS tv,
         0.0::DOUBLE AS n, 0::BIGINT AS p, 0.0::DOUBLE AS act, 0.0::DOUBLE AS z
  FROM ordered WHERE i = 1
  UNION ALL
  SELECT site_id, pos, frame_idx, i, sm + a * (s - sm), sv + a * (least((s - sm) * (s - sm), 16 * sg * sg) - sv),
         tm + a * (t - tm), tv + a * (least((t - tm) * (t - tm), 16 * tg * tg) - tv),
         n + CASE WHEN hot THEN 0.05 ELSE 1 END, CASE WHEN hot THEN p + 1 ELSE 0 END,
         act + 0.01::DOUBLE * (hot::INT - act), z2
  FROM (
    SELECT *, greatest(1 / (n + 1), 1/30.0::DOUBLE) * CASE WHEN hot THEN 0.05 ELSE 1 END AS a
    FROM (
      SELECT *, z2 > 2.0 AS hot
      FROM (
        SELECT *, CASE WHEN n >= 8 THEN greatest(abs(s - sm) / sg, abs(t - tm) / tg) ELSE 0 END::DOUBLE AS z2
        FROM (
          SELECT o.site_id, o.pos, o.frame_idx, o.i, o.s, o.t, w.sm, w.sv, w.tm, w.tv, w.n, w.p, w.act,
                 greatest(sqrt(w.sv), 0.10) AS sg, greatest(sqrt(w.tv), 0.15) AS tg
          FROM walk w JOIN ordered o ON o.site_id = w.site_id AND o.pos = w.pos AND o.i = w.i + 1
        )
      )
    )
  )
)"""


def small_optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = cell_frames(spark, sf_dir).select(
        "site_id",
        "frame_idx",
        F.transform("cells", lambda v: v / 20.0).alias("structure"),
        site.tone(F.col("cells")).alias("tone"),
    )
    return site.optical_cells(site.learn_optical(frames, 16, SMALL_OPTICAL), 16)


@REGISTRY.add(
    "learned_optical",
    "WITH RECURSIVE " + CELLS_SQL + OPTICAL_SQL + """
SELECT site_id, frame_idx, pos, round(z, 5) AS z, p AS persist, round(act, 6) AS activity, round(n, 6) AS ref_n FROM walk WHERE i > 0""",
)
def learned_optical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_optical(spark, sf_dir).select(
        "site_id", "frame_idx", F.col("pos").cast("long").alias("pos"), F.round("z", 5).alias("z"), "persist", *r6("activity", "ref_n")
    )


TRAFFIC_SQL = """
, placed AS (
  SELECT *, least(greatest(floor(trunc(cy) / 8), 0), 23)::BIGINT AS gy, least(greatest(floor(trunc(cx) / 8), 0), 31)::BIGINT AS gx FROM kinematics
), activity AS (
  SELECT site_id, gy, gx, count(*) AS activity FROM placed WHERE hits >= 2 AND speed_px >= 0.5 GROUP BY ALL
)"""

NEAR_SQL = """
, grid AS (SELECT s.site_id, y.gy, x.gx, coalesce(a.activity, 0) AS activity
  FROM (SELECT DISTINCT site_id FROM activity) s, range(24) y(gy), range(32) x(gx)
  LEFT JOIN activity a ON a.site_id = s.site_id AND a.gy = y.gy AND a.gx = x.gx
), near AS (
  SELECT g.site_id, g.gy, g.gx, sum(n.activity)::DOUBLE AS familiar
  FROM grid g, range(-2, 3) a(dy), range(-2, 3) b(dx), grid n
  WHERE n.site_id = g.site_id
    AND n.gy = CASE WHEN abs(g.gy + dy) >= 24 THEN 46 - abs(g.gy + dy) ELSE abs(g.gy + dy) END
    AND n.gx = CASE WHEN abs(g.gx + dx) >= 32 THEN 62 - abs(g.gx + dx) ELSE abs(g.gx + dx) END
  GROUP BY ALL
)"""

KIN = "WITH " + track_obs_sql() + "," + KINEMATICS_SQL


def roaming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int | None]:
    """Moving objects, and the span for scans of single tracks."""
    obs = track_obs(spark, sf_dir)
    span = chunk_span(obs, keys=tracks.TRACK)
    return tracks.kinematics(obs, span=span).withColumn("hotspot_c", F.col("peak_c") - F.col("mean_c")), span


@REGISTRY.add("activity_grid", KIN + TRAFFIC_SQL + " SELECT site_id, gy, gx, activity FROM activity")
def activity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = roaming(spark, sf_dir)
    a = site.activity_cells(site.traffic(k))
    return a.select("site_id", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), "activity")


def grids(k: DataFrame) -> DataFrame:
    return site.traffic_grids(site.activity_grid(site.activity_cells(site.traffic(k))))


@REGISTRY.add("activity_neighbourhood", KIN + TRAFFIC_SQL + NEAR_SQL + " SELECT site_id, gy * 32 + gx AS pos, familiar FROM near")
def activity_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = roaming(spark, sf_dir)
    return grids(k).select("site_id", F.posexplode("familiar").alias("p", "familiar")).select(
        "site_id", F.col("p").cast("long").alias("pos"), "familiar"
    )


PATH_SQL = """
, counted AS (
  SELECT p.*, coalesce(n.familiar, 0) AS c FROM placed p LEFT JOIN near n ON n.site_id = p.site_id AND n.gy = p.gy AND n.gx = p.gx
), paths AS (
  SELECT *, avg(c) OVER (PARTITION BY site_id, track_id ORDER BY frame_idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS path_count FROM counted
)"""


@REGISTRY.add(
    "path_familiarity",
    KIN + TRAFFIC_SQL + NEAR_SQL + PATH_SQL + """
SELECT site_id, track_id, frame_idx, round(path_count, 6) AS path_count, round(1 - exp(-path_count / 20.0), 6) AS familiarity FROM paths""",
)
def path_familiarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, span = roaming(spark, sf_dir)
    p = site.path_familiarity(k, grids(k), span=span)
    return p.select("site_id", "track_id", "frame_idx", *r6("path_count", "familiarity"))


FEATURE_SQL = """
, moving AS (
  SELECT *, log10(greatest(area, 1)) AS la, row_number() OVER w AS i, count(*) OVER (PARTITION BY site_id) AS n_all
  FROM kinematics WHERE hits >= 2 AND speed_px >= 0.5 WINDOW w AS (PARTITION BY site_id ORDER BY frame_idx, track_id)
), everything AS (
  SELECT *, peak_c - mean_c AS hot, row_number() OVER w AS i, count(*) OVER (PARTITION BY site_id) AS n_all
  FROM kinematics WINDOW w AS (PARTITION BY site_id ORDER BY frame_idx, track_id)
), mw AS (
  SELECT *, CASE WHEN n_all <= 3000 THEN 1.0::DOUBLE / n_all WHEN i <= 3000 THEN pow(1 - 1/3000.0::DOUBLE, n_all - 3000) / 3000
            ELSE 1/3000.0::DOUBLE * pow(1 - 1/3000.0::DOUBLE, n_all - i) END AS w FROM moving
), ew AS (
  SELECT *, CASE WHEN n_all <= 3000 THEN 1.0::DOUBLE / n_all WHEN i <= 3000 THEN pow(1 - 1/3000.0::DOUBLE, n_all - 3000) / 3000
            ELSE 1/3000.0::DOUBLE * pow(1 - 1/3000.0::DOUBLE, n_all - i) END AS w FROM everything
), size_speed AS (
  SELECT site_id, count(*) AS activity_obs, sum(w * la) AS area_mean, greatest(0, sum(w * la * la) - sum(w * la) * sum(w * la)) AS area_var,
         sum(w * speed_px) AS speed_mean, greatest(0, sum(w * speed_px * speed_px) - sum(w * speed_px) * sum(w * speed_px)) AS speed_var
  FROM mw GROUP BY site_id
), heat AS (
  SELECT site_id, sum(w * hot) AS hot_mean, greatest(0, sum(w * hot * hot) - sum(w * hot) * sum(w * hot)) AS hot_var FROM ew GROUP BY site_id
), zs AS (
  SELECT k.*, abs(log10(greatest(area, 1)) - coalesce(area_mean, 0)) / greatest(sqrt(coalesce(area_var, 0)), 0.15) AS z_size,
         abs(speed_px - coalesce(speed_mean, 0)) / greatest(sqrt(coalesce(speed_var, 0)), 0.4) AS z_speed,
         abs(peak_c - mean_c - hot_mean) / greatest(sqrt(hot_var), 0.8) AS z_heat,
         least(1, coalesce(activity_obs, 0) / 1500.0::DOUBLE) AS activity_maturity
  FROM kinematics k JOIN heat USING (site_id) LEFT JOIN size_speed USING (site_id)
), novel AS (
  SELECT *, greatest(z_size, z_speed, z_heat) AS worst_z,
         CASE WHEN z_size >= greatest(z_speed, z_heat) THEN 'size' WHEN z_speed >= z_heat THEN 'speed' ELSE 'heat' END AS worst,
         CASE WHEN activity_maturity > 0.25 THEN least(1, greatest(z_size, z_speed, z_heat) / 4.0) * activity_maturity ELSE 0 END AS feature
  FROM zs
)"""


@REGISTRY.add(
    "feature_novelty",
    KIN + FEATURE_SQL + " SELECT site_id, track_id, frame_idx, worst, round(worst_z, 5) AS worst_z, round(feature, 5) AS feature FROM novel",
)
def feature_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = roaming(spark, sf_dir)
    f = site.feature_novelty(k, site.feature_stats(site.traffic(k), k, span=chunk_span(track_obs(spark, sf_dir))))
    return f.select("site_id", "track_id", "frame_idx", "worst", F.round("worst_z", 5).alias("worst_z"), F.round("feature", 5).alias("feature"))


SCORE_SQL = """
, latest AS (
  SELECT p.*, r.cell_frame
  FROM paths p ASOF LEFT JOIN (SELECT site_id, frame_idx AS cell_frame, frame_idx FROM cell_frames) r
    ON p.site_id = r.site_id AND p.frame_idx >= r.frame_idx
), joined AS (
  SELECT l.*, coalesce(q.z, 0) AS z, coalesce(pp.persist, 0) AS persist, n.activity_maturity, n.feature, n.worst, n.worst_z,
         l.cx % 30.0::DOUBLE AS dwell_s, coalesce(least(1, m.frames / 100.0::DOUBLE), 0) AS scene_maturity
  FROM latest l
  JOIN novel n ON n.site_id = l.site_id AND n.track_id = l.track_id AND n.frame_idx = l.frame_idx
  LEFT JOIN reads q ON q.site_id = l.site_id AND q.frame_idx = l.cell_frame AND q.pos = (l.gy // 3) * 8 + l.gx // 4
  LEFT JOIN persisted pp ON pp.site_id = l.site_id AND pp.frame_idx = l.cell_frame AND pp.pos = (l.gy // 3) * 8 + l.gx // 4
  LEFT JOIN (SELECT site_id, count(*) AS frames FROM cell_frames GROUP BY 1) m ON m.site_id = l.site_id
), channels AS (
  SELECT *, (1 - (1 - exp(-path_count / 20.0))) * activity_maturity AS position,
         least(1, z / 8.0) * scene_maturity * least(1, persist / 2.0::DOUBLE) AS appearance
  FROM joined
), full_channels AS (
  SELECT *, CASE WHEN dwell_s > 5 THEN least(1, (dwell_s - 5) / 15.0) * (0.35 + 0.65 * position) ELSE 0 END AS dwell FROM channels
)"""


@REGISTRY.add(
    "site_score",
    KIN + TRAFFIC_SQL + NEAR_SQL + PATH_SQL + FEATURE_SQL + "," + CELLS_SQL + MODEL_SQL + PERSIST_SQL + SCORE_SQL + """
SELECT site_id, track_id, frame_idx, round(position, 5) AS position, round(appearance, 5) AS appearance, round(feature, 5) AS feature,
       round(dwell, 5) AS dwell, round(0.8 * greatest(position, appearance, feature, dwell) + 0.05 * (position + appearance + feature + dwell), 5) AS site_risk
FROM full_channels""",
)
def site_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_tracks(spark, sf_dir).select(
        "site_id", "track_id", "frame_idx", *[F.round(c, 5).alias(c) for c in ("position", "appearance", "feature", "dwell", "site_risk")]
    )


def scored_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track observations with all four novelty channels against the latest cell frame of their site."""
    k, span = roaming(spark, sf_dir)
    site_span = chunk_span(track_obs(spark, sf_dir))
    novel = site.feature_novelty(
        site.path_familiarity(k, grids(k), span=span), site.feature_stats(site.traffic(k), k, span=site_span)
    )
    reads, frame_span = small_reads(spark, sf_dir)
    seen = asof(novel, cell_frames(spark, sf_dir).select("site_id", "frame_idx"), ["site_id"], "frame_idx", "_cell", site_span)
    pos = (F.least(F.greatest(F.floor(F.col("cy").cast("long") / 24), F.lit(0)), F.lit(7)) * 8 + F.floor(F.col("cx").cast("long") / 32)).cast("int")
    seen = seen.withColumns({"cell_frame": F.col("_cell.frame_idx"), "pos": pos}).drop("_cell")
    z = reads.select("site_id", F.col("frame_idx").alias("cell_frame"), F.col("z").alias("zs"))
    persist = site.persistence(reads, SMALL, frame_span).select("site_id", F.col("frame_idx").alias("cell_frame"), "pos", "persist")
    frames = cell_frames(spark, sf_dir).groupBy("site_id").agg(F.count(F.lit(1)).alias("frames"))
    joined = (
        seen.join(z, ["site_id", "cell_frame"], "left")
        .join(persist, ["site_id", "cell_frame", "pos"], "left")
        .join(frames, "site_id", "left")
        .withColumns(
            {
                "z": F.coalesce(F.get("zs", F.col("pos")), F.lit(0.0)),
                "persist": F.coalesce("persist", F.lit(0)),
                "scene_maturity": F.coalesce(F.least(F.lit(1.0), F.col("frames") / 100.0), F.lit(0.0)),
                "dwell_s": F.pmod("cx", F.lit(30.0)),
            }
        )
        .drop("zs")
    )
    return site.score(joined, SMALL)


@REGISTRY.add(
    "model_maturity",
    KIN + TRAFFIC_SQL + "," + CELLS_SQL + MODEL_SQL + """
, obs AS (SELECT site_id, sum(activity) AS obs FROM activity GROUP BY 1)
SELECT m.site_id, max(ref_n) AS frames, round(least(1, max(ref_n) / 100.0::DOUBLE), 6) AS scene_maturity,
       round(least(1, coalesce(max(obs), 0) / 1500.0::DOUBLE), 6) AS activity_maturity, round(avg(least(ref_n / 10.0::DOUBLE, 1)), 6) AS coverage,
       count(*) FILTER (ref_n < 10) AS blind_cells,
       round(least(45.0 / 90.0, avg(least(ref_n / 10.0::DOUBLE, 1))), 6)::DOUBLE AS progress
FROM model m LEFT JOIN obs o ON o.site_id = m.site_id GROUP BY m.site_id""",
)
def model_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, _ = roaming(spark, sf_dir)
    frames = rel_frames(spark, sf_dir)
    obs = site.activity_cells(site.traffic(k)).groupBy("site_id").agg(F.sum("activity").alias("activity_obs"))
    m = site.maturity(site.fit_site_model(frames, SMALL, chunk_span(frames)), obs, SMALL)
    progress = site.learning_progress(F.lit(45.0), F.lit(90.0), F.col("coverage"), F.lit(0.0))
    return m.select(
        "site_id",
        "frames",
        *r6("scene_maturity", "activity_maturity", "coverage"),
        F.col("blind_cells").cast("long").alias("blind_cells"),
        F.round(progress, 6).alias("progress"),
    )


@REGISTRY.add(
    "accept_cells",
    "WITH " + CELLS_SQL + MODEL_SQL + """
, newest AS (SELECT site_id, max(frame_idx) AS frame_idx FROM cell_frames GROUP BY 1
), act AS (SELECT site_id, frame_idx % 50 AS x, frame_idx % 30 AS y, 9 AS w, 9 AS h FROM cell_frames WHERE frame_idx % 25 = 0
), hit AS (
  SELECT DISTINCT a.site_id, gy * 8 + gx AS pos FROM act a, range(8) r(gy), range(8) s(gx)
  WHERE gy BETWEEN least(y // 8, 7) AND least((y + h) // 8 + 1, 8) - 1 AND gx BETWEEN least(x // 8, 7) AND least((x + w) // 8 + 1, 8) - 1
)
SELECT m.site_id, m.pos, round(CASE WHEN h.pos IS NULL THEN ref_mean ELSE r.v END, 6) AS ref_mean,
       round(CASE WHEN h.pos IS NULL THEN ref_var ELSE greatest(ref_var, 0.1225) END, 6) AS ref_var
FROM model m JOIN newest n ON n.site_id = m.site_id JOIN rel r ON r.site_id = m.site_id AND r.frame_idx = n.frame_idx AND r.pos = m.pos
LEFT JOIN hit h ON h.site_id = m.site_id AND h.pos = m.pos""",
)
def accept_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = rel_frames(spark, sf_dir)
    f = F.col("frame_idx")
    actions = frames.filter(f % 25 == 0).select(
        "site_id", (f % 50).alias("x"), (f % 30).alias("y"), F.lit(9).alias("w"), F.lit(9).alias("h")
    )
    current = frames.groupBy("site_id").agg(F.max_by("rel", "frame_idx").alias("rel"))
    m = site.accept(site.fit_site_model(frames, SMALL, chunk_span(frames)), current, actions, SMALL)
    return m.select("site_id", F.posexplode(F.arrays_zip("ref_mean", "ref_var")).alias("p", "m")).select(
        "site_id", F.col("p").cast("long").alias("pos"), F.round("m.ref_mean", 6).alias("ref_mean"), F.round("m.ref_var", 6).alias("ref_var")
    )


@REGISTRY.add(
    "optical_box_novelty",
    "WITH RECURSIVE " + CELLS_SQL + OPTICAL_SQL + """
, box AS (SELECT l_partkey * 100 + l_linenumber AS box_id, l_orderkey % (SELECT count(*) FROM embeddings) AS frame_idx, l_partkey % 200 AS x, l_suppkey % 200 AS y, 10 + l_linenumber * 9 AS w, 40 AS h,
          row_number() OVER (PARTITION BY l_partkey * 100 + l_linenumber, l_orderkey % (SELECT count(*) FROM embeddings) ORDER BY l_orderkey) AS r FROM lineitem
), seen AS (
  SELECT w.site_id, b.frame_idx, b.box_id, max(w.z) AS peak_z, count(*) FILTER (p >= 1) AS settled
  FROM (SELECT DISTINCT box_id, frame_idx, x, y, w, h FROM box) b JOIN walk w ON w.frame_idx = b.frame_idx AND w.i > 0
    AND w.pos // 8 BETWEEN b.y // 32 AND least(8, (b.y + b.h) // 32 + 1) - 1 AND w.pos % 8 BETWEEN b.x // 32 AND least(8, (b.x + b.w) // 32 + 1) - 1
  GROUP BY ALL
)
SELECT site_id, frame_idx, box_id, round(peak_z, 4) AS peak_z,
  round(CASE WHEN settled > 0 THEN greatest(0.75, least(1, (peak_z - 2.0) / 2.0)) ELSE greatest(0, least(1, (peak_z - 2.0) / 2.0)) END, 4)::DOUBLE AS novelty
FROM seen""",
)
def optical_box_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perimetra.sources.adapters import table

    c = F.col
    seen = table(spark, sf_dir, "embeddings").count()
    b = table(spark, sf_dir, "lineitem").select(
        (c("l_partkey") * 100 + c("l_linenumber")).alias("box_id"), (c("l_orderkey") % seen).alias("frame_idx"), (c("l_partkey") % 200).alias("x"),
        (c("l_suppkey") % 200).alias("y"), (10 + c("l_linenumber") * 9).alias("w"), F.lit(40).alias("h"),
    ).repartition("frame_idx", "box_id").distinct()
    sites = cell_frames(spark, sf_dir).select("site_id", "frame_idx")
    n = site.optical_box_novelty(b.join(sites, "frame_idx"), small_optical(spark, sf_dir), SMALL_OPTICAL)
    return n.select("site_id", "frame_idx", "box_id", F.round("peak_z", 4).alias("peak_z"), F.round("optical_novelty", 4).alias("novelty"))
