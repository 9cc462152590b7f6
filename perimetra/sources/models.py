"""Learned site models in versions: parts are only ever added, and a version is one manifest file that names its parts.

A part holds cells `(site_id, pos, values)` or, for what a site has one of, rows `(site_id, values)`. It is written first; the manifest comes
last, as a single file that the commit of its writer puts in place at once. A run that dies in between leaves parts that no version names.
Readers take the newest row of each cell among the parts of a version, so an operator's few cells are a small part of their own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from perimetra.operators import controls
from perimetra.operators.site import ACCEPTED_READINGS
from perimetra.params import OPTICAL_SITE, THERMAL_SITE, OpticalSite, ThermalSite

#: What is kept of each kind of model: values of a cell, or of a site where `pos` is absent.
KINDS = {
    "thermal": "site_id long, pos int, ref_mean double, ref_var double, ref_n double",
    "optical": "site_id long, pos int, structure_mean double, tone_mean double, structure_var double, tone_var double, ref_n double",
    "traffic": "site_id long, pos int, activity double",
    "site": "site_id long, frames long, activity_obs long",
    "features": (
        "site_id long, n long, area_mean double, area_var double, speed_mean double, speed_var double, hot_n long, hot_mean double, hot_var double"
    ),
}
MANIFEST = "version long, at_us long, note string, kind string, parts array<struct<path:string,whole:boolean>>"


def names(kind: str) -> list[str]:
    return [c.split()[0] for c in KINDS[kind].split(", ")]


def cells_of(grids: DataFrame, kind: str) -> DataFrame:
    """One row per cell from one row per site with an array for each value."""
    values = names(kind)[2:]
    zipped = F.arrays_zip(*[F.col(v) for v in values])
    return grids.select("site_id", F.posexplode(zipped).alias("pos", "_v")).select("site_id", "pos", *[F.col(f"_v.{v}").alias(v) for v in values])


def grids_of(cells: DataFrame, kind: str) -> DataFrame:
    """One row per site with an array for each value, as long as its grid."""
    values = names(kind)[2:]
    whole = cells.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("pos", *values))).alias("_c"))
    return whole.select("site_id", *[F.col(f"_c.{v}").alias(v) for v in values])


@dataclass
class ModelStore:
    spark: SparkSession
    path: str

    # versions

    def versions(self) -> DataFrame:
        """Every version that was committed: `(version, at_us, note, kind, parts)`, one row for each kind that it has."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/versions/*")
        except AnalysisException:
            return self.spark.createDataFrame([], MANIFEST)

    def newest(self, version: int | None = None, at_us: int | None = None) -> int:
        """The last version, not after a given one or a given time; 0 where there is none."""
        known = self.versions()
        if version is not None:
            known = known.filter(F.col("version") <= version)
        if at_us is not None:
            known = known.filter(F.col("at_us") <= at_us)
        return known.agg(F.max("version")).first()[0] or 0

    def parts(self, kind: str, version: int) -> list[tuple[str, bool]]:
        row = self.versions().filter((F.col("version") == version) & (F.col("kind") == kind)).select("parts").first()
        return [] if row is None else [(p.path, p.whole) for p in row.parts]

    # writing

    def save(self, models: dict[str, DataFrame], at_us: int, note: str = "", whole: bool = True) -> int:
        """Add a version that has these models; other kinds stay as they are.

        With `whole` a model takes the place of all that was known of its sites, and other sites are left alone; without, only of its cells.
        A second writer of the same version fails where it finds the manifest's folder taken.
        """
        now = self.newest()
        named = {kind: self.parts(kind, now) for kind in KINDS}
        for kind, rows in models.items():
            part = f"{self.path}/parts/{kind}-{uuid.uuid4().hex}"
            self.write_part(rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in KINDS[kind].split(", ")]), part)
            named[kind] = [*named[kind], (part, whole)]
        self._commit(now + 1, at_us, note, named)
        return now + 1

    def write_part(self, rows: DataFrame, part: str) -> None:
        rows.write.parquet(part)

    def _commit(self, version: int, at_us: int, note: str, named: dict[str, list[tuple[str, bool]]]) -> None:
        rows = [(version, at_us, note, kind, parts) for kind, parts in named.items() if parts]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{self.path}/versions/version-{version}")

    def compact(self, at_us: int) -> int:
        """A version with the same content in one part for each kind; older versions stay readable."""
        return self._replaced({kind: self.load(kind) for kind in KINDS if self.parts(kind, self.newest())}, at_us)

    def _replaced(self, models: dict[str, DataFrame], at_us: int) -> int:
        now, named = self.newest(), {}
        for kind, rows in models.items():
            part = f"{self.path}/parts/{kind}-{uuid.uuid4().hex}"
            self.write_part(rows, part)
            named[kind] = [(part, True)]
        self._commit(now + 1, at_us, "compacted", named)
        return now + 1

    # reading

    def load(self, kind: str, version: int | None = None, at_us: int | None = None) -> DataFrame:
        """Rows of one kind as they were at a version or time; persistence counters are no part of a model and start at 0."""
        schema, parts = KINDS[kind], self.parts(kind, self.newest(version, at_us))
        if not parts:
            return self.spark.createDataFrame([], schema)
        read = [
            self.spark.read.schema(schema).parquet(path).withColumns({"_part": F.lit(i), "_whole": F.lit(whole)}) for i, (path, whole) in enumerate(parts)
        ]
        rows = read[0]
        if len(read) == 1:
            return rows.drop("_part", "_whole")
        for more in read[1:]:
            rows = rows.unionByName(more)
        # what a site had before its last whole model is gone
        last = rows.filter("_whole").groupBy("site_id").agg(F.max("_part").alias("_from"))
        live = rows.join(last, "site_id", "left").filter(F.col("_part") >= F.coalesce("_from", F.lit(0)))
        keys = [c for c in ("site_id", "pos") if c in names(kind)]
        values = [c for c in names(kind) if c not in keys]
        newest = live.groupBy(*keys).agg(F.max_by(F.struct(*values), "_part").alias("_v"))
        return newest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])

    def grids(self, kind: str, version: int | None = None, at_us: int | None = None) -> DataFrame:
        return grids_of(self.load(kind, version, at_us), kind)

    # an operator's word

    def accept(
        self,
        actions: DataFrame,
        at_us: int,
        thermal: DataFrame | None = None,
        optical: DataFrame | None = None,
        homography: DataFrame | None = None,
        p: ThermalSite = THERMAL_SITE,
        o: OpticalSite = OPTICAL_SITE,
    ) -> int:
        """A version in which accepted boxes hold the newest readings for normal; only their cells are written.

        `actions` are rows of `operator_actions`; boxes go to the model of the sensor that found the object, those in optical pixels also through
        the inverse of `homography` into the thermal model. `thermal(site_id, rel)` and `optical(site_id, structure, tone)` are the newest
        frame of each site; a sensor without one, or a site that was never learned, is left alone.
        """
        said = actions.filter(F.col("action") == "accept")
        changed = {}
        if thermal is not None:
            changed["thermal"] = self._accepted("thermal", controls.for_thermal(said, homography, p), thermal.select("site_id", F.col("rel").alias("_a")), {
                "ref_mean": F.col("_now._a"),
                "ref_var": F.greatest("ref_var", F.lit(p.noise_floor_c**2)),
                "ref_n": F.greatest("ref_n", F.lit(ACCEPTED_READINGS)),
            })
        if optical is not None:
            now = optical.select("site_id", F.col("structure").alias("_a"), F.col("tone").alias("_b"))
            changed["optical"] = self._accepted("optical", controls.for_optical(said, o), now, {
                "structure_mean": F.col("_now._a"),
                "tone_mean": F.col("_now._b"),
                "ref_n": F.greatest("ref_n", F.lit(float(o.min_learned))),
            })
        return self.save(changed, at_us, "accepted", whole=False)

    def _accepted(self, kind: str, boxes: DataFrame, newest: DataFrame, new: dict[str, Column]) -> DataFrame:
        spots = boxes.select("site_id", F.explode("cells").alias("pos")).distinct()
        readings = [c for c in newest.columns if c != "site_id"]
        at_cell = spots.join(newest, "site_id").select("site_id", "pos", F.struct(*[F.get(c, F.col("pos")).alias(c) for c in readings]).alias("_now"))
        seen = at_cell.filter(" AND ".join(f"_now.{c} IS NOT NULL" for c in readings))
        return self.load(kind).join(seen, ["site_id", "pos"]).withColumns(new).select(*names(kind))
