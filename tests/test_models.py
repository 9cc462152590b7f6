"""Versions of learned models: what is saved, accepted and read back."""

import pytest
from test_controls import acted

from perimetra.params import OpticalSite, ThermalSite
from perimetra.sources.models import ModelStore, cells_of

P = ThermalSite(grid_rows=4, grid_cols=5, cell_px=8)
O = OpticalSite(grid_rows=4, grid_cols=5, cell_px=32)


def thermal(spark, *sites, mean=1.0):
    rows = [(s, [mean + k for k in range(20)], [0.01] * 20, [5.0] * 20) for s in sites]
    return cells_of(spark.createDataFrame(rows, "site_id long, ref_mean array<double>, ref_var array<double>, ref_n array<double>"), "thermal")


def optical(spark, *sites):
    kinds = "structure_mean tone_mean structure_var tone_var ref_n".split()
    rows = [(s, *[[float(k)] * 20 for k in range(5)]) for s in sites]
    return cells_of(spark.createDataFrame(rows, "site_id long, " + ", ".join(f"{k} array<double>" for k in kinds)), "optical")


def held(df):
    return {(r.site_id, r.pos): tuple(r)[2:] for r in df.collect()}


def test_save_accept_and_load_change_only_the_accepted_cells(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.newest() == 0 and store.load("thermal").collect() == []
    assert store.save({"thermal": thermal(spark, 1, 2), "optical": optical(spark, 1, 2)}, 100, "learned") == 1
    h = spark.createDataFrame([(1, [4.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 1.0])], "site_id long, h array<double>")
    box = {"action": "accept", "frame_idx": 5, "t_us": 150}
    acts = acted(
        spark,
        {"site_id": 1, **box, "sensor": "optical", "x": 70.0, "y": 33.0, "w": 20.0, "h": 20.0},  # cell 7 of both grids
        {"site_id": 2, **box, "sensor": "optical", "x": 0.0, "y": 0.0, "w": 4.0, "h": 4.0},  # no way into the thermal grid
        {"site_id": 2, **box, "sensor": "thermal", "x": 33.0, "y": 1.0, "w": 1.0, "h": 1.0},  # cell 4
        {"site_id": 9, **box, "sensor": "thermal", "x": 1.0, "y": 1.0, "w": 1.0, "h": 1.0},  # never learned
        {"site_id": 1, "frame_idx": 6, "t_us": 160, "action": "clear", "key": "x"},
    )
    now_t = spark.createDataFrame([(s, [50.0 + k for k in range(20)]) for s in (1, 2, 9)], "site_id long, rel array<double>")
    now_o = spark.createDataFrame([(1, [9.0] * 20, [8.0] * 20)], "site_id long, structure array<double>, tone array<double>")
    assert store.accept(acts, 200, now_t, now_o, h, P, O) == 2

    before, after = held(store.load("thermal", version=1)), held(store.load("thermal"))
    assert {k: v for k, v in after.items() if before[k] != v} == {(1, 7): (57.0, 0.35**2, 10.0), (2, 4): (54.0, 0.35**2, 10.0)}
    before, after = held(store.load("optical", at_us=199)), held(store.load("optical"))
    assert {k: v for k, v in after.items() if before[k] != v} == {(1, 7): (9.0, 8.0, 2.0, 3.0, float(O.min_learned))}  # site 2 has no newest frame
    written = [spark.read.parquet(path).count() for path, whole in store.parts("thermal", 2) if not whole]
    assert written == [2]
    grid = {r.site_id: r for r in store.grids("thermal").collect()}
    assert len(grid[1].ref_mean) == 20 and grid[1].ref_mean[7] == 57.0 and grid[1].ref_mean[6] == 7.0
    assert store.compact(300) == 3 and held(store.load("thermal")) == held(store.load("thermal", version=2)) and len(store.parts("thermal", 3)) == 1
    assert held(store.load("optical")) == after


def test_a_run_that_dies_leaves_the_last_version_readable(spark, tmp_path, monkeypatch):
    store = ModelStore(spark, str(tmp_path / "models"))
    store.save({"thermal": thermal(spark, 1)}, 100)
    want = held(store.load("thermal"))

    def die(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_commit", die)
    with pytest.raises(RuntimeError):
        store.save({"thermal": thermal(spark, 1, mean=70.0)}, 200)
    monkeypatch.undo()
    assert store.newest() == 1 and held(store.load("thermal")) == want
    # a writer that lost the race for a version does not overwrite it
    with pytest.raises(Exception, match="exist"):
        store._commit(1, 300, "late", {"thermal": [("nowhere", True)]})
    assert store.save({"thermal": thermal(spark, 1, mean=70.0)}, 200) == 2 and held(store.load("thermal"))[(1, 0)][0] == 70.0


def test_whole_models_replace_their_sites_and_other_kinds_stay(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    features = spark.createDataFrame([(1, 9, 1.0, 0.1, 2.0, 0.2, 9, 5.0, 0.5)], "site_id long, n long, area_mean double, area_var double, speed_mean double, speed_var double, hot_n long, hot_mean double, hot_var double")
    traffic = spark.createDataFrame([(1, 3, 4.0), (2, 3, 5.0)], "site_id long, pos int, activity double")
    site = spark.createDataFrame([(1, 400, 1500), (2, 10, 3)], "site_id long, frames long, activity_obs long")
    store.save({"thermal": thermal(spark, 1, 2), "features": features, "traffic": traffic, "site": site}, 100)
    small = thermal(spark, 2, mean=30.0).filter("pos < 6")
    store.save({"thermal": small, "site": spark.createDataFrame([(2, 11, 4)], "site_id long, frames long, activity_obs long")}, 200)
    got = held(store.load("thermal"))
    assert len(got) == 26 and got[(2, 0)][0] == 30.0 and got[(1, 0)][0] == 1.0
    assert sorted(map(tuple, store.load("site").collect())) == [(1, 400, 1500), (2, 11, 4)]
    assert [tuple(r) for r in store.load("features").collect()] == [tuple(features.first())]
    assert sorted(map(tuple, store.load("traffic").collect())) == [(1, 3, 4.0), (2, 3, 5.0)]
    assert [r.version for r in store.versions().select("version").distinct().orderBy("version").collect()] == [1, 2]
