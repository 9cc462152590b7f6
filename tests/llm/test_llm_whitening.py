import math

import numpy as np
import pytest
from conftest import SF

from perimetra.llm import queries, whitening


def by_numpy(rows, most=8):
    """The contract with Python integers and a plain covariance."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    gaps = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    v = np.array([[sum(g[i] * g[j] for g in gaps) / n**3 for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(v)
    order = np.argsort(e)[::-1][:most]
    w = (np.array(gaps, dtype=np.float64) / n) @ axes[:, order] / np.sqrt(e[order])
    return n, [sum(g * g for g in gap) for gap in gaps], w, e[order] / np.trace(v)


def test_products_on_bit_planes_are_exact():
    r = np.random.default_rng(1)
    for n, d, top in ((1, 1, 1), (63, 3, 2), (64, 5, 900), (200, 7, 1 << 20), (130, 4, 1 << 41)):
        y = r.integers(0, top, size=(n, d))
        y[0, 0] = top
        big = y.astype(object)
        assert (whitening.products(y) == big.T @ big).all()
        sums, total = whitening.block_sums(y - top // 3)
        low = big - top // 3
        assert (sums == low.sum(axis=0)).all() and (total == low.T @ low).all()


def test_query_over_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    n, deviations, w, shares = by_numpy(rows)
    got = {(r.vec_id, r.component): r for r in queries.op12(spark, SF).collect()}
    assert len(got) == 8 * len(rows)
    signs = [np.sign(got[(rows[0][0], k + 1)].whitened * w[0, k]) for k in range(8)]
    for at, (vec, _) in enumerate(rows):
        for k in range(8):
            r = got[(vec, k + 1)]
            assert r.n == n and r.deviation == deviations[at]
            assert r.whitened == pytest.approx(signs[k] * w[at, k], abs=1e-6)
            assert r.explained == pytest.approx(shares[k], rel=1e-9) and r.identity_error < 1e-9


def test_blocks_and_partitions_do_not_change_the_sums(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    table = whitening._vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    n, sums, total = whitening.scatter(table.repartition(7), 64)
    x = np.array([[math.floor(1024 * c) + 100000 for c in r.v] for r in table.collect()], dtype=object)
    assert n == len(x) and (np.array(sums, dtype=object) == x.sum(axis=0)).all() and (total == x.T @ x).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [0.0, 2.0]), (1, [0.5, -0.25])]
    table = spark.createDataFrame([(i, v, 0, {"a": 1}) for i, v in rows], "vec_id long, embedding array<double>, N int, component map<string,int>")
    got = whitening.whitened(table).collect()
    kept = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [0.0, 2.0])]
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted(((i, k) for i, _ in kept for k in (1, 2)), key=repr)
    _, deviations, w, _ = by_numpy(kept, 1)
    assert {int(r.deviation) for r in got if r.vec_id is None} == {deviations[2]}
    first = {r.vec_id: r for r in got if r.component == 1}
    assert abs(first[None].whitened) == pytest.approx(abs(w[2, 0])) and first[1].explained == pytest.approx(1.0) and first[1].n == 3
    assert all(r.whitened is None and r.explained == 0.0 for r in got if r.component == 2)  # the points lie on one line


def test_no_spread_and_no_rows(spark):
    same = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, 0.2])], "vec_id long, embedding array<float>")
    assert {tuple(r)[1:] for r in whitening.whitened(same).collect()} == {(k, 2, 0, None, None, None) for k in (1, 2)}
    assert whitening.whitened(same.where("false")).collect() == []
    assert whitening.whitened(same.where("false")).columns == whitening.whitened(same).columns
    huge = spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: abs(r.whitened) for r in whitening.whitened(huge).collect()} == pytest.approx({1: 1.0, 2: 1.0})
