"""Whitening against numpy's eigenvectors and exact whole numbers."""

import math

import numpy as np
import pytest

from barloom.llm.queries import QUERIES
from barloom.llm.whitening import jacobi, whiten
from tests.oracle import DATA


def brute(rows: list[tuple], components: int = 16, steps: int = 64, offset: int = 1_000_000):
    """{id: (n, deviation, values along the components, deviations)} by definition; rows hold (id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    grid = [(i, tuple(math.floor(steps * float(c)) + offset for c in v)) for i, v in kept]
    points = sorted({x for _, x in grid})
    n, size = len(points), len(points[0])
    sums = [sum(x[k] for x in points) for k in range(size)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in points])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in grid:
        d = [n * c - s for c, s in zip(x, sums)]
        out.append((i, sum(c * c for c in d), np.array([c / n for c in d]) @ axes[:, order] / np.sqrt(values[order])))
    return n, out, values[order] / values.sum()


def check(found, rows, components=16):
    n, wanted, explained = brute(rows, components)
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error <= 1e-4
    signs = None
    assert len(found) == len(wanted) * len(explained)
    for i, deviation, values in wanted:
        mine = sorted(by_id[i], key=lambda r: r.component)[: len(explained)]
        assert all(int(r.deviation) == deviation for r in mine)
        got = np.array([r.whitened for r in mine])
        signs = np.sign(got * values) if signs is None else signs
        assert np.allclose(got * signs, values, atol=1e-6)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-6)


def test_jacobi_is_exact_on_columns_of_very_different_length():
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.normal(size=(40, 21)))[0], np.linalg.qr(rng.normal(size=(21, 21)))[0]
    values = 10.0 ** -np.arange(21)[::1].astype(float) * 1e8
    lengths, axes = jacobi((u * values) @ v.T)
    assert np.allclose(lengths[:12], values[:12], rtol=1e-8)
    assert np.allclose(np.abs(np.sum(axes[:, :10] * v[:, :10], axis=0)), 1)
    assert np.allclose(axes.T @ axes, np.eye(21), atol=1e-13)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, f"{DATA}/sf0.001").collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=3) * (1, 5, 0.2)], 7, "x") for k in range(60)]
    rows += [(100 + k, rows[0][1], 7, "x") for k in range(90)]  # one vector is most of all rows
    odd = [(200, None, 7, "x"), (201, [1.0, None, 2.0], 7, "x"), (202, [1.0, float("nan"), 2.0], 7, "x"), (203, [1.0, float("inf"), 2.0], 7, "x"), (204, [], 7, "x"), (205, [1.0, 2.0], 7, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n long, _x string").repartition(7)
    found = whiten(df).collect()
    assert {r.vec_id for r in found} == {r[0] for r in rows} and {r.component for r in found} == {1, 2, 3}
    check(found, [r[:2] for r in rows])
    repeated = spark.createDataFrame([(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id is None, r.component, round(abs(r.whitened), 9)) for r in whiten(repeated).collect()) == [(False, 1, 1.0), (True, 1, 1.0), (True, 1, 1.0)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(k, [float((k * k) << 30), float(k)]) for k in range(1, 9)]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    n, wanted, _ = brute(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in found} == {i: d for i, d, _ in wanted}
