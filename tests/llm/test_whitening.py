"""Exact scatter and whitening against fractions and plain loops, on odd rows and on the given table."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from stemma.llm import queries, whitening

from ..conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def brute(vectors: list[list[int]]):
    """(n, covariance times n^2 as integers, deviations)."""
    n, d = len(vectors), len(vectors[0])
    s = [sum(v[i] for v in vectors) for i in range(d)]
    m = [[n * sum(v[i] * v[j] for v in vectors) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, m, [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in vectors]


def test_scatter_is_exact_for_numbers_of_any_size():
    rng = np.random.default_rng(3)
    for top in (40, 1 << 19, 1 << 21, 1 << 45, 2**62):
        y = rng.integers(-top, top, (5000 if top < 100 else 60, 5))
        found = whitening.scatter(y)
        rows = y.tolist()
        assert found.total.tolist() == [sum(r[i] for r in rows) for i in range(5)]
        assert found.cross.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def test_limbs_add_up():
    for v in (0, -1, 1, 2**31, -(2**31) - 1, 2**64, -(2**90) + 7):
        assert sum(x << (32 * k) for k, x in enumerate(whitening._limbs(v))) == v


def test_op11_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [rng.normal(0, 0.2, 4).astype(np.float32).tolist() for _ in range(30)]
    rows = [(i, v, 1, 7, "clash") for i, v in enumerate(good)]
    rows += [(3, good[3], 1, 7, "clash"), (None, good[4], None, 7, None)]  # a repeated and a null id
    bad = [None, [], [0.1, None, 0.2, 0.3], [0.1, math.nan, 0.2, 0.3], [0.1, math.inf, 0.2, 0.3], [0.5, 0.5]]
    rows += [(100 + i, v, 1, 7, "clash") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.op11_embedding_whitening(df).collect()
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for v in [*good, good[3], good[4]]]
    n, s, m, deviations = brute(xs)
    assert len(got) == 32 * 4 and {r["n"] for r in got} == {n} and not [r for r in got if (r["vec_id"] or 0) >= 100]
    ids = [*range(30), 3, None]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in got if r["component"] == 1) == sorted((i is None, i or 0, d) for i, d in zip(ids, deviations))
    cov = np.array([[float(Fraction(v, n * n)) for v in row] for row in m])
    values, vectors = np.linalg.eigh(cov)
    for k in range(4):
        e, u = values[3 - k], vectors[:, 3 - k]
        want = {i: sum(float(Fraction(n * x[j] - s[j], n)) * u[j] for j in range(4)) / math.sqrt(e) for i, x in zip(ids, xs)}
        have = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        sign = 1 if have[0] * want[0] > 0 else -1
        assert all(math.isclose(sign * have[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)
        assert {round(r["explained"], 12) for r in got if r["component"] == k + 1} == {round(e / values.sum(), 12)}
    assert max(r["identity_error"] for r in got) < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, [0.1, 0.2])], [(1, [0.1, 0.2]), (2, [0.1, 0.2])], [(1, None), (2, [])]])
def test_op11_without_variance_gives_no_rows(spark, rows):
    assert whitening.op11_embedding_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_op11_leaves_out_components_without_variance(spark):
    rows = [(i, [i / 64, 0.25, -i / 64]) for i in range(20)]
    got = whitening.op11_embedding_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 20 and abs(got[0]["explained"] - 1) < 1e-12


def test_op11_beyond_64_bits(spark):
    rows = [(i, [i * 1e15, float(i % 3)]) for i in range(50)] + [(99, [1e300, -1e300])]
    got = whitening.op11_embedding_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    xs = [[math.floor(64 * c) for c in v] for _, v in rows[:-1]] + [[2**63 - 1 - 1_000_000, -(2**63)]]
    _, _, _, deviations = brute(xs)
    assert {r["vec_id"]: r["deviation_digits"] for r in got} == {i: str(d) for (i, _), d in zip(rows, deviations)}
    assert all(r["deviation"] is None for r in got)


def test_op11_covariance_of_its_rows(spark):
    got = queries.queries()["op11_embedding_whitening"](spark, DATA).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert wide.shape == (500, 32)
    measured = np.abs(np.cov(wide.T, bias=True) - np.eye(32)).max()
    assert measured < 1e-9 and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    shares = got.groupby("component").explained.first()
    assert (shares.diff().dropna() <= 0).all() and 0 < shares.sum() <= 1
