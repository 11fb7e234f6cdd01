"""Exact quantiles and Kendall's tau against numpy and plain pairs."""

import itertools

import numpy as np
import pytest

from lattiq.operators import order_stats as O

SHARES = [0.0, 0.1, 0.33, 0.5, 0.66, 0.999, 1.0]


@pytest.mark.parametrize("values", [np.random.default_rng(1).normal(size=997), np.random.default_rng(2).integers(0, 7, 500) / 3, np.array([4.5]), np.r_[np.full(400, 2.0), np.arange(200)]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert O.quantiles(df, "x", SHARES) == pytest.approx(np.quantile(values, SHARES).tolist(), abs=1e-12)


def test_quantiles_of_nothing(spark):
    assert O.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5, 0.9]) == [None, None]


def test_inversions():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 200):
        y, w = rng.integers(0, 20, n), rng.integers(1, 5, n)
        want = sum(int(w[i] * w[k]) for i, k in itertools.combinations(range(n), 2) if y[i] > y[k])
        assert O.inversions(y, w) == want
    assert O.inversions(np.array([2, 1]), np.array([2**40, 2**40])) == 2**80


def tau(x, y):
    s = nx = ny = 0
    for i, k in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[k]), np.sign(y[i] - y[k])
        s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
    return s / (nx * ny) ** 0.5 if nx and ny else None


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_kendall(spark, buckets):
    """Spread-out values, many ties, and one value of either side in a third of the rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=150)
    for a, b in ((x, x + rng.normal(size=150)), (rng.integers(0, 5, 150), rng.integers(0, 4, 150)), (np.where(x > 0.4, 9, x), rng.normal(size=150)), (rng.normal(size=150), np.where(x > 0.4, 0, x))):
        df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, b, strict=True)] + [(None, 1.0), (1.0, None)], "x double, y double")
        got = O.kendall(df, "x", "y", buckets)
        assert got["pairs"] == 150 * 149 // 2 and got["tau"] == pytest.approx(tau(a, b), abs=1e-12)


def test_kendall_of_constant_or_no_rows(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)]):
        assert O.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y")["tau"] is None
