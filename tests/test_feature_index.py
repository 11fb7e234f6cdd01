"""The feature-space index against brute force: clusters, spread-out points, copies, ties, small and empty tables."""

import numpy as np
import pandas as pd
import pytest

from lattiq.operators import feature_index as FI


def frames(spark, q, r):
    dq = spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in enumerate(q)], "i long, v array<double>")
    dr = spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in enumerate(r)], "j long, v array<double>")
    return dq, dr


def brute(q, r, k):
    out = set()
    for i, x in enumerate(q):
        if x is not None:
            d = sorted((float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum())), j) for j, y in enumerate(r) if y is not None)[:k]
            out |= {(i, n, j, round(e, 9)) for n, (e, j) in enumerate(d, 1)}
    return out


def held(spark, q, r, k, cells=None):
    dq, dr = frames(spark, q, r)
    got = {(x["i"], x["rank"], x["j"], round(x["d"], 9)) for x in FI.nearest(dq, FI.build(dr, k, cells)).collect()}
    assert got == brute(q, r, k)


@pytest.mark.parametrize("cells", [None, 1, 40])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_equals_brute_force(spark, cells, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 6))
    q, r = (centres[rng.integers(10, size=n)] + spread * rng.normal(size=(n, 6)) for n in (80, 400))
    held(spark, q, r, 4, cells)


def test_copies_ties_and_units(spark, monkeypatch):
    """A third of both sides is one vector, the rest lies on a lattice; units of 16 rows."""
    monkeypatch.setattr(FI, "UNIT_ROWS", 16)
    rng = np.random.default_rng(2)
    q = [(1, 1)] * 30 + rng.integers(0, 5, (60, 2)).tolist()
    r = [(1, 1)] * 100 + rng.integers(0, 5, (200, 2)).tolist()
    held(spark, q, r, 5, 6)


def test_small_and_empty(spark):
    held(spark, [(0, 0), None, (5, 5)], [(1, 0), None, (0, 2)], 4)
    held(spark, [(0, 0)], [None], 2)
    dq, dr = frames(spark, [(0, 0)], [(1, 1)])
    assert FI.nearest(dq.limit(0), FI.build(dr, 2)).count() == 0
    assert FI.nearest(dq, FI.build(dr.limit(0), 2)).count() == 0
    with pytest.raises(ValueError, match="built for 2"):
        FI.nearest(dq, FI.build(dr, 2), 3)


def test_bounds_prune_cells(spark):
    """Clustered data: a query visits few of the cells in both rounds."""
    rng = np.random.default_rng(3)
    centres = 20 * rng.normal(size=(25, 5))
    q, r = (centres[rng.integers(25, size=n)] + 0.1 * rng.normal(size=(n, 5)) for n in (100, 2500))
    dq, dr = frames(spark, q, r)
    index = FI.build(dr, 5, 25)
    first = FI._visits(dq.selectExpr("i", "v", "double('inf') AS t"), index, False).count()
    near = FI.nearest(dq, index)
    bound = near.where("rank = 5").selectExpr("i", "d AS t").join(dq, "i").select("i", "v", "t")
    more = FI._visits(bound, index, True).count()
    assert first == 100 and more < 0.15 * 100 * 25


def test_space_is_fitted_on_the_reference(spark):
    rng = np.random.default_rng(4)
    r, q = rng.normal(size=(300, 6)) * [1, 10, 100, 1, 1, 5] + 7, rng.normal(size=(20, 6)) * [1, 10, 100, 1, 1, 5]
    dq, dr = frames(spark, q, r)
    mean, sd = r.mean(0), r.std(0, ddof=1)
    got = {x["i"]: x["v"] for x in FI.in_space(FI.fit_space(dr), dq).collect()}
    assert np.allclose([got[i] for i in range(20)], (q - mean) / sd)
    z = (r - mean) / sd
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    two = {x["i"]: x["v"] for x in FI.in_space(FI.fit_space(dr, 2), dq).collect()}
    want = ((q - mean) / sd) @ axes.T
    assert np.allclose(np.abs([two[i] for i in range(20)]), np.abs(want), atol=1e-6)


def test_labels_follow_the_clusters(spark):
    rng = np.random.default_rng(5)
    centres = 10 * np.eye(3)
    kind = rng.integers(3, size=200)
    dq, dr = frames(spark, centres[[0, 1, 2, 2]] + 0.1, centres[kind] + 0.2 * rng.normal(size=(200, 3)))
    named = dr.join(spark.createDataFrame([(j, f"c{c}") for j, c in enumerate(kind.tolist())], "j long, label string"), "j")
    got = {r["i"]: (r["label"], r["share"]) for r in FI.transfer_labels(dq, named, 7, 2).collect()}
    assert got == {0: ("c0", 1.0), 1: ("c1", 1.0), 2: ("c2", 1.0), 3: ("c2", 1.0)}


def test_rows_are_sent_by_grove_where_nothing_is_pruned(spark):
    """Noise in many dimensions: every cell is near enough, yet a query goes once to each grove, not to each cell."""
    rng = np.random.default_rng(6)
    q, r = rng.normal(size=(40, 32)), rng.normal(size=(2500, 32))
    dq, dr = frames(spark, q, r)
    index = FI.build(dr, 5)
    near = FI.nearest(dq, index)
    bound = near.where("rank = 5").selectExpr("i", "d AS t").join(dq, "i").select("i", "v", "t")
    assert len(index.pivots) > 20
    assert FI._visits(bound, index, True).count() <= 5 * 40
    assert {(x["i"], x["rank"], x["j"], round(x["d"], 9)) for x in near.collect()} == brute(q, r, 5)


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e18])
def test_blocks_narrow_to_the_exact_neighbours(monkeypatch, scale):
    """Small tiles, bounds that are missing or loose, far-off centres, ties and numbers beyond single precision."""
    monkeypatch.setattr(FI, "TILE", 32)
    monkeypatch.setattr(FI, "CANDIDATES", 16)
    rng = np.random.default_rng(7)
    y = scale * (np.vstack([rng.normal(size=(250, 3)), rng.integers(0, 3, (150, 3))]) + 100)
    x = scale * (np.vstack([rng.normal(size=(20, 3)), rng.integers(0, 3, (20, 3))]) + 100)
    pivots = y[:5]
    far = np.sqrt(((y[:, None] - pivots) ** 2).sum(2))
    cell = far.argmin(1)
    rows = FI._Rows(pd.DataFrame({"j": range(400), "v": list(y), "cell": cell, "dist": far.min(1)}), pivots, np.array([far[cell == c, c].max() for c in range(5)]))
    d = np.sqrt(((x[:, None] - y) ** 2).sum(2))
    want = {(i, j) for i in range(40) for j in np.lexsort((np.arange(400), d[i]))[:6].tolist()}
    for t in (np.full(40, np.inf), np.sort(d, axis=1)[:, 60], np.sort(d, axis=1)[:, 5], rows.bound(x, 2, 6)):
        p, j, _ = rows.nearest(x, t, 6)
        assert set(zip(p.tolist(), j.tolist())) == want
