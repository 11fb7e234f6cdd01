"""Dual-tree hard negatives: SQL on the given tables, plain Python on odd, tied and hot ones."""

import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402

from lattiq.llm import hardneg  # noqa: E402
from lattiq.llm.queries import oracle_sql, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label long"


def plain(rows, stride=100, positives=5, negatives=10):
    """The contract, one anchor at a time, in Python's integers."""
    good = [(i, [math.floor(256 * x) for x in e], (n + 1) % 10 if i % 7 == 0 else n) for i, e, n in rows if i is not None and e is not None and n is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, (a, v, n) in enumerate(good):
        if a % stride:
            continue
        every = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, m) for j, (b, w, m) in enumerate(good) if j != k and len(w) == len(v))
        same = [(-s, b) for s, b, m in every if m == n][:positives]
        for p, b in same:
            hard = [(-s, c) for s, c, m in every if m != n and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(a, b, r, c, p, s) for r, (s, c) in enumerate(hard, 1)]
    return sorted(out)


def held(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA)
    left = sorted(tuple(r) for r in hardneg.hard_negatives(df, **sizes).collect())
    assert left == plain(rows)
    return left


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    left, right = oracle.compare(spark, oracle.connect(d), queries()["op11_dual_tree_negatives"], oracle_sql()["op11_dual_tree_negatives"], d)
    assert left == right and len(left) > 100


def test_many_groves_lots_and_turns(spark):
    """Groves of 40 rows and lots of 3 anchors: rounds that prune by what earlier ones found."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 6))
    rows = [(int(i), (centres[i % 12] + 0.3 * r.normal(size=6)).tolist(), int(r.integers(10))) for i in r.permutation(2400)]
    assert held(spark, rows, grove_rows=40, lot_rows=3)


def test_hot_vector_ties_and_repeats(spark):
    """A third of all rows hold one vector, some vec_ids twice; components are coarse, so that many scores tie."""
    r = np.random.default_rng(4)
    rows = [(i, [0.5, -0.25, 0.125], i % 3) if i % 3 == 0 else (i, (r.integers(-2, 3, 3) / 4).tolist(), i % 4) for i in range(900)]
    rows += rows[:150] + [(200, [0.25, 0.25, 0.25], 1)]
    assert held(spark, rows, grove_rows=64, lot_rows=4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 0.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 2), (500, [1.0, 1.0], None), (600, [], 1), (601, [], 1), (602, [], 2), (0, [0.0, 0.0], 3)]
    odd += [(700 + k, [1.0 - k / 50, k / 60], k % 2) for k in range(40)] + [(800, [1.0, 2.0, 3.0], 1), (801, [1.0, 2.0, 2.5], 1), (803, [1.0, 2.0, 1.0], 2)]
    odd += [(1000, [-1.0, -1.0, 5.0, 5.0], 1), (1001, [1e12, 1.0, 1.0, 1.0], 1), (1002, [-1e12, 3.0, 1.0, 1.0], 2), (1003, [-9e11, 3.0, 1.0, 1.0], 2)]
    assert held(spark, odd, grove_rows=16, lot_rows=2)
    assert hardneg.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hardneg.hard_negatives(spark.createDataFrame([(5, [1.0], 1)], SCHEMA)).count() == 0


def test_scores_beyond_64_bits_are_cut(spark):
    rows = [(100, [1e17, 0.0], 1), (101, [1e17, 0.0], 1), (102, [5e16, 0.0], 2), (103, [1.0, 0.0], 2)]
    out = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.positive_score == 2**63 - 1 for r in out)


def test_clashing_columns(spark):
    rows = [(k, [k / 100, 1.0], k % 3) for k in range(0, 300, 10)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA + ", rid int, lot int, v int")
    assert sorted(tuple(r) for r in hardneg.hard_negatives(df).collect()) == plain(rows)


def test_pruning_skips_groups_of_anchors():
    """Well separated clusters: most pairs of leaves are never scored, and the best are those of brute force."""
    r = np.random.default_rng(5)
    x = np.concatenate([np.floor(256 * (8 * np.eye(8)[k] + 0.1 * r.normal(size=(512, 8)))) for k in range(8)]).astype(np.int64)
    label = np.zeros(len(x), np.int64)
    lot = {"rid": np.arange(len(x)), "label": label, "v": x, "tree": hardneg.Tree(x.astype(float), label, 32)}
    grove = {"rid": np.arange(len(x)), "id": np.arange(len(x)), "label": label, "v": x, "tree": hardneg.Tree(x.astype(float), label, 64)}
    n = len(x)
    asked = {"a": np.arange(n), "low": np.full(n, hardneg.LOWEST), "high": np.full(n, hardneg.HIGHEST), "need": np.full(n, hardneg.LOWEST)}
    s = hardneg.Search(lot, asked, True, 5)
    s.run(grove)
    leaves = sum(k < 0 for k in lot["tree"].left) * sum(k < 0 for k in grove["tree"].left)
    assert s.scored < leaves / 4
    row, score, ids = s.found()
    g = x @ x.T
    np.fill_diagonal(g, hardneg.LOWEST)
    for a in range(0, n, 97):
        best = np.lexsort((np.arange(n), -g[a]))[:5]
        got = sorted(zip(-score[row == a], ids[row == a], strict=True))
        assert [i for _, i in got] == best.tolist()
