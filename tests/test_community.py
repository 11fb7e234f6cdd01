"""Communities against plain Python: modularity, planted groups, connectedness, seeds."""

import itertools

import numpy as np
import pytest

from lattiq.operators import community as C


def both(edges):
    return [(a, b, float(w)) for a, b, w in edges] + [(b, a, float(w)) for a, b, w in edges]


def plain(edges, label, resolution=1.0):
    total = sum(w for _, _, w in edges)
    k, t = {}, {}
    for a, _, w in edges:
        k[a] = k.get(a, 0) + w
    for a, x in k.items():
        t[label[a]] = t.get(label[a], 0) + x
    return sum(w for a, b, w in edges if label[a] == label[b]) / total - resolution * sum((x / total) ** 2 for x in t.values())


def connected(edges, label):
    for c in set(label.values()):
        own = {a for a, x in label.items() if x == c}
        seen, front = set(), {min(own)}
        while front:
            seen |= front
            front = {b for a, b, _ in edges if a in front and b in own} - seen
        if seen != own:
            return False
    return True


def found(spark, edges, nodes, **how):
    e = spark.createDataFrame(edges, "i long, j long, w double")
    n = spark.createDataFrame([(x,) for x in nodes], "i long")
    return {r["i"]: r["community"] for r in C.communities(e, n, **how).collect()}


def test_modularity(spark):
    rng = np.random.default_rng(1)
    edges = both([(a, b, rng.random()) for a, b in itertools.combinations(range(20), 2) if rng.random() < 0.3] + [(3, 3, 0.5)])
    label = {a: int(rng.integers(4)) for a in range(20)}
    got = C.modularity(spark.createDataFrame(edges, "i long, j long, w double"), spark.createDataFrame(list(label.items()), "i long, c long"), 0.8)
    assert got == pytest.approx(plain(edges, label, 0.8), abs=1e-12)


def test_ring_of_cliques(spark):
    """Eight cliques of six in a ring: the cliques, and a node without edges alone."""
    edges = [(6 * c + a, 6 * c + b, 1) for c in range(8) for a, b in itertools.combinations(range(6), 2)] + [(6 * c, 6 * ((c + 1) % 8) + 1, 1) for c in range(8)]
    got = found(spark, both(edges), [*range(48), 99])
    assert got == {a: 6 * (a // 6) for a in range(48)} | {99: 99}


def test_planted_groups(spark):
    """A noisy graph: at least the modularity of the planted groups, all connected."""
    rng = np.random.default_rng(2)
    group = rng.integers(5, size=120)
    edges = both([(a, b, 1) for a, b in itertools.combinations(range(120), 2) if rng.random() < (0.35 if group[a] == group[b] else 0.03)])
    got = found(spark, edges, range(120), seed=7)
    assert plain(edges, got) >= plain(edges, dict(enumerate(group.tolist()))) - 0.01
    assert connected(edges, got)


def test_no_edges(spark):
    assert found(spark, [], [1, 2]) == {1: 1, 2: 2}
    assert found(spark, [(1, 2, 0.0), (2, 1, 0.0)], [1, 2]) == {1: 1, 2: 2}
