import re
from collections import Counter, defaultdict

import pytest

from lattiq.llm import mixing
from lattiq.llm.common import load

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(1.0, 2.0, 3.0), cap=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = sum(sizes.values())
    closed, target = set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in closed)
        opened = [s for s in names if s not in closed]
        share = sum(w[s] for s in opened)
        target = {s: cap * sizes[s] if s in closed else rest * w[s] / share for s in names}
        over = [s for s in opened if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target
        closed |= set(over)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken(spark):
    docs = load(spark, SF, "documents")
    got = mixing.pareto_mix(docs).collect()
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    target = plain_targets(sizes)
    assert {r["doc_id"]: r["size"] for r in got} == {r["doc_id"]: words(r["text"]) for r in rows}
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert r["copies"] - int(r["expected"] + 1e-9) in (0, 1)
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        out = [r["size"] for r in got if r["source"] == s and r["size"] and r["copies"] < 3 and r["copies"] == int(r["expected"] + 1e-9)]
        assert 0 <= t - taken[s] + 1e-6 and t - taken[s] < min(out, default=1), s
    again = mixing.pareto_mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = mixing.pareto_mix(docs, seed=7).collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, None: 50}, {"z": 7}, {"a": 0, "b": 9, "c": 3}])
def test_targets_with_caps(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("bucket", [3, 4096])
def test_buckets_change_nothing_about_the_targets(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = [(k, "w " * (1 + k * 7 % 23), "ab"[k % 5 == 0]) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.pareto_mix(df).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < 23


def test_larger_source_tables_are_joined_by_salted_keys(spark, monkeypatch):
    docs = load(spark, SF, "documents")
    want = sorted(map(tuple, mixing.pareto_mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.pareto_mix(docs).collect())) == want


def plain_sample(rows, cap=3.0, tilt=mixing.TILT):
    """Copies of each (doc_id, source, size, u, target) by sorting whole sources."""
    out = {}
    for source in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == source]
        low, high = 0.0, 1e9
        grade = {r[0]: 2.0 ** (-tilt * (r[2].bit_length() - 1)) for r in mine}
        for _ in range(200):  # the level at which expected words are the target
            level = (low + high) / 2
            words = sum(r[2] * min(cap, level * grade[r[0]]) for r in mine)
            low, high = (level, high) if words < mine[0][4] else (low, level)
        expected = {r[0]: min(cap, low * grade[r[0]]) for r in mine}
        whole = {k: int(x + 1e-6) for k, x in expected.items()}
        p = {k: x - whole[k] for k, x in expected.items()}
        rest = mine[0][4] - sum(whole[r[0]] * r[2] for r in mine)
        ranked = sorted((u / (1 - u) / (p[i] / (1 - p[i])), i, z) for i, _, z, u, _ in mine if p[i] > 1e-6)
        out |= whole
        while ranked and ranked[0][2] <= rest:
            _, i, z = ranked.pop(0)
            out[i] += 1
            rest -= z
        while any(z <= rest for _, _, z in ranked):
            first = {}
            for r in ranked:
                first.setdefault(r[2], r)
            for z in sorted(first, reverse=True):
                if z <= rest:
                    ranked.remove(first[z])
                    out[first[z][1]] += 1
                    rest -= z
    return out


@pytest.mark.parametrize("bucket", [5, 4096])
def test_sample_equals_one_drawn_by_sorting(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = [(k, "w " * (1 + k * k * 7919 % 391), "abc"[k % 7 % 3]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2):
        got = {r["doc_id"]: r for r in mixing.pareto_mix(df, seed=seed).collect()}
        u = {r["doc_id"]: r["u"] for r in df.select("doc_id", mixing.uniform(seed).alias("u")).collect()}
        want = plain_sample([(k, s, words(t), u[k], got[k]["target"]) for k, t, s in rows])
        assert {k: r["copies"] for k, r in got.items()} == want


def test_inclusion_is_unequal_and_as_expected(spark):
    """Over many seeds each document is taken about as often as its expected copies say, short ones more often."""
    rows = [(k, "w " * (3 if k % 2 else 5), "ab"[k % 3 == 0]) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    hits = Counter()
    for seed in range(4):
        for r in mixing.pareto_mix(df, seed=seed).collect():
            hits[r["source"], r["size"]] += r["copies"]
            hits["want", r["source"], r["size"]] += r["expected"]
    for s in "ab":
        n = {z: sum(len(t) == 2 * z and x == s for _, t, x in rows) for z in (3, 5)}
        assert hits["want", s, 3] / n[3] == pytest.approx(2**mixing.TILT * hits["want", s, 5] / n[5])
        for z in (3, 5):
            assert hits[s, z] == pytest.approx(hits["want", s, z], rel=0.15)


def test_a_document_that_repeats_very_often_counts_as_one_entry(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE_ROWS", 7)
    rows = [(1, "w w w", "a")] * 40 + [(k, "w " * k, "a") for k in range(2, 9)] + [(k, "w w", "b") for k in range(9, 40)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < 8


def test_mixing_odd_rows(odd_docs, no_docs):
    got = mixing.pareto_mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    mixed = mixing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.pareto_mix(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []
