"""The model on the mock compartment graph: parameters, invariants, closed forms, solver against solver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions import dims
from lattiq.functions.columns import is_boundary
from lattiq.operators import design, dynamics, graph, matrices, metrics, params, stats

NAMES = ["PT_cortex", "PT_outer_medulla", "PT_inner_medulla", "PT_boundary", "DCT_cortex", "DCT_outer_medulla", "DCT_boundary", "TAL_outer_medulla", "TAL_inner_medulla", "vascular_cortex", "vascular_boundary", "immune_cortex", "other_cortex", "other_outer_medulla", "other_inner_medulla"]
CROSS = [(0, 4), (2, 6), (3, 8), (5, 10), (7, 12)]


@pytest.fixture(scope="module")
def comps(spark):
    c = spark.createDataFrame(list(enumerate(NAMES)), "node long, comp string")
    return c.select("node", "comp", F.split("comp", "_", 2)[0].alias("macro"), F.split("comp", "_", 2)[1].alias("region")).withColumn("is_boundary", is_boundary()).cache()


@pytest.fixture(scope="module")
def edges(spark):
    n = len(NAMES)
    e = [(k, (k + 1) % n, 1.0) for k in range(n)] + [(a, b, 0.5) for a, b in CROSS]
    return spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "i long, j long, w double").cache()


def base(comps, seed=0.05):
    return dynamics.seeded(params.default_rates(comps), seed).withColumn("run_id", F.lit("base"))


def test_rates_and_ratio(comps):
    r = {x["comp"]: x for x in params.default_rates(comps).collect()}
    assert r["PT_cortex"]["beta"] == 0.40 and r["PT_cortex"]["rho"] == 0.08 and r["vascular_cortex"]["d_d"] == 0.35
    assert all(x["d_h"] == 0.05 for x in r.values())
    for name, want in (("PT_boundary", 5.68), ("DCT_boundary", 3.18), ("vascular_boundary", 3.41)):
        assert r[name]["beta"] / r[name]["rho"] == pytest.approx(want, abs=0.02)
    o = {x["comp"]: x for x in params.default_rates(comps, outer_only=True).collect()}
    assert o["PT_outer_medulla"]["beta"] == pytest.approx(0.5) and o["PT_inner_medulla"]["beta"] == 0.40


def test_unknown_names_take_defaults(spark):
    c = spark.createDataFrame([(0, "x_y", "x", "y", False)], "node long, comp string, macro string, region string, is_boundary boolean")
    r = params.default_rates(c).first()
    assert (r["beta"], r["rho"], r["d_h"], r["d_d"]) == (dims.BETA, dims.RHO, dims.D_H, dims.D_D)


def test_simplified_baseline(comps, edges):
    """Bounds of the simplified model on the mock graph, with its own Laplacian and conserved mass."""
    c = dynamics.seeded(params.default_rates(comps, outer_only=True), 0.05).withColumn("run_id", F.lit("base"))
    t = dynamics.simulate(c, graph.adjacency(edges, "row"), 60.0, 600, "rk45", conserve=True).cache()
    o = metrics.run_outputs(t, comps).first()
    assert 3 < o["mean_inv_time"] < 15 and 0.2 < o["peak_d"] < 0.6 and o["global_r"] > 0.8
    total = t.select((F.col("h") + F.col("d") + F.col("r")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1, abs=1e-6) and total[1] <= 1.01  # h and d are clipped, so r cannot go below 0


def test_finals_sum_to_one(comps, edges):
    t = dynamics.simulate(base(comps), graph.adjacency(edges), 30.0, 120)
    f = dynamics.finals(t).select((F.col("h") + F.col("d") + F.col("r")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert f[0] == pytest.approx(1) and f[1] == pytest.approx(1)


def test_decay_without_exposure(comps, edges):
    """With beta and diffusion 0, d falls as exp(-rho t)."""
    c = base(comps).withColumn("beta", F.lit(0.0)).withColumn("d_h", F.lit(0.0)).withColumn("d_d", F.lit(0.0))
    t = dynamics.simulate(c, graph.adjacency(edges), 20.0, 20, "rk45")
    rows = t.where("t_idx = 20").join(c.select("node", "rho", "d0"), "node").collect()
    assert all(r["d"] == pytest.approx(r["d0"] * math.exp(-r["rho"] * 20), abs=1e-7) for r in rows)


def test_euler_meets_adaptive_steps(comps, edges):
    a = graph.adjacency(edges).cache()
    e = {(r["node"]): r["d"] for r in dynamics.simulate(base(comps), a, 10.0, 8000).where("t_idx = 8000").collect()}
    k = {(r["node"]): r["d"] for r in dynamics.simulate(base(comps), a, 10.0, 10, "rk45").where("t_idx = 10").collect()}
    assert max(abs(e[n] - k[n]) for n in e) < 2e-3


def test_drug_without_dose_is_the_plain_model(comps, edges):
    a = graph.adjacency(edges).cache()
    d = params.drug_rates(base(comps, 0.1)).withColumn("delta", F.lit(0.0)).withColumn("dose_mode", F.lit("bolus")).withColumn("t_dose", F.lit(5.0)).withColumn("dose", F.lit(0.0))
    x = {r["node"]: (r["h"], r["d"], r["f"], r["x"]) for r in dynamics.simulate_drug(d, a, 10.0, 100).where("t_idx = 100").collect()}
    y = {r["node"]: (r["h"], r["d"]) for r in dynamics.simulate(base(comps, 0.1), a, 10.0, 100).where("t_idx = 100").collect()}
    assert all(x[n][:2] == pytest.approx(y[n]) and x[n][2:] == (0.0, 0.0) for n in y)


def test_dose_integrals():
    t = np.linspace(-20, 60, 160_001)
    area = lambda mode: np.trapezoid([dynamics.dose_rate(mode, x, 5.0, 2.0) for x in t], t)
    assert area("bolus") == pytest.approx(2.0, abs=1e-3)
    assert area("no such mode") == pytest.approx(2.0, abs=1e-3)
    assert area("infusion") == pytest.approx(10.0, abs=1e-2)
    assert area("repeated") == pytest.approx(6.0, abs=1e-3)


def test_layers_without_coupling_are_apart(spark, comps, edges):
    """With no edges between layers, a layer that is not seeded stays healthy."""
    c = comps.where("macro in ('PT', 'DCT')")
    e = edges.join(c.select(F.col("node").alias("i"), F.col("macro").alias("a")), "i").join(c.select(F.col("node").alias("j"), F.col("macro").alias("b")), "j").where("a = b").select("i", "j", "w")
    run = dynamics.seeded(params.default_rates(c), 0.1, F.col("macro") == "PT").withColumn("run_id", F.lit("x"))
    t = dynamics.simulate(run, graph.adjacency(e), 20.0, 80).join(c.select("node", "macro"), "node")
    top = {r["macro"]: r["m"] for r in t.groupBy("macro").agg(F.max("d").alias("m")).collect()}
    assert top["DCT"] == 0.0 and top["PT"] > 0.05


def test_matrix_identities(comps, edges):
    rates = params.default_rates(comps)
    t = dynamics.simulate(base(comps), graph.adjacency(edges), 20.0, 80).cache()
    k = matrices.next_generation(t, edges, rates, comps.select("node", F.col("macro").alias("label"))).cache()
    ss = {r["label"]: r for r in matrices.source_sink(k).collect()}
    rows = {r["a"]: r["s"] for r in k.groupBy("a").agg(F.sum("k").alias("s")).collect()}
    assert all(ss[a]["source"] == pytest.approx(s) for a, s in rows.items())
    assert sum(r["net"] for r in ss.values()) == pytest.approx(0, abs=1e-9)
    assert all(r["retention"] + r["dispersal"] == pytest.approx(1) for r in matrices.retention(k).collect())
    h = matrices.entropy(t, comps.select("node", F.col("comp").alias("label"))).agg(F.max("h")).first()[0]
    assert 0 < h <= math.log(len(NAMES)) + 1e-9
    norm = matrices.structural(edges, rates, comps.select("node", F.col("macro").alias("label"))).groupBy("a").agg(F.sum("k_norm").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in norm)


def test_crossing_rises_with_the_threshold(comps, edges):
    t = dynamics.simulate(base(comps), graph.adjacency(edges), 30.0, 120).cache()
    low = {r["node"]: r["t_cross"] for r in metrics.crossing_time(t, 0.1).collect()}
    high = {r["node"]: r["t_cross"] for r in metrics.crossing_time(t, 0.2).collect()}
    assert all(high[n] is None or low[n] <= high[n] for n in low)


def test_rewiring_keeps_degrees(spark):
    ring = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in ring] + [(b, a, 1.0) for a, b in ring], "i long, j long, w double")
    out = design.rewire(e, 3, 10).collect()
    for g in ("rw0", "rw1", "rw2"):
        mine = [(r["i"], r["j"]) for r in out if r["graph_id"] == g]
        assert len(set(mine)) == 12 and all((b, a) in mine for a, b in mine)
        assert all(sum(1 for a, _ in mine if a == n) == 2 for n in range(6))


def test_recovery_rate_multipliers(spark, comps, edges):
    m = spark.createDataFrame([(f"m{x}", x) for x in (0.5, 0.75, 1.0, 1.25, 1.5)], "run_id string, m double")
    c = dynamics.seeded(params.default_rates(comps).crossJoin(m).withColumn("rho", F.col("rho") * F.col("m")))
    o = metrics.run_outputs(dynamics.simulate(c, graph.adjacency(edges), 60.0, 300).cache(), comps).collect()
    assert len(o) == 5 and all(0 <= r["global_r"] <= 1 for r in o)
    assert next(r for r in o if r["run_id"] == "m1.0")["global_r"] > 0.8


def test_designs(spark):
    assert design.one_at_a_time(spark).count() == 14 * 7
    mc = design.monte_carlo(spark, 50).collect()
    assert all(lo <= r["mult"][k] <= hi for r in mc for k, (lo, hi) in dims.SWEEP.items())
    assert [r["mult"] for r in mc] == [r["mult"] for r in design.monte_carlo(spark, 50).collect()]
    mo = design.morris(spark, 2).collect()
    assert len(mo) == 2 * 15
    for a, b in zip(mo, mo[1:]):
        if b["step"]:
            assert [k for k in dims.SWEEP if a["mult"][k] != b["mult"][k]] in ([b["param"]], [])
    p = design.sobol_points(64, 4)
    assert p.shape == (64, 4) and ((p >= 0) & (p < 1)).all()
    assert all(len(set((p[:, d] * 64).astype(int) % 64)) >= 60 for d in range(4))


def test_sobol_indices_of_an_additive_function(spark):
    r = {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    d = design.saltelli(spark, 256, r).cache()
    y = d.select("run_id", (3 * F.col("mult")["a"] + F.col("mult")["b"]).alias("y"))
    got = {x["param"]: x for x in design.sobol_indices(d, y, "y").collect()}
    assert got["a"]["s1"] == pytest.approx(0.9, abs=0.07) and got["b"]["s1"] == pytest.approx(0.1, abs=0.07)
    assert got["a"]["st"] == pytest.approx(0.9, abs=0.07)


def test_too_large_a_graph_is_refused(spark, monkeypatch):
    monkeypatch.setattr(dynamics, "MAX_NODES", 2)
    with pytest.raises(ValueError):
        dynamics.collect_graph(spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (2, 0, 1.0, 1.0)], "i long, j long, wt double, l double"))


def test_runs_meet_their_own_graphs(spark, comps, edges):
    """Runs over graphs of their own equal runs over each graph alone, also where a run's graph has no edges."""
    adj = graph.adjacency(edges)
    half = adj.withColumn("wt", F.col("wt") / 2)
    both = adj.withColumn("graph_id", F.lit("whole")).unionByName(half.withColumn("graph_id", F.lit("half")))
    names = ("whole", "half", "none")
    design_ = base(comps).drop("run_id").crossJoin(spark.createDataFrame([(n, n) for n in names], "run_id string, graph_id string"))
    t = dynamics.simulate(design_, both, 10.0, 40).where("t_idx = 40")
    got = {(r["run_id"], r["node"]): (r["h"], r["d"], r["r"]) for r in t.collect()}
    for name, a in zip(names, (adj, half, adj.where("false"))):
        for r in dynamics.simulate(base(comps), a, 10.0, 40).where("t_idx = 40").collect():
            assert got[name, r["node"]] == pytest.approx((r["h"], r["d"], r["r"]))


def test_bootstrap_intervals(spark):
    """Weights are Poisson draws; intervals hold the indices of an additive function and shrink with the design."""
    w = [r[0] for r in spark.range(20000).select(design.poisson_weight(3, "id")).collect()]
    assert np.mean(w) == pytest.approx(1, abs=0.03) and np.var(w) == pytest.approx(1, abs=0.05) and max(w) < 10
    r = {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    wide = {}
    for n in (64, 512):
        d = design.saltelli(spark, n, r).cache()
        y = d.select("run_id", (3 * F.col("mult")["a"] + F.col("mult")["b"]).alias("y"))
        got = {x["param"]: x for x in design.sobol_intervals(d, y, "y").collect()}
        for name, s1 in (("a", 0.9), ("b", 0.1)):
            assert abs(got[name]["st"] - s1) <= 1.5 * got[name]["st_conf"] and 0 < got[name]["s1_conf"] < 1.2  # the spread of yb (y - ya) over 64 points alone gives 0.8
        wide[n] = got["a"]["st_conf"]
    assert wide[512] < wide[64]


def test_rank_stability(spark):
    rows = [("base", k, float(k)) for k in range(6)] + [("same", k, 2.0 * k) for k in range(6)] + [("turned", k, -1.0 * k) for k in range(6)] + [("flat", k, 1.0) for k in range(6)]
    r = design.rank_stability(spark.createDataFrame(rows, "run_id string, node long, peak double"), "base").first()
    assert (r["n"], r["mean"], r["p05"], r["p95"]) == (2, pytest.approx(0), pytest.approx(-0.9), pytest.approx(0.9))


def test_adjusted_p_values(spark):
    rows = [("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.005), ("f", None), ("g", 0.4), ("g", 0.4), ("g", 0.9)]
    got = {(r["f"], r["p"]): r for r in stats.adjusted(spark.createDataFrame(rows, "f string, p double"), "p", "f").collect()}
    assert [round(got["f", p]["holm"], 9) for p in (0.005, 0.01, 0.03, 0.04)] == [0.02, 0.03, 0.06, 0.06]
    assert [round(got["f", p]["bonferroni"], 9) for p in (0.005, 0.01, 0.03, 0.04)] == [0.02, 0.04, 0.12, 0.16]
    assert got["f", None]["holm"] is None and got["g", 0.4]["holm"] == 1.0 and got["g", 0.9]["m"] == 3
