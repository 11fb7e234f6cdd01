import pytest
from pyspark.sql import functions as F

from lattiq.operators import design, pipelines, synthetic
from lattiq.sources.testdata import compartments, trade_graph

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark):
    t = synthetic.cell_types(synthetic.zones(synthetic.hex_grid(spark, 16))).select("spot", "x", "y", F.col("type").alias("macro")).cache()
    return pipelines.build_compartments(t)


@pytest.fixture(scope="module")
def trade(spark):
    return compartments(spark, SF).cache(), trade_graph(spark, SF).cache()


def test_compartments_and_layers(built):
    n = built["comps"].agg(F.sum("n"), F.countDistinct("comp"), F.count("*")).first()
    assert n[0] == 256 and n[1] == n[2]
    e = {(r["i"], r["j"]): r["w"] for r in built["edges"].collect()}
    assert e and all(e[(j, i)] == pytest.approx(w) for (i, j), w in e.items())
    out = pipelines.run_multilayer(built, t_end=20.0, steps=40)
    assert {r["macro"] for r in out["layers"].collect()} == {"PT", "DCT", "TAL"}
    assert out["globals"].first()["global_peak_d"] > 0 and out["strength"].count() == 6
    apart = pipelines.run_multilayer(built, d_inter=0.0, t_end=20.0, steps=40)
    assert apart["globals"].first()["global_auc_d"] <= out["globals"].first()["global_auc_d"] + 1e-9


def test_single_run(trade):
    out = pipelines.run_single(*trade, t_end=20.0, steps=40)
    for name, df in out.items():
        assert df.count() > 0, name
    settled = pipelines.run_single(*trade, steps=20)["trajectory"].agg(F.max("t")).first()[0]
    assert 5 <= settled <= 60


def test_drug(trade):
    out = pipelines.run_drug(*trade, t_dose=5.0, t_end=30.0, steps=60, sweep=4)
    x = {r["run_id"]: r["x"] for r in out["finals"].groupBy("run_id").agg(F.avg("x").alias("x")).collect()}
    assert x["drug"] < x["none"]
    assert out["sweep"].count() == 4 and 0 <= out["best"].first()["least_dead"] <= 22.5


def test_sensitivity(spark, trade):
    out = pipelines.run_sensitivity(*trade, metric="auc_d", oat=3, trajectories=2, samples=30, t_end=10.0)
    assert out["oat"].count() == 42 and out["tornado"].count() == 12 and out["summary"].count() == 5
    assert out["spearman"].count() == 14 and out["morris"].count() >= 10
    one = pipelines.run_design(*trade, design.grid(spark, "beta_PT", "gamma_PT", 2), t_end=10.0, steps=20)
    assert one.count() == 4


def test_model_and_recovery(trade):
    comps, edges = trade
    rates = comps.select("node", (0.3 + F.col("node") * 0.05).alias("beta"), F.lit(0.05).alias("rho"))
    m = pipelines.DiffusionModel(edges, rates)
    start = comps.limit(3).select("node", F.lit(0.2).alias("d0"))
    t = m.simulate(start, 10.0, 0.05).cache()
    s = t.select((F.col("h") + F.col("d") + F.col("r")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert s[0] == pytest.approx(1) and s[1] == pytest.approx(1)
    assert t.select("t_idx").distinct().count() == 201
    assert m.metrics(t).count() == 25
    same = pipelines.recovery(t.where("t_idx % 10 = 0"), t).first()
    assert same["rmse_d"] == pytest.approx(0, abs=1e-12) and same["r"] == pytest.approx(1) and same["mae_t"] == 0
    other = pipelines.recovery(t, m.simulate(start, 10.0, 0.1), 0.15).first()
    assert 0 < other["rmse_d"] < 0.01 and other["rho"] > 0.95
