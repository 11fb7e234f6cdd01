"""Whole analyses put together from the operators. Each gives a dict of DataFrames, or one where that is all there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import is_boundary
from ..session import cut
from . import annotate, design, dynamics, graph, matrices, metrics, params, stats


def build_compartments(spots: DataFrame, values: DataFrame | None = None, markers: DataFrame | None = None, k: int = 6, mode: str = "avg", split: bool = False, min_size: int = 5) -> dict[str, DataFrame]:
    """From spots (spot, x, y, macro) to a labelled compartment graph.

    Zones come from marker scores where values and markers are given and a score is above 0, else from the radius.
    Gives spot_edges (i, j, w), labels (i, comp, macro, region), comps (node, comp, macro, region, is_boundary, n)
    and edges (i, j, w over nodes).
    """
    zoned = graph.radial_zones(spots).select("spot", "x", "y", "macro", "zone")
    if values is not None and markers is not None:
        best = annotate.best_zone(annotate.zone_scores(values, markers)).select("spot", F.col("zone").alias("marked"))
        zoned = zoned.join(best, "spot", "left").withColumn("zone", F.coalesce("marked", "zone")).drop("marked")
    labels = cut(zoned.select(F.col("spot").alias("i"), "macro", F.col("zone").alias("region"), F.concat_ws("_", "macro", "zone").alias("comp")), "labels")
    spot_edges = cut(graph.gaussian_graph(graph.knn(spots, k).cache()), "spot_edges")
    if split:
        parts = graph.split_components(spot_edges, labels, min_size).select("i", "part")
        labels = cut(labels.join(parts, "i").select("i", "macro", "region", F.col("part").alias("comp")), "parts")
    comps = labels.groupBy("comp", "macro", "region").agg(F.count("*").alias("n"))
    place = F.row_number().over(_by_name()) - 1  # a row a compartment
    comps = cut(comps.select(place.cast("long").alias("node"), "comp", "macro", "region", is_boundary().alias("is_boundary"), "n"), "comps")
    coarse = graph.coarse_grain(spot_edges, labels.select("i", "comp"), mode)
    edges = coarse.join(comps.select(F.col("comp").alias("ca"), F.col("node").alias("i")), "ca").join(comps.select(F.col("comp").alias("cb"), F.col("node").alias("j")), "cb").select("i", "j", "w")
    return {"spot_edges": spot_edges, "labels": labels, "comps": comps, "edges": cut(edges, "edges")}


def _by_name():
    from pyspark.sql import Window

    return Window.orderBy("comp")


def run_single(comps: DataFrame, edges: DataFrame, seed: float = 0.05, t_end: float | None = None, steps: int = 300, convention: str = "sym") -> dict[str, DataFrame]:
    """One run with its metrics, group summaries and matrices. t_end: by default when the mean of d has settled."""
    rates = params.default_rates(comps, outer_only=convention == "row")
    adj = graph.adjacency(edges, convention).cache()
    start = dynamics.seeded(rates, seed).withColumn("run_id", F.lit("run"))
    if t_end is None:
        t_end = metrics.settle_time(dynamics.simulate(start, adj, 60.0, 600, "rk45")).first()["t_end"]
    traj = cut(dynamics.simulate(start, adj, t_end, steps, "rk45", conserve=convention == "row"), "run")
    label = comps.select("node", F.col("macro").alias("label"))
    k = cut(matrices.next_generation(traj, edges, rates, label), "k")
    cross = metrics.crossing_time(traj)
    return {
        "trajectory": traj,
        "finals": dynamics.finals(traj),
        "invasion": metrics.invasion_metrics(traj),
        "summary": metrics.state_summary(dynamics.finals(traj), comps, cross),
        "ratios": params.plausible_ratio(rates),
        "next_generation": k,
        "structural": matrices.structural(edges, rates, label),
        "source_sink": matrices.source_sink(k),
        "retention": matrices.retention(k),
        "entropy": matrices.entropy(traj, label),
        "edge_flux": matrices.edge_flux(traj, edges, rates, comps),
        "layer_flux": matrices.receiver_flux(traj, edges, rates, comps),
    }


def layered(comps: DataFrame, edges: DataFrame, coupling: DataFrame, layers: tuple[str, ...] = dims.LAYERS) -> tuple[DataFrame, DataFrame]:
    """(rates, adjacency) of the layered model: each layer's own graph, and coupling (i, j, w) as exposure alone."""
    rates = params.default_rates(comps).where(F.col("macro").isin(*layers))
    a, b = rates.select(F.col("node").alias("i"), F.col("macro").alias("ma")), rates.select(F.col("node").alias("j"), F.col("macro").alias("mb"))
    own = graph.adjacency(edges.join(a, "i").join(b, "j").where("ma = mb").select("i", "j", "w"), "sym")
    inter = coupling.join(a, "i").join(b, "j").where("ma <> mb").select("i", "j", F.col("w").alias("wt"), F.lit(0.0).alias("l"))
    return rates, own.unionByName(inter)


def run_multilayer(built: dict[str, DataFrame], d_inter: float = 0.05, seed: float = 0.1, t_end: float = 50.0, steps: int = 500, layers: tuple[str, ...] = dims.LAYERS) -> dict[str, DataFrame]:
    """The layered model on built compartments, coupled through spot edges between layers; a layer without compartments is left out."""
    comps = built["comps"]
    spark = comps.sparkSession
    dd = params.default_rates(comps).select("comp", "macro", "d_d")
    topo = spark.createDataFrame(list(dims.TOPOLOGY), "ma string, mb string")
    c = graph.interlayer(built["spot_edges"], built["labels"], dd, topo, d_inter)
    node = comps.select("comp", "node")
    pairs = c.join(node.select(F.col("comp").alias("ca"), F.col("node").alias("i")), "ca").join(node.select(F.col("comp").alias("cb"), F.col("node").alias("j")), "cb").select("i", "j", "w")
    rates, adj = layered(comps, built["edges"], pairs, layers)
    traj = cut(dynamics.simulate(dynamics.seeded(rates, seed).withColumn("run_id", F.lit("layers")), adj, t_end, steps, "rk45", bounded=True), "layers")
    by = metrics.layer_metrics(traj, comps, layers).cache()
    return {"trajectory": traj, "coupling": pairs, "strength": graph.interlayer_summary(c, dd.where(F.col("macro").isin(*layers))), "layers": by, "globals": metrics.weighted_globals(by)}


def run_drug(comps: DataFrame, edges: DataFrame, t_dose: float = 20.0, mode: str = "bolus", dose: float = 1.0, seed: float = 0.1, t_end: float = 80.0, steps: int = 400, sweep: int = 20) -> dict[str, DataFrame]:
    """Drug and no-drug runs, their summaries, and a sweep of dose times over the first three quarters of the span."""
    spark = comps.sparkSession
    start = dynamics.seeded(params.drug_rates(params.default_rates(comps)), seed)
    adj = graph.adjacency(edges).cache()
    two = spark.createDataFrame([("drug", mode, t_dose, dose), ("none", mode, t_dose, 0.0)], "run_id string, dose_mode string, t_dose double, dose double")
    traj = cut(dynamics.simulate_drug(F.broadcast(start).crossJoin(two), adj, t_end, steps, "rk45"), "drug")
    out = {"trajectory": traj, "summary": metrics.drug_summary(traj, comps), "finals": dynamics.finals(traj, ("h", "d", "d2", "r", "x"))}
    if sweep:
        grid = spark.range(sweep).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("run_id"), F.lit(mode).alias("dose_mode"), (F.col("id") * (0.75 * t_end / max(sweep - 1, 1))).alias("t_dose"), F.lit(dose).alias("dose"))
        runs = dynamics.simulate_drug(F.broadcast(start).crossJoin(grid), adj, t_end, steps // 2, "rk45", 1e-4)
        end = dynamics.finals(runs, ("h", "d", "d2", "r", "x")).groupBy("run_id").agg(F.avg("x").alias("mean_x"), F.avg("r").alias("mean_r")).join(grid, "run_id")
        out["sweep"] = cut(end, "sweep")
        best = out["sweep"].agg(F.min_by("t_dose", F.struct("mean_x", "t_dose")).alias("least_dead"), F.max_by("t_dose", F.struct(F.col("mean_r"), -F.col("t_dose"))).alias("most_recovered"))
        out["best"] = best
    return out


def run_design(comps: DataFrame, edges: DataFrame, runs: DataFrame, seed: float = 0.1, t_end: float = 30.0, steps: int = 150) -> DataFrame:
    """Outputs of each run of a design (run_id, mult)."""
    rates = params.with_multipliers(params.default_rates(comps), runs.select("run_id", "mult"))
    return metrics.run_outputs(cut(dynamics.simulate(dynamics.seeded(rates, seed), graph.adjacency(edges), t_end, steps, "rk45", rtol=1e-4), "design"), comps)


def run_sensitivity(comps: DataFrame, edges: DataFrame, metric: str = "global_r", oat: int = 7, trajectories: int = 10, samples: int = 200, t_end: float = 30.0) -> dict[str, DataFrame]:
    """One-at-a-time, Morris and Monte Carlo designs over all multipliers: tornado, effects, summary and rank correlations."""
    spark = comps.sparkSession
    a, b, c = design.one_at_a_time(spark, oat), design.morris(spark, trajectories), design.monte_carlo(spark, samples)
    ya, yb, yc = (cut(run_design(comps, edges, d, t_end=t_end), "sens") for d in (a, b, c))
    rows = design.long_multipliers(c).join(yc.select("run_id", metric), "run_id")
    return {
        "oat": ya.join(a.drop("mult"), "run_id"),
        "tornado": design.tornado(ya.join(a, "run_id"), metric),
        "morris": design.elementary_effects(b, yb, metric),
        "summary": stats.summary(yc, "global_r", "peak_d", "auc_d", "mean_inv_time", "frac_invaded"),
        "spearman": stats.spearman_test(rows, "multiplier", metric, "param"),
    }


def recovery(truth: DataFrame, sim: DataFrame, threshold: float = 0.1) -> DataFrame:
    """rmse_d, mae_t, r, rho, tau of simulated against true trajectories (node, t, d), the simulated ones interpolated at the true times."""
    x = metrics.interpolate(sim.select("node", "t", F.col("d").alias("x")), truth.select("node", "t"), "node")
    both = cut(truth.select("node", "t", F.col("d").alias("y")).join(x, ["node", "t"]), "recovery")
    when = lambda c: F.min(F.when(F.col(c) >= threshold, F.col("t")))
    act = cut(both.groupBy("node").agg(when("y").alias("ty"), when("x").alias("tx")), "act")
    known = act.where("ty is not null and tx is not null")
    one = both.agg(F.sqrt(F.avg((F.col("x") - F.col("y")) ** 2)).alias("rmse_d"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))
    mae = known.agg(F.avg(F.abs(F.col("tx") - F.col("ty"))).alias("mae_t"))
    return one.crossJoin(mae).crossJoin(stats.spearman(known, "tx", "ty").select("rho")).crossJoin(F.broadcast(stats.kendall(known, "tx", "ty").select("tau")))


class DiffusionModel:
    """A dataset-agnostic model: raw weights whose self edges count in the exposure, Euler steps scaled to sum to 1."""

    def __init__(self, edges: DataFrame, rates: DataFrame) -> None:
        """edges (i, j, w); rates (node, beta, rho and, where it diffuses, d_h, d_d)."""
        for c in ("d_h", "d_d"):
            if c not in rates.columns:
                rates = rates.withColumn(c, F.lit(0.0))
        self.rates, self.adjacency = rates, graph.adjacency(edges, "raw")

    def simulate(self, start: DataFrame, t_end: float = 60.0, dt: float = 0.05) -> DataFrame:
        """Trajectory from start (node, d0)."""
        runs = self.rates.join(start, "node", "left").withColumn("d0", F.coalesce("d0", F.lit(0.0))).withColumn("h0", 1 - F.col("d0")).withColumn("run_id", F.lit("model"))
        steps = -int(-t_end // dt)
        return dynamics.simulate(runs, self.adjacency, steps * dt, steps, renormalise=True)

    def metrics(self, trajectory: DataFrame, threshold: float = 0.1) -> DataFrame:
        m = metrics.invasion_metrics(trajectory, threshold)
        return m.select("node", F.col("invasion_time").alias("t_act"), "t_peak", "auc_d", F.col("attack_rate").alias("p_r_fin"), F.col("max_d").alias("peak"))
