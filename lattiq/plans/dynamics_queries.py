"""Queries of rates, state evolution and trajectory metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import r6
from ..operators import dynamics as D
from ..operators import graph as G
from ..operators import matrices as X
from ..operators import metrics as M
from ..operators import params as P
from ..session import cut
from ..sources.testdata import compartments, observed, table, trade_graph
from .catalog import BASE, BASE_PRE, COMPS, CROSS, DIMS, EDGES, FINALS, OUTER, OUTPUTS, RATES, STEPS, T_END, adj, argmax_first, ctes, drug_sim, query, seeded, sim, trapz, values
from .graph_queries import labelled


def rates(spark, sf_dir):
    return P.default_rates(compartments(spark, sf_dir))


def base_run(spark, sf_dir, t_end=T_END, steps=STEPS):
    """The plain run on the trade graph: symmetric-normalised, seeded on the boundary."""
    design = D.seeded(rates(spark, sf_dir)).withColumn("run_id", F.lit("base"))
    return D.simulate(design, G.adjacency(trade_graph(spark, sf_dir), "sym"), t_end, steps)


@query(ctes(COMPS, DIMS, RATES) + "SELECT node, comp, round(beta, 6) AS beta, round(rho, 6) AS rho, d_h, d_d FROM rates")
def sir_params(spark, sf_dir):
    return rates(spark, sf_dir).select("node", "comp", r6("beta"), r6("rho"), "d_h", "d_d")


DRUG_DIMS = ", ".join([values([(k, dims.MACRO_DELTA[k], dims.MACRO_D_F[k]) for k in dims.MACROS], "dr", "macro, delta, d_f"), values(list(dims.REGION_DELTA.items()), "dm", "region, m")])
DRUG_RATES = "drug AS (SELECT rates.*, dr.delta * coalesce(dm.m, 1) AS delta, rho * 1.5 AS rho2, dr.d_f FROM rates JOIN dr USING (macro) LEFT JOIN dm USING (region))"


@query(ctes(COMPS, DIMS, RATES, DRUG_DIMS, DRUG_RATES) + "SELECT node, round(delta, 6) AS delta, round(rho2, 6) AS rho2, CAST(0.5 AS DOUBLE) AS k_f, CAST(0.15 AS DOUBLE) AS k_e, d_f FROM drug")
def drug_params(spark, sf_dir):
    return P.drug_rates(rates(spark, sf_dir)).select("node", r6("delta"), r6("rho2"), "k_f", "k_e", "d_f")


@query(ctes(COMPS, DIMS, RATES, values([(k, *v) for k, v in dims.PLAUSIBLE.items()], "pl", "macro, low, high")) + "SELECT macro, round(avg(beta / rho), 6) AS mean_r, avg(beta / rho) BETWEEN any_value(low) AND any_value(high) AS ok FROM rates JOIN pl USING (macro) GROUP BY 1")
def rdiff_range_check(spark, sf_dir):
    return P.plausible_ratio(rates(spark, sf_dir)).select("macro", r6("mean_r"), "ok")


@query(ctes(COMPS, DIMS, RATES) + "SELECT node, comp, round(beta / rho, 6) AS r_diff, beta / rho > 1 AS amplifier FROM rates")
def amplifiers(spark, sf_dir):
    return rates(spark, sf_dir).select("node", "comp", F.round(F.col("beta") / F.col("rho"), 6).alias("r_diff"), (F.col("beta") / F.col("rho") > 1).alias("amplifier"))


SHOWN = "SELECT t_idx, round(t, 6) AS t, node, round(h, 6) AS h, round(d, 6) AS d, round(r, 6) AS r FROM traj"


def _shown(traj):
    return traj.select("t_idx", r6("t"), "node", r6("h"), r6("d"), r6("r"))


@query(ctes(BASE) + SHOWN)
def euler_hdr(spark, sf_dir):
    return _shown(base_run(spark, sf_dir))


@query(ctes(COMPS, EDGES, DIMS, OUTER, adj("row"), seeded(), sim(30.0, 120, True)) + SHOWN)
def euler_section7(spark, sf_dir):
    """The simplified model: rows scaled to 1, outer multipliers only, mass conserved."""
    c = D.seeded(P.default_rates(compartments(spark, sf_dir), outer_only=True)).withColumn("run_id", F.lit("base"))
    return _shown(D.simulate(c, G.adjacency(trade_graph(spark, sf_dir), "row"), 30.0, 120, conserve=True))


DOSES = [("bolus", 8.0), ("infusion", 8.0), ("repeated", 4.0)]


def _drug_design(spark, sf_dir, doses):
    d = spark.createDataFrame([(m, m, t) for m, t in doses], "run_id string, dose_mode string, t_dose double").withColumn("dose", F.lit(1.0))
    return F.broadcast(D.seeded(P.drug_rates(rates(spark, sf_dir)), 0.1)).crossJoin(d)  # a row a compartment


def _drug_par(doses):
    return ", ".join([DRUG_DIMS, DRUG_RATES, values(doses, "ds", "mode, t_dose"), "drun AS (SELECT * FROM drug, ds)", seeded(seed=0.1, run="mode", source="drun", extra=", delta, rho2, d_f, mode, t_dose")])


@query(ctes(BASE_PRE, _drug_par(DOSES), drug_sim(20.0, 80)) + "SELECT run_id, t_idx, node, round(h, 6) AS h, round(d, 6) AS d, round(d2, 6) AS d2, round(r, 6) AS r, round(x, 6) AS x, round(f, 6) AS f FROM traj")
def euler_drug(spark, sf_dir):
    """Three ways of dosing."""
    t = D.simulate_drug(_drug_design(spark, sf_dir, DOSES), G.adjacency(trade_graph(spark, sf_dir), "sym"), 20.0, 80)
    return t.select("run_id", "t_idx", "node", *[r6(c) for c in ("h", "d", "d2", "r", "x", "f")])


LAYERED = "ledges AS (SELECT e.i, e.j, e.w FROM edges e JOIN comps a ON a.node = e.i JOIN comps b ON b.node = e.j WHERE a.macro = b.macro AND a.macro IN ('PT', 'DCT', 'TAL'))"
CROSSING = f"inter AS (SELECT e.i, e.j, CAST(0.05 AS DOUBLE) * e.w * sqrt(a.d_d * b.d_d) AS w FROM edges e JOIN rates a ON a.node = e.i JOIN rates b ON b.node = e.j WHERE a.macro <> b.macro AND a.macro IN ('PT', 'DCT', 'TAL') AND b.macro IN ('PT', 'DCT', 'TAL'))"


def layered_parts(spark, sf_dir):
    """Rates of the layers, their own graphs with symmetric-normalised Laplacians, and the coupling of unit strength between them."""
    c = rates(spark, sf_dir).where(F.col("macro").isin(*dims.LAYERS))
    a, b = c.select(F.col("node").alias("i"), F.col("macro").alias("ma"), F.col("d_d").alias("da")), c.select(F.col("node").alias("j"), F.col("macro").alias("mb"), F.col("d_d").alias("db"))
    e = cut(trade_graph(spark, sf_dir).join(a, "i").join(b, "j"), "layers")  # a row a pair of compartments
    inter = e.where("ma <> mb").select("i", "j", (F.col("w") * F.sqrt(F.col("da") * F.col("db"))).alias("u"))
    return c, G.adjacency(e.where("ma = mb").select("i", "j", "w"), "sym"), inter


def layered_adjacency(spark, sf_dir, d_inter=0.05):
    """Layers' own graphs and coupling between layers as exposure alone."""
    c, own, inter = layered_parts(spark, sf_dir)
    return c, own.unionByName(inter.select("i", "j", (F.lit(d_inter) * F.col("u")).alias("wt"), F.lit(0.0).alias("l")))


LAYER_ADJ = ", ".join([LAYERED, adj("sym", "ledges").replace("adj AS (", "adj0 AS ("), CROSSING, "adj AS (SELECT * FROM adj0 UNION ALL SELECT 'g', i, j, w, 0 FROM inter)", "lrates AS (SELECT * FROM rates WHERE macro IN ('PT', 'DCT', 'TAL'))"])
LAYER_RUN = ", ".join([COMPS, EDGES, DIMS, RATES, LAYER_ADJ, seeded(seed=0.1, source="lrates"), sim(30.0, 120, bounded=True)])


def layer_run(spark, sf_dir, d_inter=0.05):
    c, a = layered_adjacency(spark, sf_dir, d_inter)
    return c, D.simulate(D.seeded(c, 0.1).withColumn("run_id", F.lit("base")), a, 30.0, 120, bounded=True)


@query(ctes(LAYER_RUN) + SHOWN)
def euler_multilayer(spark, sf_dir):
    return _shown(layer_run(spark, sf_dir)[1])


@query(ctes(BASE) + "SELECT round(greatest(5, least(60, coalesce(min(t) FILTER (WHERE m < 0.05), 60))), 6) AS t_end FROM (SELECT t, avg(d) AS m FROM traj GROUP BY 1)")
def suggest_t_end(spark, sf_dir):
    return M.settle_time(base_run(spark, sf_dir), 0.05).select(r6("t_end"))


@query()
def rk45_hdr(spark, sf_dir):
    """Adaptive steps; the tests hold it against small Euler steps and closed forms."""
    design = D.seeded(rates(spark, sf_dir)).withColumn("run_id", F.lit("base"))
    return _shown(D.simulate(design, G.adjacency(trade_graph(spark, sf_dir), "sym"), T_END, 60, "rk45"))


@query()
def rk45_drug(spark, sf_dir):
    t = D.simulate_drug(_drug_design(spark, sf_dir, DOSES), G.adjacency(trade_graph(spark, sf_dir), "sym"), 20.0, 40, "rk45")
    return t.select("run_id", "t_idx", "node", *[r6(c) for c in ("h", "d", "d2", "r", "x", "f")])


@query(ctes(BASE, CROSS) + "SELECT node, round(t_cross, 6) AS t_cross FROM crossed")
def crossing_time(spark, sf_dir):
    return M.crossing_time(base_run(spark, sf_dir)).select("node", r6("t_cross"))


INVASION = f"""gr AS (SELECT *, lag(t) OVER w AS t0, lead(t) OVER w AS t2, lag(d) OVER w AS f0, lead(d) OVER w AS f2 FROM traj WINDOW w AS (PARTITION BY run_id, node ORDER BY t)),
gv AS (SELECT *, CASE WHEN t0 IS NULL THEN (f2 - d) / (t2 - t) WHEN t2 IS NULL THEN (d - f0) / (t - t0)
  ELSE ((t - t0) * (t - t0) * f2 + ((t2 - t) * (t2 - t) - (t - t0) * (t - t0)) * d - (t2 - t) * (t2 - t) * f0) / ((t - t0) * (t2 - t) * (t2 - t0)) END AS v, coalesce((t - t0) * (d + f0) / 2, 0) AS area FROM gr),
inv AS (SELECT run_id, node, min(t) FILTER (WHERE d > 0.1) AS invasion_time, {argmax_first("t", "d")} AS t_peak, sum(area) AS auc_d, arg_max(r, t_idx) AS attack_rate, max(v) AS peak_velocity, max(d) AS max_d, arg_max(d, t_idx) AS final_d FROM gv GROUP BY 1, 2)"""
INV_COLS = ("invasion_time", "t_peak", "auc_d", "attack_rate", "peak_velocity", "max_d", "final_d")


@query(ctes(BASE, INVASION) + f"SELECT node, {', '.join(f'round({c}, 6) AS {c}' for c in INV_COLS)} FROM inv")
def invasion_metrics(spark, sf_dir):
    return M.invasion_metrics(base_run(spark, sf_dir)).select("node", *[r6(c) for c in INV_COLS])


@query(ctes(BASE, INVASION) + "SELECT count(*) AS n, count(invasion_time) AS n_invaded, round(avg(invasion_time), 6) AS mean_invasion_time, round(min(invasion_time), 6) AS first_invasion_time, round(avg(attack_rate), 6) AS mean_attack_rate FROM inv")
def invasion_summary(spark, sf_dir):
    return M.invasion_summary(M.invasion_metrics(base_run(spark, sf_dir))).select("n", "n_invaded", r6("mean_invasion_time"), r6("first_invasion_time"), r6("mean_attack_rate"))


@query(ctes(BASE, INVASION) + f"SELECT macro, {', '.join(f'''round(avg(attack_rate) FILTER (WHERE region = '{r}'), 6) AS {r}''' for r in dims.REGIONS)} FROM inv JOIN comps USING (node) GROUP BY 1")
def invasion_pivot(spark, sf_dir):
    m = M.invasion_metrics(base_run(spark, sf_dir)).join(compartments(spark, sf_dir), "node")
    p = m.groupBy("macro").pivot("region", list(dims.REGIONS)).agg(F.round(F.avg("attack_rate"), 6))
    return p.select("macro", *dims.REGIONS)


@query(ctes(BASE, CROSS, FINALS) + "SELECT CASE grouping(macro, region) WHEN 3 THEN 'global' WHEN 1 THEN 'macro' ELSE 'region' END AS level, macro, region, round(avg(h), 6) AS mean_h, round(avg(d), 6) AS mean_d, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN t_cross IS NULL THEN 0.0 ELSE 1.0 END), 6) AS frac_invaded FROM finals JOIN comps USING (node) JOIN crossed USING (node) GROUP BY GROUPING SETS ((), (macro), (region))")
def state_summary_grouping_sets(spark, sf_dir):
    t = base_run(spark, sf_dir).cache()
    return M.state_summary(D.finals(t), compartments(spark, sf_dir), M.crossing_time(t)).select("level", "macro", "region", r6("mean_h"), r6("mean_d"), r6("mean_r"), r6("frac_invaded"))


def _temporal(by):
    return f"gm AS (SELECT {by}, t, avg(d) AS d FROM traj JOIN comps USING (node) GROUP BY 1, 2), {trapz('d', 'gm', by, 'gauc')}, tm AS (SELECT {by}, max(d) AS peak_d, {argmax_first('t', 'd')} AS t_peak, any_value(k) AS auc_d, min(t) FILTER (WHERE d > 0.1) AS t_cross FROM gm JOIN gauc USING ({by}) GROUP BY 1)"


@query(ctes(BASE, _temporal("region")) + "SELECT region, round(peak_d, 6) AS peak_d, round(t_peak, 6) AS t_peak, round(auc_d, 6) AS auc_d, round(t_cross, 6) AS t_cross FROM tm")
def temporal_metrics_region(spark, sf_dir):
    t = base_run(spark, sf_dir).join(compartments(spark, sf_dir).select("node", "region"), "node")
    return M.temporal_metrics(M.group_trajectory(t, "region"), "region").select("region", r6("peak_d"), r6("t_peak"), r6("auc_d"), r6("t_cross"))


@query(ctes(BASE) + "SELECT macro, t_idx, round(avg(h), 6) AS h, round(avg(d), 6) AS d, round(avg(r), 6) AS r, round(stddev_pop(d), 6) AS sd_d FROM traj JOIN comps USING (node) GROUP BY 1, 2")
def macro_trajectories(spark, sf_dir):
    t = base_run(spark, sf_dir).join(compartments(spark, sf_dir).select("node", "macro"), "node")
    return t.groupBy("macro", "t_idx").agg(F.round(F.avg("h"), 6).alias("h"), F.round(F.avg("d"), 6).alias("d"), F.round(F.avg("r"), 6).alias("r"), F.round(F.stddev_pop("d"), 6).alias("sd_d"))


LAYERS = f"lm AS (SELECT macro, t, avg(d) AS d FROM traj JOIN comps USING (node) GROUP BY 1, 2), {trapz('d', 'lm', 'macro', 'lauc')}, ln AS (SELECT macro, count(*) AS n, avg(CASE WHEN c IS NULL THEN 0.0 ELSE 1.0 END) AS frac_invaded FROM (SELECT macro, node, min(t) FILTER (WHERE d > 0.1) AS c FROM traj JOIN comps USING (node) GROUP BY 1, 2) GROUP BY 1), lay AS (SELECT macro, any_value(n) AS n, max(d) AS peak_d, {argmax_first('t', 'd')} AS t_peak, any_value(k) AS auc_d, min(t) FILTER (WHERE d > 0.1) AS t_cross, any_value(frac_invaded) AS frac_invaded FROM lm JOIN lauc USING (macro) JOIN ln USING (macro) GROUP BY 1)"


@query(ctes(LAYER_RUN, LAYERS) + "SELECT macro, n, round(peak_d, 6) AS peak_d, round(t_peak, 6) AS t_peak, round(auc_d, 6) AS auc_d, round(t_cross, 6) AS t_cross, round(frac_invaded, 6) AS frac_invaded, row_number() OVER (ORDER BY t_cross NULLS LAST, macro) = 1 AS most_vulnerable FROM lay")
def multilayer_metrics(spark, sf_dir):
    c, t = layer_run(spark, sf_dir)
    return M.layer_metrics(t, c, dims.LAYERS).select("macro", "n", r6("peak_d"), r6("t_peak"), r6("auc_d"), r6("t_cross"), r6("frac_invaded"), "most_vulnerable")


@query(ctes(LAYER_RUN, LAYERS) + "SELECT round(sum(peak_d * n) / sum(n), 6) AS global_peak_d, round(sum(auc_d * n) / sum(n), 6) AS global_auc_d, round(sum(frac_invaded * n) / sum(n), 6) AS global_frac_invaded FROM lay")
def multilayer_globals(spark, sf_dir):
    c, t = layer_run(spark, sf_dir)
    return M.weighted_globals(M.layer_metrics(t, c, dims.LAYERS)).select(r6("global_peak_d"), r6("global_auc_d"), r6("global_frac_invaded"))


@query(ctes(BASE_PRE, _drug_par(DOSES), drug_sim(20.0, 80)) + f""", le AS (SELECT run_id, macro, node, arg_max(h, t_idx) AS h, arg_max(d, t_idx) AS d, arg_max(d2, t_idx) AS d2, arg_max(r, t_idx) AS r, arg_max(x, t_idx) AS x, max(d) AS top FROM traj JOIN comps USING (node) GROUP BY 1, 2, 3),
fm AS (SELECT run_id, macro, t, avg(f) AS f FROM traj JOIN comps USING (node) GROUP BY 1, 2, 3)
SELECT run_id, macro, round(avg(d), 6) AS final_d, round(avg(r), 6) AS final_r, round(avg(x), 6) AS final_x, round(avg(CASE WHEN top > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS frac_invaded, any_value(pf) AS peak_f, any_value(tf) AS t_peak_f
FROM le JOIN (SELECT run_id, macro, round(max(f), 6) AS pf, round({argmax_first('t', 'f')}, 6) AS tf FROM fm GROUP BY 1, 2) USING (run_id, macro) GROUP BY 1, 2""")
def drug_metrics(spark, sf_dir):
    t = D.simulate_drug(_drug_design(spark, sf_dir, DOSES), G.adjacency(trade_graph(spark, sf_dir), "sym"), 20.0, 80)
    return M.drug_summary(t.cache(), compartments(spark, sf_dir)).select("run_id", "macro", r6("final_d"), r6("final_r"), r6("final_x"), r6("frac_invaded"), r6("peak_f"), r6("t_peak_f"))


OBS = "ob0 AS (SELECT user_id % 15 AS node, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, avg(value) AS m FROM events GROUP BY 1, 2), obs AS (SELECT node, CAST(day - min(day) OVER () AS DOUBLE) AS t, m / max(m) OVER () AS d FROM ob0)"


def _observed(spark, sf_dir):
    o = observed(spark, sf_dir)
    return o.select(F.lit("obs").alias("run_id"), F.col("t").cast("int").alias("t_idx"), "t", "node", (1 - F.col("d")).alias("h"), "d", F.lit(0.0).alias("r"))


@query(ctes(OBS) + f"SELECT node, round(max(d), 6) AS peak, round({argmax_first('t', 'd')}, 6) AS t_peak, round(min(t) FILTER (WHERE d > 0.4), 6) AS t_cross FROM obs GROUP BY 1")
def observed_peaks(spark, sf_dir):
    o = _observed(spark, sf_dir)
    m = M.invasion_metrics(o, 0.4)
    return m.select("node", F.round("max_d", 6).alias("peak"), r6("t_peak"), F.round("invasion_time", 6).alias("t_cross"))


FRONT = """co AS (SELECT node, CAST(node % 5 AS DOUBLE) AS x, CAST(node // 5 AS DOUBLE) AS y FROM comps),
st AS (SELECT node, d, x, y, max(d) OVER () AS top FROM traj JOIN co USING (node) WHERE t_idx = 0),
sd AS (SELECT avg(x) AS sx, avg(y) AS sy FROM st WHERE CASE WHEN top > 0.2 THEN d > 0.2 ELSE d >= 0.8 * top END),
fr AS (SELECT t_idx, t, avg(CASE WHEN d > 0.2 THEN 1.0 ELSE 0.0 END) AS area, coalesce(quantile_cont(sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), 0.9) FILTER (WHERE d > 0.2), 0) AS radius FROM traj JOIN co USING (node), sd GROUP BY 1, 2),
fm AS (SELECT t_idx, t, area, max(radius) OVER (ORDER BY t_idx) AS radius FROM fr),
fs AS (SELECT *, CASE WHEN t_idx < 2 OR t_idx >= count(*) OVER () - 3 THEN radius ELSE (lag(radius, 2) OVER w + lag(radius) OVER w + radius + lead(radius) OVER w + lead(radius, 2) OVER w) / 5 END AS radius_smooth FROM fm WINDOW w AS (ORDER BY t_idx)),
fg AS (SELECT *, lag(t) OVER w AS t0, lead(t) OVER w AS t2, lag(radius_smooth) OVER w AS f0, lead(radius_smooth) OVER w AS f2 FROM fs WINDOW w AS (ORDER BY t_idx))"""


def _coords(spark, sf_dir):
    return compartments(spark, sf_dir).select("node", (F.col("node") % 5).cast("double").alias("x"), F.floor(F.col("node") / 5).cast("double").alias("y"))


@query(ctes(BASE, FRONT) + "SELECT t_idx, round(area, 6) AS area, round(radius, 6) AS radius, round(radius_smooth, 6) AS radius_smooth, round(greatest(0, CASE WHEN t0 IS NULL THEN (f2 - radius_smooth) / (t2 - t) WHEN t2 IS NULL THEN (radius_smooth - f0) / (t - t0) ELSE (f2 - f0) / (t2 - t0) END), 6) AS velocity FROM fg")
def front_area_radius(spark, sf_dir):
    return M.front(base_run(spark, sf_dir), _coords(spark, sf_dir), 0.2).select("t_idx", r6("area"), r6("radius"), r6("radius_smooth"), r6("velocity"))


@query(ctes(BASE) + f", wt(wanted) AS (VALUES (CAST(3.1 AS DOUBLE)), (12.0), (99.0)), nr AS (SELECT wanted, first(t_idx ORDER BY abs(t - wanted), t) AS t_idx FROM (SELECT DISTINCT t_idx, t FROM traj), wt GROUP BY 1) SELECT wanted, t_idx, node, round(d, 6) AS d FROM traj JOIN nr USING (t_idx)")
def snapshot_nearest(spark, sf_dir):
    return M.snapshots(base_run(spark, sf_dir), [3.1, 12.0, 99.0]).select("wanted", "t_idx", "node", r6("d"))


@query(ctes(BASE) + ", pk AS (SELECT first(t_idx ORDER BY m DESC, t_idx) AS t_idx FROM (SELECT t_idx, avg(d) AS m FROM traj GROUP BY 1)) SELECT t_idx, node, round(h, 6) AS h, round(d, 6) AS d, round(r, 6) AS r FROM traj JOIN pk USING (t_idx)")
def snapshot_peak(spark, sf_dir):
    return M.peak_snapshot(base_run(spark, sf_dir).cache()).select("t_idx", "node", r6("h"), r6("d"), r6("r"))


@query(ctes(COMPS, EDGES, DIMS, RATES, adj(), seeded(), sim(30.0, 120), OBS) + """, ip AS (SELECT o.node, o.t, o.d, (SELECT arg_max(b.d, b.t) FROM traj b WHERE b.node = o.node AND b.t <= o.t) AS x0, (SELECT max(b.t) FROM traj b WHERE b.node = o.node AND b.t <= o.t) AS t0, (SELECT arg_min(b.d, b.t) FROM traj b WHERE b.node = o.node AND b.t >= o.t) AS x1, (SELECT min(b.t) FROM traj b WHERE b.node = o.node AND b.t >= o.t) AS t1 FROM (SELECT node, t + 0.1 AS t, d FROM obs) o)
SELECT node, round(sqrt(avg((d - CASE WHEN t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END) ** 2)), 6) AS rmse FROM ip GROUP BY 1""")
def interp_grid_rmse(spark, sf_dir):
    """Observed values against the simulated trajectory, interpolated at the observed times."""
    o = observed(spark, sf_dir).select("node", (F.col("t") + 0.1).alias("t"), F.col("d").alias("seen"))
    sim_ = base_run(spark, sf_dir).select("node", "t", F.col("d").alias("x"))
    both = M.interpolate(sim_, o.select("node", "t"), "node").join(o, ["node", "t"])
    return both.groupBy("node").agg(F.round(F.sqrt(F.avg((F.col("seen") - F.col("x")) ** 2)), 6).alias("rmse"))


@query(ctes(OBS) + ", wc AS (SELECT node, t, greatest(0, d - avg(d) OVER (PARTITION BY t)) AS w FROM obs) SELECT node, round(sum(w * t) / nullif(sum(w), 0), 6) AS centroid FROM wc GROUP BY 1")
def temporal_centroid(spark, sf_dir):
    s = observed(spark, sf_dir).select("node", F.col("t").alias("tp"), F.col("t").alias("hours"), F.col("d").alias("s"))
    return M.temporal_centroid(s, "node").select("node", r6("centroid"))


# ---- matrices

FLUX = "fd AS (SELECT a.run_id, a.t_idx, a.t, a.node AS i, b.node AS j, p.beta * a.d * e.w * b.h AS flux FROM traj a JOIN rates p ON p.node = a.node JOIN edges e ON e.i = a.node JOIN traj b ON b.node = e.j AND b.t_idx = a.t_idx)"
TENSOR = "ft AS (SELECT t_idx, t, x.macro AS a, y.macro AS b, sum(flux) AS flux FROM fd JOIN comps x ON x.node = i JOIN comps y ON y.node = j GROUP BY 1, 2, 3, 4)"
KDYN = ", ".join([FLUX, TENSOR, trapz("flux", "ft", "a, b", "kd")])


def _labels(spark, sf_dir):
    return compartments(spark, sf_dir).select("node", F.col("macro").alias("label"))


def _k(spark, sf_dir):
    return X.next_generation(base_run(spark, sf_dir).cache(), trade_graph(spark, sf_dir), rates(spark, sf_dir), _labels(spark, sf_dir))


@query(ctes(BASE, KDYN) + "SELECT a, b, round(k, 6) AS k FROM kd")
def k_dyn(spark, sf_dir):
    return _k(spark, sf_dir).select("a", "b", r6("k"))


@query(ctes(BASE, KDYN) + f"SELECT a, {', '.join(f'''round(coalesce(sum(k) FILTER (WHERE b = '{m}'), 0), 6) AS {m}''' for m in dims.MACROS)} FROM kd GROUP BY 1")
def k_dyn_pivot(spark, sf_dir):
    p = X.pivoted(_k(spark, sf_dir), list(dims.MACROS))
    return p.select("a", *[r6(m) for m in dims.MACROS])


KSTRUCT = "ks AS (SELECT x.macro AS a, y.macro AS b, sum(p.beta / p.rho * w) AS k FROM edges JOIN rates p ON p.node = i JOIN comps x ON x.node = i JOIN comps y ON y.node = j GROUP BY 1, 2)"


@query(ctes(COMPS, EDGES, DIMS, RATES, KSTRUCT) + "SELECT a, b, round(k, 6) AS k FROM ks")
def k_struct(spark, sf_dir):
    return X.structural(trade_graph(spark, sf_dir), rates(spark, sf_dir), _labels(spark, sf_dir)).select("a", "b", r6("k"))


@query(ctes(COMPS, EDGES, DIMS, RATES, KSTRUCT) + "SELECT a, b, round(k / sum(k) OVER (PARTITION BY a), 6) AS k_norm FROM ks")
def k_norm(spark, sf_dir):
    return X.structural(trade_graph(spark, sf_dir), rates(spark, sf_dir), _labels(spark, sf_dir)).select("a", "b", r6("k_norm"))


@query(ctes(BASE, KDYN) + "SELECT label, round(s, 6) AS source, round(t, 6) AS sink, round(s - t, 6) AS net FROM (SELECT a AS label, sum(k) AS s FROM kd GROUP BY 1) JOIN (SELECT b AS label, sum(k) AS t FROM kd GROUP BY 1) USING (label)")
def source_sink(spark, sf_dir):
    return X.source_sink(_k(spark, sf_dir)).select("label", r6("source"), r6("sink"), r6("net"))


@query(ctes(BASE, KDYN) + "SELECT a AS label, round(coalesce(sum(k) FILTER (WHERE a = b), 0) / sum(k), 6) AS retention, round(1 - coalesce(sum(k) FILTER (WHERE a = b), 0) / sum(k), 6) AS dispersal FROM kd GROUP BY 1")
def retention_dispersal(spark, sf_dir):
    return X.retention(_k(spark, sf_dir)).select("label", r6("retention"), r6("dispersal"))


@query(ctes(BASE) + "SELECT t_idx, round(sum(CASE WHEN tot > 0 THEN -s / tot * ln(greatest(s / tot, 1e-15)) ELSE 0 END), 6) AS h FROM (SELECT t_idx, macro, sum(d) AS s, sum(sum(d)) OVER (PARTITION BY t_idx) AS tot FROM traj JOIN comps USING (node) GROUP BY 1, 2) GROUP BY 1")
def invasion_entropy(spark, sf_dir):
    return X.entropy(base_run(spark, sf_dir), _labels(spark, sf_dir)).select("t_idx", r6("h"))


@query(ctes(BASE) + ", co AS (SELECT node, CAST(node % 5 AS DOUBLE) AS x, CAST(node // 5 AS DOUBLE) AS y FROM comps), seed AS (SELECT first(node ORDER BY d DESC, node) AS node FROM traj WHERE t_idx = 0), sc AS (SELECT x AS sx, y AS sy FROM co JOIN seed USING (node)) SELECT t_idx, round(coalesce(sum(d * sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy))) / nullif(sum(d), 0), 0), 6) AS dist FROM traj JOIN co USING (node), sc GROUP BY 1")
def propagation_distance(spark, sf_dir):
    return X.propagation_distance(base_run(spark, sf_dir).cache(), _coords(spark, sf_dir)).select("t_idx", r6("dist"))


@query(ctes(BASE, FLUX, TENSOR) + "SELECT t_idx, a, b, round(flux, 6) AS flux FROM ft")
def flux_tensor(spark, sf_dir):
    d = X.flux_density(base_run(spark, sf_dir).cache(), trade_graph(spark, sf_dir), rates(spark, sf_dir))
    return X.flux_tensor(d, _labels(spark, sf_dir)).select("t_idx", "a", "b", r6("flux"))


EFLUX = ", ".join([FLUX, trapz("flux", "fd", "i, j", "ek")])


@query(ctes(BASE, EFLUX) + "SELECT i, j, round(w, 6) AS w, round(k, 6) AS flux, CASE WHEN x.macro = y.macro THEN 'intra' ELSE 'inter' END AS edge_type FROM ek JOIN edges USING (i, j) JOIN comps x ON x.node = i JOIN comps y ON y.node = j ORDER BY round(k, 9) DESC, i, j LIMIT 25")
def edge_flux_top25(spark, sf_dir):
    e = X.edge_flux(base_run(spark, sf_dir).cache(), trade_graph(spark, sf_dir), rates(spark, sf_dir), compartments(spark, sf_dir))
    return e.orderBy(F.desc(F.round("flux", 9)), "i", "j").limit(25).select("i", "j", r6("w"), r6("flux"), "edge_type")


@query(ctes(BASE, EFLUX) + "SELECT CASE WHEN x.macro = y.macro THEN 'intra' ELSE 'inter' END AS edge_type, count(*) AS n, round(sum(k), 6) AS flux FROM ek JOIN comps x ON x.node = i JOIN comps y ON y.node = j GROUP BY 1")
def edge_flux_split(spark, sf_dir):
    e = X.edge_flux(base_run(spark, sf_dir).cache(), trade_graph(spark, sf_dir), rates(spark, sf_dir), compartments(spark, sf_dir))
    return e.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("flux"), 6).alias("flux"))


@query(ctes(BASE) + f", rf AS (SELECT a.t, a.node AS i, b.node AS j, p.beta * a.h * e.w * b.d AS flux FROM traj a JOIN rates p ON p.node = a.node JOIN edges e ON e.i = a.node JOIN traj b ON b.node = e.j AND b.t_idx = a.t_idx), {trapz('flux', 'rf', 'i, j', 'rk')} SELECT least(x.macro, y.macro) AS a, greatest(x.macro, y.macro) AS b, round(sum(k), 6) AS k FROM rk JOIN comps x ON x.node = i JOIN comps y ON y.node = j WHERE x.macro <> y.macro GROUP BY 1, 2")
def interlayer_flux(spark, sf_dir):
    return X.receiver_flux(base_run(spark, sf_dir).cache(), trade_graph(spark, sf_dir), rates(spark, sf_dir), compartments(spark, sf_dir)).select("a", "b", r6("k"))
