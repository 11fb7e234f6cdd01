"""Tables that joined reports and figures need."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import r6
from ..operators import dynamics as D
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import stats as S
from ..sources.testdata import compartments, observed, trade_graph
from .catalog import BASE, BASE_PRE, COMPS, CROSS, DIMS, FINALS, GRAPH, RATES, ctes, drug_sim, query, seeded, values
from .dynamics_queries import DRUG_DIMS, DRUG_RATES, INVASION, LAYER_RUN, OBS, _drug_design, base_run, layer_run, layered_parts, rates
from .graph_queries import labelled, spot_graph

SINGLE = "round(beta, 6) AS beta, round(rho, 6) AS rho, round(beta / rho, 6) AS r_diff, round(max_d, 6) AS peak_d, round(t_peak, 6) AS t_peak, round(auc_d, 6) AS auc_d, round(invasion_time, 6) AS t_cross, round(attack_rate, 6) AS r_end"


def _single(spark, sf_dir):
    return M.invasion_metrics(base_run(spark, sf_dir)).join(rates(spark, sf_dir), "node")


@query(ctes(BASE, INVASION) + f"SELECT node, comp, macro, region, is_boundary AS seeded, {SINGLE} FROM inv JOIN rates USING (node)")
def single_layer_table(spark, sf_dir):
    """A row a compartment: its rates and every metric of the plain run."""
    ratio = F.round(F.col("beta") / F.col("rho"), 6).alias("r_diff")
    return _single(spark, sf_dir).select("node", "comp", "macro", "region", F.col("is_boundary").alias("seeded"), r6("beta"), r6("rho"), ratio, F.round("max_d", 6).alias("peak_d"), r6("t_peak"), r6("auc_d"), F.round("invasion_time", 6).alias("t_cross"), F.round("attack_rate", 6).alias("r_end"))


@query(ctes(BASE, INVASION) + "SELECT region, count(*) AS n, round(avg(max_d), 6) AS peak_d, round(avg(t_peak), 6) AS t_peak, round(avg(auc_d), 6) AS auc_d, round(avg(invasion_time), 6) AS t_cross, round(avg(attack_rate), 6) AS r_end FROM inv JOIN rates USING (node) GROUP BY 1")
def single_layer_by_zone(spark, sf_dir):
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return _single(spark, sf_dir).groupBy("region").agg(F.count("*").alias("n"), mean("max_d", "peak_d"), mean("t_peak", "t_peak"), mean("auc_d", "auc_d"), mean("invasion_time", "t_cross"), mean("attack_rate", "r_end"))


@query(ctes(LAYER_RUN, FINALS) + ", ld AS (SELECT macro, avg(d) AS d, count(*) AS n FROM finals JOIN comps USING (node) GROUP BY 1), iw AS (SELECT x.macro AS ma, y.macro AS mb, sum(w) AS s FROM inter JOIN comps x ON x.node = i JOIN comps y ON y.node = j GROUP BY 1, 2) SELECT ma, mb, round(s / greatest(sqrt(a.n * b.n), 1) * abs(a.d - b.d), 6) AS flow FROM iw JOIN ld a ON a.macro = ma JOIN ld b ON b.macro = mb WHERE ma < mb")
def interlayer_flow(spark, sf_dir):
    """Coupling of each pair of layers times the difference of their final damage."""
    c, t = layer_run(spark, sf_dir)
    layer = D.finals(t).join(c.select("node", "macro"), "node").groupBy("macro").agg(F.avg("d").alias("d"), F.count("*").alias("n"))
    of = c.select("node", "macro")
    w = layered_parts(spark, sf_dir)[2].join(of.select(F.col("node").alias("i"), F.col("macro").alias("ma")), "i").join(of.select(F.col("node").alias("j"), F.col("macro").alias("mb")), "j")
    w = w.where("ma < mb").groupBy("ma", "mb").agg((0.05 * F.sum("u")).alias("s"))
    a, b = (layer.select(F.col("macro").alias(m), F.col("d").alias(f"d{m}"), F.col("n").alias(f"n{m}")) for m in ("ma", "mb"))
    flow = F.col("s") / F.greatest(F.sqrt(F.col("nma") * F.col("nmb")), F.lit(1.0)) * F.abs(F.col("dma") - F.col("dmb"))
    return w.join(a, "ma").join(b, "mb").select("ma", "mb", F.round(flow, 6).alias("flow"))


@query(ctes(BASE, CROSS, OBS) + """, wc AS (SELECT node, t, greatest(0, d - avg(d) OVER (PARTITION BY t)) AS w FROM obs), ce AS (SELECT node, sum(w * t) / nullif(sum(w), 0) AS c FROM wc GROUP BY 1),
mg AS (SELECT round(t_cross, 9) AS a, round(c, 9) AS b FROM crossed JOIN ce USING (node) WHERE t_cross IS NOT NULL AND c IS NOT NULL),
rk AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS p, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS q FROM mg)
SELECT round(corr(p, q), 6) AS rho, count(*) AS n FROM rk""")
def temporal_validation(spark, sf_dir):
    """Rank correlation of simulated activation times with the observed temporal centroids."""
    s = observed(spark, sf_dir).select("node", F.col("t").alias("tp"), F.col("t").alias("hours"), F.col("d").alias("s"))
    both = M.crossing_time(base_run(spark, sf_dir)).join(M.temporal_centroid(s, "node"), "node")
    return S.spearman(both.select(F.round("t_cross", 9).alias("a"), F.round("centroid", 9).alias("b")), "a", "b").select(r6("rho"), "n")


CURVES = [(f"t{x:g}", "bolus", x) for x in (2.0, 6.0, 10.0, 14.0)]


@query(ctes(BASE_PRE, DRUG_DIMS, DRUG_RATES, values(CURVES, "ds", "run_id, mode, t_dose"), "drun AS (SELECT * FROM drug, ds)", seeded(seed=0.1, run="run_id", source="drun", extra=", delta, rho2, d_f, mode, t_dose"), drug_sim(20.0, 80)) + "SELECT run_id, macro, t_idx, round(avg(d), 6) AS d, round(avg(x), 6) AS x, round(avg(f), 6) AS f FROM traj JOIN comps USING (node) GROUP BY 1, 2, 3")
def dose_time_curves(spark, sf_dir):
    """Mean damage, death and drug of each macro type over time, for several times of dosing."""
    d = spark.createDataFrame(CURVES, "run_id string, dose_mode string, t_dose double").withColumn("dose", F.lit(1.0))
    par = _drug_design(spark, sf_dir, [("bolus", 0.0)]).drop("run_id", "dose_mode", "t_dose", "dose").crossJoin(F.broadcast(d))
    t = D.simulate_drug(par, G.adjacency(trade_graph(spark, sf_dir), "sym"), 20.0, 80).join(compartments(spark, sf_dir).select("node", "macro"), "node")
    return t.groupBy("run_id", "macro", "t_idx").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("d", "x", "f")])


@query(ctes(LAYER_RUN) + "SELECT macro, t_idx, node, round(h, 6) AS h, round(d, 6) AS d, round(r, 6) AS r FROM traj JOIN comps USING (node) WHERE t_idx IN (0, 30, 60, 120)")
def multilayer_snapshots(spark, sf_dir):
    """States of every compartment in its layer at four times."""
    c, t = layer_run(spark, sf_dir)
    return t.where(F.col("t_idx").isin(0, 30, 60, 120)).join(c.select("node", "macro"), "node").select("macro", "t_idx", "node", r6("h"), r6("d"), r6("r"))


PLACES = dims.REGIONS


@query(ctes(COMPS, values(list(zip(PLACES, map(float, range(1, len(PLACES) + 1)))), "rg", "region, radius")) + ", pl AS (SELECT node, radius, 2 * pi() * (row_number() OVER (PARTITION BY region ORDER BY comp, node) - 1) / count(*) OVER (PARTITION BY region) AS angle FROM comps JOIN rg USING (region)) SELECT node, round(radius * cos(angle), 6) AS x, round(radius * sin(angle), 6) AS y FROM pl")
def radial_layout(spark, sf_dir):
    """Places of compartments for a drawing: a ring a region, evenly spaced by name."""
    ring = spark.createDataFrame([(k, float(n + 1)) for n, k in enumerate(PLACES)], "region string, radius double")
    by = Window.partitionBy("region")
    angle = 2 * math.pi * (F.row_number().over(by.orderBy("comp", "node")) - 1) / F.count("*").over(by)
    p = compartments(spark, sf_dir).join(F.broadcast(ring), "region").withColumn("angle", angle)
    return p.select("node", F.round(F.col("radius") * F.cos("angle"), 6).alias("x"), F.round(F.col("radius") * F.sin("angle"), 6).alias("y"))


VALS = "vals AS (SELECT macro, avg(d) AS d FROM traj JOIN comps USING (node) WHERE t_idx = 120 GROUP BY 1)"


@query(ctes(BASE, GRAPH, VALS) + "SELECT w.i, w.j, round(w * abs(va.d - vb.d), 6) AS flow, va.d >= vb.d AS forward FROM wsp w JOIN lab a ON a.i = w.i JOIN lab b ON b.i = w.j JOIN vals va ON va.macro = a.macro JOIN vals vb ON vb.macro = b.macro WHERE w.i < w.j")
def spot_transitions(spark, sf_dir):
    """Edges between spots, their weight times the difference of both ends' final damage, and its direction."""
    v = base_run(spark, sf_dir).where("t_idx = 120").join(compartments(spark, sf_dir).select("node", "macro"), "node").groupBy("macro").agg(F.avg("d").alias("d"))
    at = labelled(spark, sf_dir).select("spot", "macro").join(F.broadcast(v), "macro")  # a row a macro type
    e = spot_graph(spark, sf_dir).where("i < j").join(at.select(F.col("spot").alias("i"), F.col("d").alias("da")), "i").join(at.select(F.col("spot").alias("j"), F.col("d").alias("db")), "j")
    return e.select("i", "j", F.round(F.col("w") * F.abs(F.col("da") - F.col("db")), 6).alias("flow"), (F.col("da") >= F.col("db")).alias("forward"))


@query(ctes(BASE_PRE, DRUG_DIMS, DRUG_RATES, "ds AS (SELECT * FROM (VALUES ('bolus', CAST(8 AS DOUBLE)), ('none', CAST(1e6 AS DOUBLE))) t(mode, t_dose))", "drun AS (SELECT * FROM drug, ds)", seeded(seed=0.1, run="mode", source="drun", extra=", delta, rho2, d_f, mode, t_dose"), drug_sim(20.0, 80), GRAPH) + ", me AS (SELECT macro, avg(d) FILTER (WHERE run_id = 'bolus') AS d_drug, avg(x) FILTER (WHERE run_id = 'bolus') AS x_drug, avg(d) FILTER (WHERE run_id = 'none') AS d_none, avg(x) FILTER (WHERE run_id = 'none') AS x_none FROM traj JOIN comps USING (node) WHERE t_idx = 80 GROUP BY 1) SELECT spot, round(d_drug, 6) AS d_drug, round(x_drug, 6) AS x_drug, round(d_none, 6) AS d_none, round(x_none, 6) AS x_none FROM lab LEFT JOIN me USING (macro)")
def drug_spot_map(spark, sf_dir):
    """Final damage and death at every spot with and without the drug."""
    t = D.simulate_drug(_drug_design(spark, sf_dir, [("bolus", 8.0), ("none", 1e6)]), G.adjacency(trade_graph(spark, sf_dir), "sym"), 20.0, 80)
    end = t.where("t_idx = 80").join(compartments(spark, sf_dir).select("node", "macro"), "node")
    of = lambda c, run, name: F.avg(F.when(F.col("run_id") == run, F.col(c))).alias(name)
    m = end.groupBy("macro").agg(of("d", "bolus", "d_drug"), of("x", "bolus", "x_drug"), of("d", "none", "d_none"), of("x", "none", "x_none"))
    return M.to_spots(m, labelled(spark, sf_dir).select("spot", "macro"), "macro").select("spot", r6("d_drug"), r6("x_drug"), r6("d_none"), r6("x_none"))
