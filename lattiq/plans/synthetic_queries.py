"""Queries over synthetic tissue, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import r6
from ..operators import annotate as A
from ..operators import benchmark as B
from ..operators import metrics as M
from ..operators import stats as S
from ..operators import synthetic as Y
from ..session import cut
from ..sources.testdata import trade_graph
from .catalog import BASE, COMPS, DIMS, GRAPH, RATES, ctes, query
from .dynamics_queries import base_run, rates
from .graph_queries import labelled


@query()
def synthetic_tissue(spark, sf_dir):
    return Y.whole_tissue(spark).select("spot", r6("x"), r6("y"), "zone", "type")


@query()
def nb_expression(spark, sf_dir):
    """Mean and variance of each gene's negative binomial counts over a whole tissue under its own spread."""
    e = Y.expression(Y.whole_tissue(spark), Y.spot_truth(spark).select("spot", F.col("d_seen").alias("d")))
    return e.groupBy("gene").agg(F.avg("count").alias("mean"), F.var_samp("count").alias("var")).select("gene", r6("mean"), r6("var"))


@query()
def error_injection(spark, sf_dir):
    """Share of wrong labels by type, for both ways of erring."""
    t = Y.whole_tissue(spark)
    both = Y.inject_errors(t, 0.2).withColumn("mode", F.lit("adjacent")).unionByName(Y.inject_errors(t, 0.2, mode="uniform").withColumn("mode", F.lit("uniform")))
    return both.groupBy("mode", "type").agg(F.round(F.avg((F.col("type") != F.col("noisy")).cast("double")), 6).alias("error"), F.count("*").alias("n"))


@query()
def blind_annotation(spark, sf_dir):
    """Types found from counts by their panel's profiles, against the truth."""
    t = Y.whole_tissue(spark)
    v = Y.expression(t, t.select("spot", F.lit(0.0).alias("d")), 0.1).select("spot", "gene", F.log1p("count").alias("value"))
    prof = spark.createDataFrame([(k, g, 1.0) for k, panel in B.TYPE_GENES.items() for g in panel], "type string, gene string, value double")
    found = Y.blind_types(v, prof).select("spot", F.col("type").alias("found"))
    return A.agreement(t.join(found, "spot"), "type", "found").select(r6("concordance"), r6("ari"), r6("nmi"))


@query()
def spot_level_truth(spark, sf_dir):
    """Spot-level spread on a whole tissue's own graph: first activation by zone."""
    return Y.spot_truth(spark).groupBy("zone").agg(F.round(F.avg("t_act"), 6).alias("mean_t"), F.count("t_act").alias("n"))


@query()
def benchmark_grid(spark, sf_dir):
    """All 880 runs: rising noise, and one misspecified factor at a time."""
    return B.aggregate(B.run(B.design(spark)), "factor", "level", "noise").select("factor", "level", "noise", "metric", r6("mean"), r6("sd"), "n")


@query()
def benchmark_shares(spark, sf_dir):
    """How much of the loss (error less spatial correlation) noise and misspecification explain, over a replicate of each run in ten."""
    rows = cut(B.run(B.design(spark, 5, 3)), "runs").na.drop(subset=["rmse_d", "r_spatial"])
    rows = rows.select("rmse_d", "r_spatial", "noise", *[F.when(F.col("factor") == f, F.abs("level")).otherwise(0.0).alias(f) for f in B.FACTORS])
    return S.loss_shares(rows, {"rmse_d": 1.0, "r_spatial": -1.0}, ["noise", *B.FACTORS]).select("factor", r6("partial_r2"), F.round("share", 4).alias("share"))


@query()
def diagnosis_grid(spark, sf_dir):
    """All 390 runs by whose labels are used, by how labels err, by how exposure is weighted."""
    rows = B.run(B.diagnosis(spark))
    return B.aggregate(rows, "block", "labels", "level", "error_mode", "exposure").select("block", "labels", "level", "error_mode", "exposure", "metric", r6("mean"), r6("sd"), "n")


@query(ctes(BASE, GRAPH, "vals AS (SELECT macro, avg(d) AS d FROM traj JOIN comps USING (node) WHERE t_idx = 120 GROUP BY 1)") + "SELECT spot, round(coalesce(d, 0), 6) AS d FROM lab LEFT JOIN vals USING (macro)")
def values_to_spots(spark, sf_dir):
    """Final values of macro types at every spot."""
    from ..sources.testdata import compartments

    v = base_run(spark, sf_dir).where("t_idx = 120").join(compartments(spark, sf_dir).select("node", "macro"), "node").groupBy("macro").agg(F.avg("d").alias("d"))
    return M.to_spots(v, labelled(spark, sf_dir).select("spot", "macro"), "macro").select("spot", F.round(F.coalesce("d", F.lit(0.0)), 6).alias("d"))


@query(ctes(BASE, GRAPH, "vals AS (SELECT macro, avg(d) AS d FROM traj JOIN comps USING (node) WHERE t_idx = 120 GROUP BY 1), g AS (SELECT vec_id AS spot, CAST(embedding[3] AS DOUBLE) AS g FROM embeddings)") + "SELECT spot, round(greatest(0, least(1, d * (1 + 0.25 * (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ())))), 6) AS d_spot FROM lab JOIN vals USING (macro) JOIN g USING (spot)")
def gene_refined_spots(spark, sf_dir):
    """Spot values refined by a stress gene's scaled expression."""
    from ..sources.testdata import compartments, table

    v = base_run(spark, sf_dir).where("t_idx = 120").join(compartments(spark, sf_dir).select("node", "macro"), "node").groupBy("macro").agg(F.avg("d").alias("d"))
    g = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spot"), F.col("embedding")[2].cast("double").alias("g"))
    s = M.to_spots(v, labelled(spark, sf_dir).select("spot", "macro"), "macro").join(g, "spot").where("d is not null")
    return M.refined(s, F.col("g")).select("spot", r6("d_spot"))


@query(ctes(BASE) + "SELECT round(quantile_cont(d, 0.01), 6) AS low, round(greatest(quantile_cont(d, 0.99), 1e-6), 6) AS high FROM traj WHERE t_idx = 120")
def colour_scale(spark, sf_dir):
    """The 1st and 99th percentiles that a map's colours span."""
    v = base_run(spark, sf_dir).where("t_idx = 120")
    return v.agg(F.round(F.percentile("d", 0.01), 6).alias("low"), F.round(F.greatest(F.percentile("d", 0.99), F.lit(1e-6)), 6).alias("high"))


@query(ctes(BASE) + "SELECT CAST(least(9, floor(d * 10)) AS BIGINT) AS bin, count(*) AS n FROM traj GROUP BY 1")
def damage_histogram(spark, sf_dir):
    return base_run(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("d") * 10)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(ctes(COMPS, DIMS, RATES) + "SELECT region, count(*) AS n, round(avg(beta), 4) AS beta, round(avg(rho), 4) AS rho, round(stddev_samp(beta / rho), 4) AS sd_r FROM rates GROUP BY ROLLUP (region)")
def zone_rollup(spark, sf_dir):
    r = rates(spark, sf_dir)
    return r.rollup("region").agg(F.count("*").alias("n"), F.round(F.avg("beta"), 4).alias("beta"), F.round(F.avg("rho"), 4).alias("rho"), F.round(F.stddev_samp(F.col("beta") / F.col("rho")), 4).alias("sd_r"))
