"""Further controls and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import design as N
from ..operators import dynamics as D
from ..operators import graph as G
from ..operators import matrices as X
from ..operators import metrics as M
from ..operators import params as P
from ..operators import stats as S
from ..session import cut
from ..sources.testdata import compartments, table, trade_graph
from .catalog import BASE, COMPS, CROSS, DIMS, EDGES, OUTER, OUTPUTS, adj, ctes, query, seeded, sim, values
from .design_queries import GRID, MRUN, OUT, OUT_SQL, PART, PRE, SEED_SQL, SEEDS, SPAN, STEP, _grid, _outputs, _part_outputs, _runs, _seeded_runs, per_graph
from .dynamics_queries import EFLUX, KDYN, base_run, rates
from .dynamics_queries import _k as k_matrix

SINGLE = "tp AS (SELECT i AS ei, j AS ej, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS gid FROM ek ORDER BY round(k, 9) DESC, i, j LIMIT 10), gx AS (SELECT gid, ei, ej FROM tp UNION ALL SELECT 'none', -1, -1), gedges AS (SELECT gid, i, j, w FROM edges, gx WHERE NOT (i = ei AND j = ej) AND NOT (i = ej AND j = ei))"


@query(
    ctes(BASE, EFLUX, SINGLE)
    + ", "
    + ", ".join([adj("sym", "gedges", by="gid").replace("dg AS", "dg2 AS").replace("JOIN dg a", "JOIN dg2 a").replace("JOIN dg b", "JOIN dg2 b").replace("sn AS", "sn2 AS").replace("FROM sn)", "FROM sn2)").replace("ad AS", "ad2 AS").replace("adj AS (SELECT * FROM ad UNION", "adj2 AS (SELECT * FROM ad2 UNION").replace("FROM dg)", "FROM dg2)"),
        "gr AS (SELECT * FROM rates, gx)",
        seeded(run="gid", g="gid", source="gr").replace("par AS", "par2 AS"),
        sim(SPAN, STEP).replace("it AS", "it2 AS").replace("FROM it a", "FROM it2 a").replace("JOIN it c", "JOIN it2 c").replace("FROM it)", "FROM it2)").replace("FROM par", "FROM par2").replace("JOIN par p", "JOIN par2 p").replace("JOIN adj e", "JOIN adj2 e").replace("traj AS", "traj2 AS"),
        "cr2 AS (SELECT run_id, avg(tc) AS mean_inv_time FROM (SELECT run_id, node, min(t) FILTER (WHERE d > 0.1) AS tc FROM traj2 GROUP BY 1, 2) GROUP BY 1)",
        "pk2 AS (SELECT run_id, max(d) AS peak_d FROM (SELECT run_id, t, avg(d) AS d FROM traj2 GROUP BY 1, 2) GROUP BY 1)"])
    + " SELECT a.run_id, round(a.mean_inv_time - b.mean_inv_time, 6) AS delta_tinv, round(p.peak_d - q.peak_d, 6) AS delta_peak FROM cr2 a JOIN pk2 p USING (run_id), cr2 b JOIN pk2 q USING (run_id) WHERE a.run_id <> 'none' AND b.run_id = 'none'"
)
def edge_ablation_single(spark, sf_dir):
    """The ten edges of the largest flux removed one at a time, both directions each."""
    e = cut(trade_graph(spark, sf_dir), "edges")
    flux = X.edge_flux(base_run(spark, sf_dir).cache(), e, rates(spark, sf_dir), compartments(spark, sf_dir))
    top = flux.orderBy(F.desc(F.round("flux", 9)), "i", "j").limit(10).select(F.col("i").alias("ei"), F.col("j").alias("ej"), F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string")).alias("graph_id"))
    ids = top.unionByName(spark.createDataFrame([(-1, -1, "none")], "ei long, ej long, graph_id string")).cache()
    cut_ = (F.col("i") == F.col("ei")) & (F.col("j") == F.col("ej")) | (F.col("i") == F.col("ej")) & (F.col("j") == F.col("ei"))
    left = e.join(F.broadcast(ids), ~cut_).select("graph_id", "i", "j", "w")
    c = D.seeded(F.broadcast(rates(spark, sf_dir)).crossJoin(ids.select("graph_id")).withColumn("run_id", F.col("graph_id")))
    o = _outputs(spark, sf_dir, D.simulate(c, per_graph(left), SPAN, STEP)).cache()
    base = o.where("run_id = 'none'").select(F.col("mean_inv_time").alias("t0"), F.col("peak_d").alias("p0"))
    return o.where("run_id <> 'none'").crossJoin(F.broadcast(base)).select("run_id", F.round(F.col("mean_inv_time") - F.col("t0"), 6).alias("delta_tinv"), F.round(F.col("peak_d") - F.col("p0"), 6).alias("delta_peak"))


VB = [round(0.6 + 1.2 * j / 11, 2) for j in range(12)]


@query(ctes(PRE, GRID, MRUN) + "SELECT round(va, 6) AS va, " + ", ".join(f"round(1 - max(global_r) FILTER (WHERE round(vb, 2) = {v}), 6) AS b{k}" for k, v in enumerate(VB)) + " FROM outs JOIN gd USING (run_id) GROUP BY va")
def sweep_damage_pivot(spark, sf_dir):
    """The damage proxy, one minus the final recovered share, as a grid."""
    d = _grid(spark)
    o = _outputs(spark, sf_dir, _runs(spark, sf_dir, d)).join(d, "run_id").withColumn("vb", F.round("vb", 2))
    p = o.groupBy("va").pivot("vb", VB).agg(F.max(1 - F.col("global_r")))
    return p.select(r6("va"), *[F.round(F.col(f"`{v}`"), 6).alias(f"b{k}") for k, v in enumerate(VB)])


@query(ctes(PRE, PART, MRUN) + "SELECT CAST(least(9, floor((auc_d - lo) / nullif((hi - lo) / 10, 0))) AS BIGINT) AS bin, count(*) AS n FROM outs, (SELECT min(auc_d) AS lo, max(auc_d) AS hi FROM outs) GROUP BY 1")
def mc_histogram(spark, sf_dir):
    _, o = _part_outputs(spark, sf_dir)
    every = Window.partitionBy()
    b = o.select("auc_d", F.min("auc_d").over(every).alias("lo"), F.max("auc_d").over(every).alias("hi"))
    return b.groupBy(F.least(F.lit(9), F.floor(F.try_divide(F.col("auc_d") - F.col("lo"), (F.col("hi") - F.col("lo")) / 10))).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query()
def spearman_with_p(spark, sf_dir):
    """Rank correlation of each knob with each output, with its p-value."""
    d, o = _part_outputs(spark, sf_dir)
    long = o.select("run_id", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in OUT]), F.array(*[F.round(c, 9) for c in OUT]))).alias("metric", "y"))
    rows = N.long_multipliers(d).join(long, "run_id")
    return S.spearman_test(rows, "multiplier", "y", "param", "metric").select("param", "metric", r6("rho"), r6("p"), "n")


@query(ctes(BASE, EFLUX) + ", pq AS (SELECT quantile_cont(k, 0.55) AS q FROM ek WHERE k > 0) SELECT i, j, round(k, 6) AS k FROM ek, pq WHERE k >= q")
def transition_edges(spark, sf_dir):
    """Directed edges whose integrated flux is at or above the 55th percentile of the positive ones."""
    k = X.integrated(X.flux_density(base_run(spark, sf_dir).cache(), trade_graph(spark, sf_dir), rates(spark, sf_dir)), "flux", "i", "j").cache()
    q = k.where("k > 0").agg(F.percentile("k", 0.55).alias("q"))
    return k.join(F.broadcast(q)).where("k >= q").select("i", "j", r6("k"))


@query(ctes(BASE, KDYN) + ", ss AS (SELECT label, s, t FROM (SELECT a AS label, sum(k) AS s FROM kd GROUP BY 1) JOIN (SELECT b AS label, sum(k) AS t FROM kd GROUP BY 1) USING (label)) SELECT label, round(s + t, 6) AS total, s + t >= (SELECT quantile_cont(s + t, 0.2) FROM ss) AS labelled FROM ss")
def source_sink_labels(spark, sf_dir):
    ss = X.source_sink(k_matrix(spark, sf_dir)).withColumn("total", F.col("source") + F.col("sink")).cache()
    q = ss.agg(F.percentile("total", 0.2).alias("q"))
    return ss.join(F.broadcast(q)).select("label", r6("total"), (F.col("total") >= F.col("q")).alias("labelled"))


@query(ctes(PRE, values([(k,) for k in SEEDS], "sr", "run_id"), f"sx0 AS (SELECT * FROM rates, sr), sx AS (SELECT * FROM sx0 WHERE run_id IN (SELECT run_id FROM sx0 WHERE {SEED_SQL}))", adj(), seeded(where=SEED_SQL, run="run_id", source="sx"), sim(SPAN, STEP), CROSS) + "SELECT run_id, round(avg(t_cross), 6) AS mean, round(stddev_samp(t_cross), 6) AS sd, round(avg(CASE WHEN t_cross IS NULL THEN 0.0 ELSE 1.0 END), 6) AS frac, first(node ORDER BY t_cross NULLS LAST, node) AS first_node, arg_max(node, struct_pack(t := round(t_cross, 9), n := -node)) FILTER (WHERE t_cross IS NOT NULL) AS last_node FROM crossed GROUP BY 1")
def seeding_summary(spark, sf_dir):
    """Each seeding's mean, spread and share of invasion times, with the first and the last compartment."""
    t = M.crossing_time(D.simulate(_seeded_runs(spark, rates(spark, sf_dir)), G.adjacency(trade_graph(spark, sf_dir), "sym"), SPAN, STEP))
    return t.groupBy("run_id").agg(
        F.round(F.avg("t_cross"), 6).alias("mean"),
        F.round(F.stddev_samp("t_cross"), 6).alias("sd"),
        F.round(F.avg(F.col("t_cross").isNotNull().cast("double")), 6).alias("frac"),
        F.min_by("node", F.struct(F.coalesce("t_cross", F.lit(float("inf"))), "node")).alias("first_node"),
        F.max_by("node", F.when(F.col("t_cross").isNotNull(), F.struct(F.round("t_cross", 9), -F.col("node")))).alias("last_node"),
    )


@query("""WITH g AS (SELECT event_type, user_id % 15 AS node, avg(value) AS m, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2),
a AS (SELECT node, m FROM g WHERE event_type = 'click'), b AS (SELECT node, m FROM g WHERE event_type = 'view'), c AS (SELECT node, m FROM g WHERE event_type = 'error')
SELECT a.node, round(a.m, 6) AS control, round(b.m, 6) AS treated, round(b.m - a.m, 6) AS effect, round(c.m, 6) AS other FROM a JOIN b USING (node) LEFT JOIN c USING (node)""")
def group_contrast(spark, sf_dir):
    """Control against treated group means by node, groups with at least two samples, a third group where it is known."""
    g = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 15).alias("node")).agg(F.avg("value").alias("m"), F.countDistinct("user_id").alias("users")).where("users >= 2")
    a, b, c = (g.where(F.col("event_type") == k).select("node", F.col("m").alias(n)) for k, n in (("click", "control"), ("view", "treated"), ("error", "other")))
    return a.join(b, "node").join(c, "node", "left").select("node", r6("control"), r6("treated"), F.round(F.col("treated") - F.col("control"), 6).alias("effect"), r6("other"))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY CUBE (lang, source)")
def group_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


#: Runs of the simplified model: a multiplier of recovery each.
SIMPLE = [("base", 1.0), ("uniform", 1.0), ("no_vascular", 1.0), ("cortex", 1.0), ("inner", 1.0), ("vascular", 1.0), ("rho0.5", 0.5), ("rho0.75", 0.75), ("rho1.25", 1.25), ("rho1.5", 1.5)]
SIMPLE_SEED = "CASE run_id WHEN 'cortex' THEN region = 'cortex' WHEN 'inner' THEN region IN ('inner_medulla', 'core') WHEN 'vascular' THEN macro = 'vascular' ELSE is_boundary END"


@query(
    ctes(
        COMPS, EDGES, DIMS, OUTER, values(SIMPLE, "sm", "run_id, m"),
        "gedges AS (SELECT 'whole' AS gid, i, j, w FROM edges UNION ALL SELECT 'cut', i, j, w FROM edges JOIN comps a ON a.node = i JOIN comps b ON b.node = j WHERE a.macro <> 'vascular' AND b.macro <> 'vascular')",
        adj("row", "gedges", by="gid"),
        "mu AS (SELECT avg(beta) AS mb, avg(rho) AS mr2, avg(d_d) AS md FROM rates)",
        "sr AS (SELECT run_id, CASE WHEN run_id = 'no_vascular' THEN 'cut' ELSE 'whole' END AS gid, node, macro, region, is_boundary, CASE WHEN run_id = 'uniform' THEN mb ELSE beta END AS beta, m * CASE WHEN run_id = 'uniform' THEN mr2 ELSE rho END AS rho, d_h, CASE WHEN run_id = 'uniform' THEN md ELSE d_d END AS d_d FROM rates, sm, mu)",
        seeded(where=SIMPLE_SEED, run="run_id", g="gid", source="sr"),
        sim(60.0, 240, True), OUTPUTS,
    )
    + f"SELECT run_id, {OUT_SQL} FROM outs"
)
def simplified_controls(spark, sf_dir):
    """Controls on the simplified model in one design: uniform rates, no vascular edges, other seeds, scaled recovery."""
    c = P.default_rates(compartments(spark, sf_dir), outer_only=True)
    mean = c.agg(F.avg("beta").alias("mb"), F.avg("rho").alias("mr"), F.avg("d_d").alias("md"))  # one row
    runs = spark.createDataFrame(SIMPLE, "run_id string, m double")
    even = F.col("run_id") == "uniform"
    c = c.crossJoin(F.broadcast(runs)).crossJoin(F.broadcast(mean))
    c = c.withColumn("beta", F.when(even, F.col("mb")).otherwise(F.col("beta"))).withColumn("rho", F.col("m") * F.when(even, F.col("mr")).otherwise(F.col("rho"))).withColumn("d_d", F.when(even, F.col("md")).otherwise(F.col("d_d")))
    c = c.withColumn("graph_id", F.when(F.col("run_id") == "no_vascular", "cut").otherwise("whole")).drop("m", "mb", "mr", "md")
    e = trade_graph(spark, sf_dir).select("i", "j", "w").cache()
    v = compartments(spark, sf_dir).where("macro = 'vascular'").select(F.col("node").alias("i"))
    less = e.join(v, "i", "left_anti").join(v.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "w")
    both = e.withColumn("graph_id", F.lit("whole")).unionByName(less.withColumn("graph_id", F.lit("cut")))
    traj = D.simulate(D.seeded(c, 0.05, F.expr(SIMPLE_SEED)), per_graph(both, "row"), 60.0, 240, conserve=True)
    return _outputs(spark, sf_dir, traj).select("run_id", *[r6(x) for x in OUT])


@query("""WITH e AS (SELECT event_type, user_id % 15 AS node, 2 * pi() * ((epoch_us(ts) / 1000000) % 86400) / 86400 AS a FROM events WHERE ts IS NOT NULL),
t AS (SELECT event_type, node, count(*) AS n, (sum(cos(a)) ** 2 + sum(sin(a)) ** 2) / count(*) AS z FROM e GROUP BY 1, 2 HAVING count(*) >= 10),
p AS (SELECT event_type, node, n, sqrt(z / n) AS r, exp(-z) AS p, count(*) OVER (PARTITION BY event_type) AS m, row_number() OVER (PARTITION BY event_type ORDER BY exp(-z)) AS k FROM t),
h AS (SELECT *, max(least(1, p * (m - k + 1))) OVER (PARTITION BY event_type ORDER BY k ROWS UNBOUNDED PRECEDING) AS holm FROM p)
SELECT event_type, node, n, round(r, 6) AS r, round(p, 6) AS p, m, round(least(1, p * m), 6) AS bonferroni, round(holm, 6) AS holm FROM h""")
def event_rhythm_tests(spark, sf_dir):
    """Whether each node's events keep to a time of day, a family of tests for each type of event, adjusted."""
    second = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) % 86400
    e = table(spark, sf_dir, "events").where("ts is not null").select("event_type", (F.col("user_id") % 15).alias("node"), (second / 86400).alias("phase"))
    t = S.adjusted(S.uniformity(e, "phase", "event_type", "node"), "p", "event_type")
    return t.select("event_type", "node", "n", r6("r"), r6("p"), "m", r6("bonferroni"), r6("holm"))
