"""Queries of sweeps, sensitivity, controls, scenarios and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import r6
from ..operators import design as N
from ..operators import dynamics as D
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import params as P
from ..operators import stats as S
from ..session import cut
from ..sources.testdata import compartments, table, trade_graph
from .catalog import BASE, BASE_PRE, COMPS, CROSS, DIMS, EDGES, OUTPUTS, RATES, adj, ctes, drug_sim, query, seeded, sim, values
from .dynamics_queries import DRUG_DIMS, DRUG_RATES, _drug_design, _k, layered_parts, rates
from .graph_queries import labelled

SPAN, STEP = 30.0, 60
OUT = ("global_r", "peak_d", "t_peak", "auc_d", "mean_inv_time", "frac_invaded")
OUT_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in OUT)


def _runs(spark, sf_dir, design, t_end=SPAN, steps=STEP):
    """Outputs of a design of multipliers on the trade graph."""
    c = P.with_multipliers(rates(spark, sf_dir), design.select("run_id", "mult"))
    return D.simulate(D.seeded(c), G.adjacency(trade_graph(spark, sf_dir), "sym"), t_end, steps)


def _outputs(spark, sf_dir, traj):
    return M.run_outputs(traj.cache(), compartments(spark, sf_dir))


def _mult(get: str) -> str:
    """CTE mrates of rates scaled by each run; get(p) is SQL for the run's multiplier of p, from a CTE dsg(run_id, param, m)."""
    g = lambda p: f"coalesce((SELECT m FROM dsg q WHERE q.run_id = d.run_id AND q.param = {p}), 1)"
    named = "CASE WHEN macro IN ('PT', 'DCT', 'TAL', 'vascular') THEN {} ELSE 1 END"
    zone = "CASE WHEN region IN ('outer_medulla', 'boundary') THEN {} WHEN region = 'inner_medulla' THEN {} ELSE 1 END"
    q1 = lambda p: "'" + p + "'"
    sc = lambda p: f"{named.format(g(q1(p + '_') + ' || macro'))} * {zone.format(g(q1(p + '_mult_outer')), g(q1(p + '_mult_inner')))}"
    return f"mrates AS (SELECT d.run_id, node, comp, macro, region, is_boundary, beta * {sc('beta')} AS beta, rho * {sc('gamma')} AS rho, d_h * {g(q1('D_S_global'))} AS d_h, d_d * {g(q1('D_I_global'))} AS d_d FROM rates, (SELECT DISTINCT run_id FROM dsg) d)"


MRUN = ", ".join([_mult(""), adj(), seeded(run="run_id", source="mrates"), sim(SPAN, STEP), OUTPUTS])
PRE = ", ".join([COMPS, EDGES, DIMS, RATES])
OAT_DIM = values([(k, *v) for k, v in dims.SWEEP.items()], "sw", "param, lo, hi")
OAT = f"oat AS (SELECT param || '#' || k AS run_id, param, lo + (hi - lo) * k / 6 AS m FROM sw, range(7) t(k)), dsg AS (SELECT run_id, param, m FROM oat)"


@query(ctes(PRE, OAT_DIM, OAT, MRUN) + f"SELECT param, round(m, 6) AS multiplier, {OUT_SQL} FROM outs JOIN oat USING (run_id)")
def oat_grid(spark, sf_dir):
    d = N.one_at_a_time(spark)
    return _outputs(spark, sf_dir, _runs(spark, sf_dir, d)).join(d, "run_id").select("param", r6("multiplier"), *[r6(c) for c in OUT])


@query(ctes(PRE, OAT_DIM, OAT, MRUN) + "SELECT param, round(min(auc_d), 6) AS low, round(max(auc_d), 6) AS high, round(max(auc_d) - min(auc_d), 6) AS span, round(avg(auc_d) FILTER (WHERE m BETWEEN 0.95 AND 1.05), 6) AS nominal FROM outs JOIN oat USING (run_id) GROUP BY 1 HAVING count(*) >= 2 ORDER BY round(max(auc_d) - min(auc_d), 9) DESC, param LIMIT 12")
def tornado(spark, sf_dir):
    d = N.one_at_a_time(spark)
    rows = _outputs(spark, sf_dir, _runs(spark, sf_dir, d)).join(d, "run_id")
    return N.tornado(rows, "auc_d").select("param", r6("low"), r6("high"), r6("span"), r6("nominal"))


GRID = "gd AS (SELECT 'g' || i || '_' || j AS run_id, CAST(0.7 AS DOUBLE) + CAST(1.3 AS DOUBLE) * i / 11 AS va, CAST(0.6 AS DOUBLE) + CAST(1.2 AS DOUBLE) * j / 11 AS vb FROM range(12) a(i), range(12) b(j)), dsg AS (SELECT run_id, 'gamma_mult_outer' AS param, va AS m FROM gd UNION ALL SELECT run_id, 'beta_DCT', vb FROM gd)"


def _grid(spark):
    return N.grid(spark, "gamma_mult_outer", "beta_DCT")


@query(ctes(PRE, GRID, MRUN) + f"SELECT round(va, 6) AS va, round(vb, 6) AS vb, {OUT_SQL} FROM outs JOIN gd USING (run_id)")
def grid2d(spark, sf_dir):
    d = _grid(spark)
    return _outputs(spark, sf_dir, _runs(spark, sf_dir, d)).join(d, "run_id").select(r6("va"), r6("vb"), *[r6(c) for c in OUT])


@query(ctes(PRE, GRID, MRUN) + "SELECT 'optimal' AS kind, round(first(va ORDER BY round(global_r, 9), va, vb), 6) AS va, round(first(vb ORDER BY round(global_r, 9), va, vb), 6) AS vb FROM outs JOIN gd USING (run_id) UNION ALL SELECT 'nominal', round(first(va ORDER BY abs(va - 1) + abs(vb - 1), va, vb), 6), round(first(vb ORDER BY abs(va - 1) + abs(vb - 1), va, vb), 6) FROM gd UNION ALL SELECT 'corner', round(max(va), 6), round(min(vb), 6) FROM gd")
def grid2d_lookups(spark, sf_dir):
    """The cell of the least final recovered share, the one nearest to no change, and the fixed corner."""
    d = _grid(spark)
    o = _outputs(spark, sf_dir, _runs(spark, sf_dir, d)).join(d, "run_id")
    best = o.agg(F.min_by(F.struct("va", "vb"), F.struct(F.round("global_r", 9), "va", "vb")).alias("p")).select(F.lit("optimal").alias("kind"), "p.va", "p.vb")
    near = d.agg(F.min_by(F.struct("va", "vb"), F.struct(F.abs(F.col("va") - 1) + F.abs(F.col("vb") - 1), "va", "vb")).alias("p")).select(F.lit("nominal").alias("kind"), "p.va", "p.vb")
    corner = d.agg(F.max("va").alias("va"), F.min("vb").alias("vb")).select(F.lit("corner").alias("kind"), "va", "vb")
    return best.unionByName(near).unionByName(corner).select("kind", r6("va"), r6("vb"))


#: Multipliers of the variance-based indices.
SOBOL = ("beta_PT", "beta_DCT", "beta_TAL", "beta_vascular", "gamma_PT", "gamma_DCT", "gamma_TAL", "D_S_global", "D_I_global")
KNOBS = ("beta_PT", "gamma_PT", "D_I_global", "beta_mult_outer")


def _part_design(spark, sf_dir):
    """A fixed design from the whole part table: a run a size, multipliers from its size, rows and keys."""
    p = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("q"))
    size = F.col("p_size").cast("double")
    vals = [0.6 + (size % 10) / 10, 0.6 + (F.col("n") * 7 % 11) / 11.0, 0.3 + (F.col("q") % 13) / 13.0 * 2.7, 0.8 + (size * 3 % 8) / 10]
    return p.select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("run_id"), F.create_map(*[x for k, v in zip(KNOBS, vals) for x in (F.lit(k), v)]).alias("mult"))


PART = "pt AS (SELECT 'p' || p_size AS run_id, CAST(p_size AS DOUBLE) AS s, count(*) AS n, sum(p_partkey) AS q FROM part GROUP BY p_size), dsg AS (SELECT run_id, 'beta_PT' AS param, 0.6 + (s % 10) / 10 AS m FROM pt UNION ALL SELECT run_id, 'gamma_PT', 0.6 + (n * 7 % 11) / CAST(11 AS DOUBLE) FROM pt UNION ALL SELECT run_id, 'D_I_global', 0.3 + (q % 13) / CAST(13 AS DOUBLE) * 2.7 FROM pt UNION ALL SELECT run_id, 'beta_mult_outer', 0.8 + (s * 3 % 8) / 10 FROM pt)"


def _part_outputs(spark, sf_dir):
    d = _part_design(spark, sf_dir)
    return d, _outputs(spark, sf_dir, _runs(spark, sf_dir, d))


@query(ctes(PRE, PART, MRUN) + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.95), 6) AS p95, round(stddev_samp({c}), 6) AS sd, count({c}) AS n FROM outs" for c in OUT))
def mc_summary(spark, sf_dir):
    _, o = _part_outputs(spark, sf_dir)
    return S.summary(o, *OUT).select("metric", r6("mean"), r6("p05"), r6("p95"), r6("sd"), "n")


@query(ctes(PRE, PART, MRUN) + """, rk AS (SELECT param, rank() OVER (PARTITION BY param ORDER BY m) + (count(*) OVER (PARTITION BY param, m) - 1) / 2.0 AS a, rank() OVER (PARTITION BY param ORDER BY g) + (count(*) OVER (PARTITION BY param, g) - 1) / 2.0 AS b FROM (SELECT param, m, round(global_r, 9) AS g FROM dsg JOIN outs USING (run_id)))
SELECT param, round(corr(a, b), 6) AS rho, count(*) AS n FROM rk GROUP BY 1""")
def spearman_indices(spark, sf_dir):
    d, o = _part_outputs(spark, sf_dir)
    rows = N.long_multipliers(d).join(o.select("run_id", F.round("global_r", 9).alias("g")), "run_id")
    return S.spearman(rows, "multiplier", "g", "param").select("param", r6("rho"), "n")


@query(ctes(PRE, PART, _mult(""), adj(), seeded(run="run_id", source="mrates"), sim(SPAN, STEP), CROSS) + ", ps AS (SELECT node, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(t_cross, 1e300), node) AS position FROM crossed) SELECT node, CAST(position AS INTEGER) AS position, count(*) AS n FROM ps GROUP BY 1, 2")
def rank_stability(spark, sf_dir):
    """How often each compartment takes each place in the order of invasion."""
    t = M.crossing_time(_runs(spark, sf_dir, _part_design(spark, sf_dir)))
    return S.rank_frequencies(t, "run_id", "node", "t_cross")


@query(ctes(PRE, PART, _mult("")) + "SELECT run_id, node, round(beta, 6) AS beta, round(rho, 6) AS rho, round(d_h, 6) AS d_h, round(d_d, 6) AS d_d FROM mrates")
def apply_multipliers(spark, sf_dir):
    return P.with_multipliers(rates(spark, sf_dir), _part_design(spark, sf_dir)).select("run_id", "node", r6("beta"), r6("rho"), r6("d_h"), r6("d_d"))


MORRIS = [("t0s0", 0, 0, None, None), ("t0s1", 0, 1, "beta_PT", 1.6), ("t0s2", 0, 2, "gamma_PT", 0.6), ("t0s3", 0, 3, "D_I_global", 2.1), ("t1s0", 1, 0, None, None), ("t1s1", 1, 1, "gamma_PT", 1.6), ("t1s2", 1, 2, "D_I_global", 0.3), ("t1s3", 1, 3, "beta_PT", 0.6)]
START = [{"beta_PT": 0.9, "gamma_PT": 1.2, "D_I_global": 0.3}, {"beta_PT": 1.2, "gamma_PT": 0.9, "D_I_global": 2.1}]


def _morris_rows():
    rows, now = [], {}
    for run, t, step, param, value in MORRIS:
        now = dict(START[t]) if step == 0 else {**now, param: value}
        rows.append((run, t, step, param, value, dict(now)))
    return rows


MORRIS_SQL = ", ".join([
    values([(r[0], k, v) for r in _morris_rows() for k, v in r[5].items()], "dsg", "run_id, param, m"),
    values([(r[0], r[1], r[2], r[3], r[4], next(x[5] for x in _morris_rows() if x[1] == r[1] and x[2] == r[2] - 1)[r[3]], f"t{r[1]}s{r[2] - 1}") for r in _morris_rows() if r[3]], "mv", "run_id, traj, step, param, v1, v0, was"),
])


@query(ctes(PRE, MORRIS_SQL, MRUN) + ", ee AS (SELECT param, (a.auc_d - b.auc_d) / (v1 - v0) AS e FROM mv JOIN outs a ON a.run_id = mv.run_id JOIN outs b ON b.run_id = mv.was) SELECT param, round(avg(abs(e)), 6) AS mu_star, round(stddev_pop(e), 6) AS sigma, round(avg(e), 6) AS mu, count(*) AS n_ee FROM ee GROUP BY 1")
def morris_effects(spark, sf_dir):
    """Elementary effects over two fixed trajectories."""
    d = spark.createDataFrame(_morris_rows(), "run_id string, traj int, step int, param string, value double, mult map<string,double>")
    return N.elementary_effects(d, _outputs(spark, sf_dir, _runs(spark, sf_dir, d)), "auc_d").select("param", r6("mu_star"), r6("sigma"), r6("mu"), "n_ee")


@query()
def morris_screening(spark, sf_dir):
    """Seeded random trajectories over all parameters."""
    d = N.morris(spark, 15)
    return N.elementary_effects(d, _outputs(spark, sf_dir, _runs(spark, sf_dir, d)), "auc_d").select("param", r6("mu_star"), r6("sigma"), r6("mu"), "n_ee")


@query()
def monte_carlo_sweep(spark, sf_dir):
    d = N.monte_carlo(spark, 300)
    return S.summary(_outputs(spark, sf_dir, _runs(spark, sf_dir, d)), *OUT).select("metric", r6("mean"), r6("p05"), r6("p95"), r6("sd"), "n")


@query()
def sobol_sensitivity(spark, sf_dir):
    """Nine multipliers from 0.6 to 1.4, 256 base points, 2,816 runs."""
    d = N.saltelli(spark, 256, {k: (0.6, 1.4) for k in SOBOL})
    return N.sobol_intervals(d, _outputs(spark, sf_dir, _runs(spark, sf_dir, d)), "auc_d").select("param", r6("s1"), r6("st"), r6("s1_conf"), r6("st_conf"))


def _surface(x: str, z: str):
    return F.col(x) * F.col(x) + F.col(x) * F.col(z) + F.col(z)


@query("""WITH a AS (SELECT c_custkey AS base, c_acctbal / 10000 AS a1, c_nationkey / 25 AS a2 FROM customer),
p AS (SELECT x.base, x.a1, x.a2, y.a1 AS b1, y.a2 AS b2 FROM a x JOIN a y ON y.base = x.base + 1),
e AS (SELECT base, a1 * a1 + a1 * a2 + a2 AS ya, b1 * b1 + b1 * b2 + b2 AS yb, b1 * b1 + b1 * a2 + a2 AS y1, a1 * a1 + a1 * b2 + b2 AS y2 FROM p),
k AS (SELECT base, ya, yb, y1 AS y, 'x1' AS param FROM e UNION ALL SELECT base, ya, yb, y2, 'x2' FROM e),
v AS (SELECT var_pop(y) AS var FROM (SELECT ya AS y FROM e UNION ALL SELECT yb FROM e)),
s AS (SELECT param, avg(yb * (y - ya)) / any_value(var) AS s1, avg((ya - y) ** 2) / 2 / any_value(var) AS st FROM k, v GROUP BY 1),
u AS (SELECT base, b, CAST('0x' || substr(md5('0:' || base || ':' || b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM e, range(20) t(b)),
c AS (SELECT k, sum(exp(-1) / gamma(j + 1)) AS upto FROM range(9) t(k), range(9) r(j) WHERE j <= k GROUP BY 1),
w AS (SELECT base, b, count(k) AS w FROM u LEFT JOIN c ON u >= upto GROUP BY 1, 2),
vb AS (SELECT b, sum(w * (ya * ya + yb * yb)) / sum(2 * w) - (sum(w * (ya + yb)) / sum(2 * w)) ** 2 AS var FROM e JOIN w USING (base) GROUP BY 1),
r AS (SELECT param, b, sum(w * yb * (y - ya)) / sum(w) / any_value(var) AS s1, sum(w * (ya - y) ** 2) / 2 / sum(w) / any_value(var) AS st FROM k JOIN w USING (base) JOIN vb USING (b) GROUP BY 1, 2)
SELECT s.param, round(s.s1, 6) AS s1, round(s.st, 6) AS st, round(i.s1, 6) AS s1_conf, round(i.st, 6) AS st_conf FROM s JOIN (SELECT param, 1.96 * stddev_samp(s1) AS s1, 1.96 * stddev_samp(st) AS st FROM r GROUP BY 1) i USING (param)""")
def sobol_intervals(spark, sf_dir):
    """Indices and bootstrap intervals of a known surface over a design taken from the customers: each one's place is A,
    the next one's is B, so that SQL can follow every draw."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("base"), (F.col("c_acctbal") / 10000).alias("a1"), (F.col("c_nationkey") / 25).alias("a2"))
    p = a.join(a.select((F.col("base") - 1).alias("base"), F.col("a1").alias("b1"), F.col("a2").alias("b2")), "base")
    kinds = (("A", "a1", "a2"), ("B", "b1", "b2"), ("x1", "b1", "a2"), ("x2", "a1", "b2"))
    runs = p.select("base", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _surface(x, z).alias("y")) for k, x, z in kinds])).alias("r")).select("base", "r.kind", "r.y")
    runs = cut(runs.withColumn("run_id", F.concat_ws("#", "base", "kind")), "runs")
    return N.sobol_intervals(runs.select("run_id", "base", "kind"), runs.select("run_id", "y"), "y", 20).select("param", r6("s1"), r6("st"), r6("s1_conf"), r6("st_conf"))


@query()
def sobol_rank_stability(spark, sf_dir):
    """How far the order of the compartments by peak holds over the 2,816 runs of the Sobol design."""
    d = N.saltelli(spark, 256, {k: (0.6, 1.4) for k in SOBOL}).select("run_id", "mult")
    base = spark.createDataFrame([("base", {})], d.schema)
    peaks = cut(_runs(spark, sf_dir, d.unionByName(base)).groupBy("run_id", "node").agg(F.max("d").alias("peak")), "peaks")
    return N.rank_stability(peaks, "base").select(r6("mean"), r6("sd"), r6("p05"), r6("p95"), "n")


# ---- scenarios and controls: each is a set of runs with its own rates, seeds or graph


def _scenario(spark, sf_dir, par, adjacency=None):
    a = G.adjacency(trade_graph(spark, sf_dir), "sym") if adjacency is None else adjacency
    return _outputs(spark, sf_dir, D.simulate(par, a, SPAN, STEP)).select("run_id", *[r6(c) for c in OUT])


def _scen_sql(pre: str, par: str, a: str | None = None) -> str:
    return ctes(PRE, pre, a or adj(), par, sim(SPAN, STEP), OUTPUTS) + f"SELECT run_id, {OUT_SQL} FROM outs"


@query(_scen_sql("u AS (SELECT node, comp, macro, region, is_boundary, avg(beta) OVER () AS beta, avg(rho) OVER () AS rho, avg(d_h) OVER () AS d_h, avg(d_d) OVER () AS d_d FROM rates), bth AS (SELECT 'base' AS run_id, * FROM (SELECT node, comp, macro, region, is_boundary, beta, rho, d_h, d_d FROM rates) UNION ALL SELECT 'uniform', * FROM u)", seeded(run="run_id", source="bth")))
def uniform_params(spark, sf_dir):
    """All rates at their means against the plain run."""
    c = rates(spark, sf_dir)
    every = Window.partitionBy()
    u = c.select("node", "comp", "macro", "region", "is_boundary", *[F.avg(x).over(every).alias(x) for x in ("beta", "rho", "d_h", "d_d")])
    both = c.withColumn("run_id", F.lit("base")).unionByName(u.withColumn("run_id", F.lit("uniform")))
    return _scenario(spark, sf_dir, D.seeded(both))


RHO = [(f"rho{m}", m) for m in (0.5, 0.75, 1.0, 1.25, 1.5)]


@query(_scen_sql(values(RHO, "rm2", "run_id, m") + ", rs AS (SELECT run_id, node, is_boundary, beta, rho * m AS rho, d_h, d_d FROM rates, rm2)", seeded(run="run_id", source="rs")))
def rho_sensitivity(spark, sf_dir):
    m = spark.createDataFrame(RHO, "run_id string, m double")
    return _scenario(spark, sf_dir, D.seeded(F.broadcast(rates(spark, sf_dir)).crossJoin(m).withColumn("rho", F.col("rho") * F.col("m"))))


SEEDS = {
    "boundary": "is_boundary",
    "cortex": "region = 'cortex'",
    "inner": "region IN ('inner_medulla', 'core')",
    "pt_outer": "macro = 'PT' AND region IN ('outer_medulla', 'boundary')",
    "vascular": "macro = 'vascular'",
    "single": "node = 0",
}
SEED_SQL = "CASE run_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEEDS.items()) + " END"


def _seeded_runs(spark, c):
    runs = spark.createDataFrame([(k,) for k in SEEDS], "run_id string")
    hit = F.expr(SEED_SQL)
    both = F.broadcast(c).crossJoin(runs)  # a row a compartment
    some = both.where(hit).select("run_id").distinct()  # seeds that no compartment meets are left out
    return D.seeded(both.join(some, "run_id", "left_semi"), 0.05, hit)


@query(_scen_sql(values([(k,) for k in SEEDS], "sr", "run_id") + f", sx0 AS (SELECT * FROM rates, sr), sx AS (SELECT * FROM sx0 WHERE run_id IN (SELECT run_id FROM sx0 WHERE {SEED_SQL}))", seeded(where=SEED_SQL, run="run_id", source="sx")))
def alt_seeds(spark, sf_dir):
    return _scenario(spark, sf_dir, _seeded_runs(spark, rates(spark, sf_dir)))


@query(ctes(PRE, values([(k,) for k in SEEDS], "sr", "run_id"), f"sx0 AS (SELECT * FROM rates, sr), sx AS (SELECT * FROM sx0 WHERE run_id IN (SELECT run_id FROM sx0 WHERE {SEED_SQL}))", adj(), seeded(where=SEED_SQL, run="run_id", source="sx"), sim(SPAN, STEP), CROSS) + """, cr AS (SELECT run_id, node, rank() OVER (PARTITION BY run_id ORDER BY t_cross NULLS LAST) AS k FROM crossed)
SELECT a.run_id, round(corr(ra, rb), 6) AS rho FROM (SELECT c.run_id, c.node, rank() OVER w1 + (count(*) OVER (PARTITION BY c.run_id, c.k) - 1) / 2.0 AS ra, rank() OVER w2 + (count(*) OVER (PARTITION BY c.run_id, b.k) - 1) / 2.0 AS rb FROM cr c JOIN cr b ON b.node = c.node AND b.run_id = 'boundary' WHERE c.run_id <> 'boundary' WINDOW w1 AS (PARTITION BY c.run_id ORDER BY c.k), w2 AS (PARTITION BY c.run_id ORDER BY b.k)) a GROUP BY 1""")
def seed_order_spearman(spark, sf_dir):
    """Order of invasion of each seeding against the boundary's, nulls at the bottom."""
    t = M.crossing_time(D.simulate(_seeded_runs(spark, rates(spark, sf_dir)), G.adjacency(trade_graph(spark, sf_dir), "sym"), SPAN, STEP))
    k = t.select("run_id", "node", F.rank().over(Window.partitionBy("run_id").orderBy(F.asc_nulls_last("t_cross"))).alias("k")).cache()
    base = k.where("run_id = 'boundary'").select("node", F.col("k").alias("kb"))
    return S.spearman(k.where("run_id <> 'boundary'").join(base, "node"), "k", "kb", "run_id").select("run_id", r6("rho"))


ABL = "el AS (SELECT i, j, w, CASE WHEN a.macro = b.macro THEN 'intra_' || a.macro ELSE 'inter_' || least(a.macro, b.macro) || '_' || greatest(a.macro, b.macro) END AS cls FROM edges JOIN comps a ON a.node = i JOIN comps b ON b.node = j), gx AS (SELECT DISTINCT cls AS gid FROM el UNION ALL SELECT 'none'), gedges AS (SELECT gid, i, j, w FROM el, gx WHERE cls <> gid)"


def _ablations(spark, sf_dir):
    c = compartments(spark, sf_dir)
    e = cut(trade_graph(spark, sf_dir), "edges").join(c.select(F.col("node").alias("i"), F.col("macro").alias("a")), "i").join(c.select(F.col("node").alias("j"), F.col("macro").alias("b")), "j").select("i", "j", "w", G.edge_class("a", "b").alias("cls")).cache()
    ids = e.select(F.col("cls").alias("graph_id")).distinct().unionByName(spark.createDataFrame([("none",)], "graph_id string"))
    return ids, e.join(F.broadcast(ids), F.col("cls") != F.col("graph_id")).select("graph_id", "i", "j", "w")


def per_graph(edges, convention="sym"):
    """adjacency() of many graphs at once: graph_id and node together are the key."""
    key = edges.select(F.struct(F.col("graph_id").alias("g"), F.col("i").alias("n")).alias("i"), F.struct(F.col("graph_id").alias("g"), F.col("j").alias("n")).alias("j"), "w")
    return G.adjacency(key, convention).select(F.col("i.g").alias("graph_id"), F.col("i.n").alias("i"), F.col("j.n").alias("j"), "wt", "l")


@query(ctes(PRE, ABL, adj("sym", "gedges", by="gid"), "gr AS (SELECT * FROM rates, gx)", seeded(run="gid", g="gid", source="gr"), sim(SPAN, STEP), OUTPUTS) + f", bs AS (SELECT mean_inv_time AS t0, peak_d AS p0 FROM outs WHERE run_id = 'none') SELECT run_id, round(mean_inv_time - t0, 6) AS delta_tinv, round(peak_d - p0, 6) AS delta_peak, round(frac_invaded, 6) AS frac_invaded FROM outs, bs WHERE run_id <> 'none'")
def edge_ablation_class(spark, sf_dir):
    """Each class of edges removed in turn."""
    ids, e = _ablations(spark, sf_dir)
    c = F.broadcast(rates(spark, sf_dir)).crossJoin(ids).withColumn("run_id", F.col("graph_id"))
    o = _outputs(spark, sf_dir, D.simulate(D.seeded(c), per_graph(e), SPAN, STEP)).cache()
    base = o.where("run_id = 'none'").select(F.col("mean_inv_time").alias("t0"), F.col("peak_d").alias("p0"))
    return o.where("run_id <> 'none'").crossJoin(F.broadcast(base)).select("run_id", F.round(F.col("mean_inv_time") - F.col("t0"), 6).alias("delta_tinv"), F.round(F.col("peak_d") - F.col("p0"), 6).alias("delta_peak"), r6("frac_invaded"))


@query(ctes(PRE, "vedges AS (SELECT i, j, w FROM edges JOIN comps a ON a.node = i JOIN comps b ON b.node = j WHERE a.macro <> 'vascular' AND b.macro <> 'vascular')", adj("sym", "vedges"), seeded(), sim(SPAN, STEP), OUTPUTS) + f"SELECT run_id, {OUT_SQL} FROM outs")
def edge_removal_vascular(spark, sf_dir):
    """Without edges that touch a vascular compartment; those compartments stay, without exchange."""
    v = compartments(spark, sf_dir).where("macro = 'vascular'").select(F.col("node").alias("i"))
    e = trade_graph(spark, sf_dir).join(v, "i", "left_anti").join(v.withColumnRenamed("i", "j"), "j", "left_anti")
    return _scenario(spark, sf_dir, D.seeded(rates(spark, sf_dir)).withColumn("run_id", F.lit("base")), G.adjacency(e.select("i", "j", "w"), "sym"))


DI = [(f"d{x}", x) for x in dims.D_INTER]


@query(ctes(PRE, "ledges AS (SELECT e.i, e.j, e.w FROM edges e JOIN comps a ON a.node = e.i JOIN comps b ON b.node = e.j WHERE a.macro = b.macro AND a.macro IN ('PT', 'DCT', 'TAL'))", adj("sym", "ledges").replace("adj AS (", "adj0 AS ("), values(DI, "di", "run_id, d_inter"),
    "adj AS (SELECT di.run_id AS g, i, j, wt, l FROM adj0, di UNION ALL SELECT di.run_id, e.i, e.j, d_inter * e.w * sqrt(a.d_d * b.d_d), 0 FROM edges e JOIN rates a ON a.node = e.i JOIN rates b ON b.node = e.j, di WHERE a.macro <> b.macro AND a.macro IN ('PT', 'DCT', 'TAL') AND b.macro IN ('PT', 'DCT', 'TAL'))",
    "lr AS (SELECT * FROM rates, di WHERE macro IN ('PT', 'DCT', 'TAL'))", seeded(seed=0.1, run="run_id", g="run_id", source="lr"), sim(SPAN, STEP, bounded=True), OUTPUTS) + f"SELECT run_id, {OUT_SQL} FROM outs")
def d_inter_sweep(spark, sf_dir):
    """The layered model over six couplings."""
    c, own, inter = layered_parts(spark, sf_dir)
    runs = spark.createDataFrame([(g, x) for g, x in DI], "graph_id string, d_inter double")  # a row a coupling
    a = own.crossJoin(F.broadcast(runs)).select("graph_id", "i", "j", "wt", "l")
    a = a.unionByName(inter.crossJoin(F.broadcast(runs)).select("graph_id", "i", "j", (F.col("d_inter") * F.col("u")).alias("wt"), F.lit(0.0).alias("l")))
    par = D.seeded(c.crossJoin(F.broadcast(runs.select("graph_id"))).withColumn("run_id", F.col("graph_id")), 0.1)
    return _outputs(spark, sf_dir, D.simulate(par, a, SPAN, STEP, bounded=True)).select("run_id", *[r6(x) for x in OUT])


SWEEP_T = [(f"s{k}", "bolus", 15.0 * k / 19) for k in range(20)]


@query(ctes(BASE_PRE, DRUG_DIMS, DRUG_RATES, values(SWEEP_T, "ds", "run_id, mode, t_dose"), "drun AS (SELECT * FROM drug, ds)", seeded(seed=0.1, run="run_id", source="drun", extra=", delta, rho2, d_f, mode, t_dose"), drug_sim(20.0, 80)) + """, fe AS (SELECT run_id, avg(x / (h + d + d2 + r + x)) AS x, avg(r / (h + d + d2 + r + x)) AS r FROM traj WHERE t_idx = 80 GROUP BY 1)
SELECT run_id, round(t_dose, 6) AS t_dose, round(x, 6) AS mean_x, round(r, 6) AS mean_r, row_number() OVER (ORDER BY round(x, 9), t_dose) = 1 AS least_dead, row_number() OVER (ORDER BY round(r, 9) DESC, t_dose) = 1 AS most_recovered FROM fe JOIN ds USING (run_id)""")
def dose_sweep_best(spark, sf_dir):
    """When to dose: the fewest dead and the most recovered, the first on ties."""
    d = spark.createDataFrame([(r, m, t) for r, m, t in SWEEP_T], "run_id string, dose_mode string, t_dose double").withColumn("dose", F.lit(1.0))
    par = F.broadcast(D.seeded(P.drug_rates(rates(spark, sf_dir)), 0.1)).crossJoin(d)
    t = D.simulate_drug(par, G.adjacency(trade_graph(spark, sf_dir), "sym"), 20.0, 80)
    end = D.finals(t, ("h", "d", "d2", "r", "x")).groupBy("run_id").agg(F.avg("x").alias("x"), F.avg("r").alias("r")).join(d, "run_id")
    return end.select("run_id", r6("t_dose"), F.round("x", 6).alias("mean_x"), F.round("r", 6).alias("mean_r"), (F.row_number().over(Window.orderBy(F.round("x", 9), "t_dose")) == 1).alias("least_dead"), (F.row_number().over(Window.orderBy(F.desc(F.round("r", 9)), "t_dose")) == 1).alias("most_recovered"))


@query(ctes(BASE_PRE, DRUG_DIMS, DRUG_RATES, "ds AS (SELECT * FROM (VALUES ('bolus', CAST(8 AS DOUBLE)), ('none', CAST(1e6 AS DOUBLE))) t(mode, t_dose))", "drun AS (SELECT * FROM drug, ds)", seeded(seed=0.1, run="mode", source="drun", extra=", delta, rho2, d_f, mode, t_dose"), drug_sim(20.0, 80)) + "SELECT a.node, round(greatest(0, b.x - a.x), 6) AS x_averted, round(a.r - b.r, 6) AS gain_r, round(greatest(0, least(1, a.d + a.x)), 6) AS load FROM traj a JOIN traj b USING (node, t_idx) WHERE a.run_id = 'bolus' AND b.run_id = 'none' AND t_idx = 80")
def drug_vs_no_drug(spark, sf_dir):
    """Deaths averted and recovery gained at the end, with the lesion load under the drug."""
    par = _drug_design(spark, sf_dir, [("bolus", 8.0), ("none", 1e6)])
    end = D.simulate_drug(par, G.adjacency(trade_graph(spark, sf_dir), "sym"), 20.0, 80).where("t_idx = 80").cache()
    a = end.where("run_id = 'bolus'").select("node", "d", "r", "x")
    b = end.where("run_id = 'none'").select("node", F.col("r").alias("rn"), F.col("x").alias("xn"))
    return a.join(b, "node").select("node", F.round(F.greatest(F.lit(0.0), F.col("xn") - F.col("x")), 6).alias("x_averted"), F.round(F.col("r") - F.col("rn"), 6).alias("gain_r"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d") + F.col("x"))), 6).alias("load"))


@query()
def rewired_null(spark, sf_dir):
    """Degree-preserving rewirings of the whole graph, 20 of 50 swaps: order of invasion by macro type against the plain graph."""
    e = cut(trade_graph(spark, sf_dir), "edges")
    w = N.rewire(e, 20, 50).unionByName(e.select(F.lit("base").alias("graph_id"), "i", "j", "w"))
    ids = spark.createDataFrame([(f"rw{k}",) for k in range(20)] + [("base",)], "graph_id string")
    c = D.seeded(F.broadcast(rates(spark, sf_dir)).crossJoin(ids).withColumn("run_id", F.col("graph_id")))
    t = M.crossing_time(D.simulate(c, per_graph(w), SPAN, STEP)).join(compartments(spark, sf_dir).select("node", "macro"), "node")
    m = t.groupBy("run_id", "macro").agg(F.avg("t_cross").alias("t")).where("t is not null").cache()
    base = m.where("run_id = 'base'").select("macro", F.col("t").alias("t0"))
    return S.spearman(m.where("run_id <> 'base'").join(base, "macro"), "t", "t0", "run_id").select("run_id", r6("rho"), "n")


@query()
def random_seeds(spark, sf_dir):
    """Five random halves of the seeded set, by hash: mean invasion time and share."""
    runs = spark.range(5).select(F.concat(F.lit("seed"), F.col("id").cast("string")).alias("run_id"))
    c = F.broadcast(rates(spark, sf_dir)).crossJoin(runs)
    k = F.row_number().over(Window.partitionBy("run_id", "is_boundary").orderBy(F.xxhash64("run_id", "node"), "node"))
    n = F.count("*").over(Window.partitionBy("run_id", "is_boundary"))
    c = c.withColumn("_pick", F.col("is_boundary") & (k <= F.greatest(F.lit(1), F.floor(n / 2))))
    return _scenario(spark, sf_dir, D.seeded(c, 0.05, F.col("_pick")).drop("_pick"))


# ---- statistics

SUP = "sn2 AS (SELECT s_nationkey AS k, avg(s_acctbal) AS x FROM supplier GROUP BY 1), cn AS (SELECT c_nationkey AS k, avg(c_acctbal) AS y FROM customer GROUP BY 1), xy AS (SELECT k, x, y FROM sn2 JOIN cn USING (k))"


def _xy(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("x"))
    y = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("y"))
    return x.join(y, "k")


@query(ctes(SUP) + "SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 6) AS tau, count(*) AS pairs FROM xy a JOIN xy b ON a.k < b.k")
def kendall_tau(spark, sf_dir):
    return S.kendall(_xy(spark, sf_dir), "x", "y").select(r6("tau"), "pairs")


@query("""WITH k AS (SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT (SELECT sum(n) * (sum(n) - 1) / 2 FROM k) AS p, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM k GROUP BY x)) AS tx, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM k GROUP BY y)) AS ty)
SELECT round((c - d) / sqrt((p - tx) * (p - ty)), 6) AS tau, CAST(p AS BIGINT) AS pairs FROM (SELECT sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) > 0 THEN a.n * b.n ELSE 0 END) / 2 AS c, sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) < 0 THEN a.n * b.n ELSE 0 END) / 2 AS d, any_value(t.p) AS p, any_value(t.tx) AS tx, any_value(t.ty) AS ty FROM k a, k b, t)""")
def kendall_tau_lines(spark, sf_dir):
    """Tau-b of quantity and discount over all order lines: ties everywhere, no pairs of rows."""
    return S.kendall(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount").select(r6("tau"), "pairs")


@query(ctes(SUP) + ", pp AS (SELECT o.k AS o, rank() OVER (PARTITION BY o.k ORDER BY a.x) + (count(*) OVER (PARTITION BY o.k, a.x) - 1) / 2.0 AS p, rank() OVER (PARTITION BY o.k ORDER BY a.y) + (count(*) OVER (PARTITION BY o.k, a.y) - 1) / 2.0 AS q FROM xy a JOIN xy o ON a.k <> o.k), cc AS (SELECT o, corr(p, q) AS r FROM pp GROUP BY 1) SELECT round(min(r), 6) AS lowest, round(max(r), 6) AS highest FROM cc")
def loo_spearman_range(spark, sf_dir):
    return S.leave_one_out(_xy(spark, sf_dir), "x", "y", "k").select(r6("lowest"), r6("highest"))


@query("""WITH s AS (SELECT CAST(l_discount >= 0.05 AS DOUBLE) AS y, l_quantity + l_linenumber AS s FROM lineitem), r AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s),
c AS (SELECT s, sum(y) AS tp, count(*) AS m FROM s GROUP BY 1), p AS (SELECT tp, sum(tp) OVER w / sum(m) OVER w AS prec FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auroc, round((SELECT sum(tp * prec) FROM p) / sum(y), 6) AS auprc FROM r""")
def auroc_auprc(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_discount") >= 0.05).alias("y"), (F.col("l_quantity") + F.col("l_linenumber")).alias("s"))
    return S.auroc_auprc(l, "y", "s").select(r6("auroc"), r6("auprc"))


BENCH = "SELECT p_type AS factor, p_brand AS level, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS sd, count(*) AS n FROM part GROUP BY 1, 2"


@query(BENCH)
def benchmark_aggregate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_type").alias("factor"), F.col("p_brand").alias("level")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.count("*").alias("n"))


@query("""WITH z AS (SELECT (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS f0, (length(p_name) - avg(length(p_name)) OVER ()) / stddev_samp(length(p_name)) OVER () AS f1, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () - (p_partkey % 17 - avg(p_partkey % 17) OVER ()) / stddev_samp(p_partkey % 17) OVER () AS y FROM part),
m AS (SELECT sum(f0 * f0) AS aa, sum(f1 * f1) AS bb, sum(f0 * f1) AS ab, sum(f0 * y) AS ay, sum(f1 * y) AS by_, sum(y * y) AS yy FROM z),
r AS (SELECT yy - (ay * (ay * bb - by_ * ab) + by_ * (by_ * aa - ay * ab)) / (aa * bb - ab * ab) AS full_, yy - by_ * by_ / bb AS no0, yy - ay * ay / aa AS no1 FROM m),
s AS (SELECT (no0 - full_) / no0 AS p0, (no1 - full_) / no1 AS p1 FROM r)
SELECT 'size' AS factor, round(p0, 6) AS partial_r2, round(p0 / (p0 + p1), 4) AS share FROM s UNION ALL SELECT 'name', round(p1, 6), round(p1 / (p0 + p1), 4) FROM s""")
def variance_decomposition(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), F.length("p_name").cast("double").alias("name"), "p_retailprice", (F.col("p_partkey") % 17).cast("double").alias("k"))
    return S.loss_shares(p, {"p_retailprice": 1.0, "k": -1.0}, ["size", "name"]).select("factor", r6("partial_r2"), F.round("share", 4).alias("share"))


@query(ctes(PRE, "ks AS (SELECT x.macro AS a, y.macro AS b, sum(p.beta / p.rho * w) AS k FROM edges JOIN rates p ON p.node = i JOIN comps x ON x.node = i JOIN comps y ON y.node = j WHERE x.macro IN ('PT', 'DCT', 'TAL') AND y.macro IN ('PT', 'DCT', 'TAL') GROUP BY 1, 2), kw AS (SELECT x.macro AS a, y.macro AS b, round(sum(w * w), 9) AS k FROM edges JOIN comps x ON x.node = i JOIN comps y ON y.node = j WHERE x.macro IN ('PT', 'DCT', 'TAL') AND y.macro IN ('PT', 'DCT', 'TAL') GROUP BY 1, 2)",
    "ls(n, l) AS (VALUES (0, 'PT'), (1, 'DCT'), (2, 'TAL'))", "pm AS (SELECT a.l AS p0, b.l AS p1, c.l AS p2, row_number() OVER (ORDER BY a.n, b.n, c.n) - 1 AS perm FROM ls a JOIN ls b ON b.n <> a.n JOIN ls c ON c.n NOT IN (a.n, b.n))",
    "mp AS (SELECT perm, 'PT' AS l, p0 AS t FROM pm UNION ALL SELECT perm, 'DCT', p1 FROM pm UNION ALL SELECT perm, 'TAL', p2 FROM pm)",
    "jj AS (SELECT x.perm, ks.k AS u, kw.k AS v FROM kw JOIN mp x ON x.l = kw.a JOIN mp y ON y.l = kw.b AND y.perm = x.perm JOIN ks ON ks.a = x.t AND ks.b = y.t WHERE kw.a <> kw.b)",
    "rr2 AS (SELECT perm, rank() OVER (PARTITION BY perm ORDER BY u) + (count(*) OVER (PARTITION BY perm, u) - 1) / 2.0 AS p, rank() OVER (PARTITION BY perm ORDER BY v) + (count(*) OVER (PARTITION BY perm, v) - 1) / 2.0 AS q FROM jj)", "cr2 AS (SELECT perm, corr(p, q) AS r FROM rr2 GROUP BY 1)") + "SELECT round(max(r) FILTER (WHERE perm = 0), 6) AS rho, round(avg(CASE WHEN r >= (SELECT r FROM cr2 WHERE perm = 0) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p, count(*) AS n_perm FROM cr2")
def qap_exact(spark, sf_dir):
    from ..operators import matrices as X

    c = compartments(spark, sf_dir).where(F.col("macro").isin(*dims.LAYERS))
    lab = c.select("node", F.col("macro").alias("label"))
    a = X.structural(trade_graph(spark, sf_dir), rates(spark, sf_dir), lab).select("a", "b", "k")
    e = trade_graph(spark, sf_dir).join(lab.select(F.col("node").alias("i"), F.col("label").alias("a")), "i").join(lab.select(F.col("node").alias("j"), F.col("label").alias("b")), "j")
    return S.qap(a, e.groupBy("a", "b").agg(F.round(F.sum(F.col("w") * F.col("w")), 9).alias("k")), list(dims.LAYERS)).select(r6("rho"), r6("p"), "n_perm")


@query(ctes(SUP) + ", d AS (SELECT x - y AS d FROM xy WHERE x <> y), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d), g AS (SELECT least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, count(*) AS n FROM r) SELECT round(w, 6) AS w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z, n FROM g")
def wilcoxon_signed(spark, sf_dir):
    return S.wilcoxon(_xy(spark, sf_dir), "x", "y").select(r6("w"), r6("z"), "n")


@query()
def permutation_spearman(spark, sf_dir):
    """A two-sided permutation test a region."""
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    return S.permutation_spearman(_xy(spark, sf_dir).join(r, "k"), "x", "y", "n_regionkey", permutations=200_000).select("n_regionkey", r6("rho"), r6("p"), "n")
