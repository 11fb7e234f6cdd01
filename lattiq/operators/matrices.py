"""Matrices between groups of compartments, as long tables (a, b, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flux_density(traj: DataFrame, edges: DataFrame, rates: DataFrame) -> DataFrame:
    """run_id, t_idx, t, i, j, flux = beta_i w_ij d_i h_j of each directed edge at each time: the source's beta."""
    src = traj.join(rates.select("node", "beta"), "node").select("run_id", "t_idx", "t", F.col("node").alias("i"), (F.col("beta") * F.col("d")).alias("push"))
    dst = traj.select("run_id", "t_idx", F.col("node").alias("j"), "h")
    return src.join(edges.select("i", "j", "w"), "i").join(dst, ["run_id", "t_idx", "j"]).select("run_id", "t_idx", "t", "i", "j", (F.col("push") * F.col("w") * F.col("h")).alias("flux"))


def flux_tensor(density: DataFrame, labels: DataFrame) -> DataFrame:
    """run_id, t_idx, t, a, b, flux: flux between groups at each time. labels has node, label."""
    g = labels.select(F.col("node").alias("i"), F.col("label").alias("a"))
    h = labels.select(F.col("node").alias("j"), F.col("label").alias("b"))
    return density.join(g, "i").join(h, "j").groupBy("run_id", "t_idx", "t", "a", "b").agg(F.sum("flux").alias("flux"))


def integrated(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Integral over t by the trapezoidal rule."""
    w = Window.partitionBy("run_id", *by).orderBy("t")
    strip = (F.col("t") - F.lag("t").over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    return rows.withColumn("_s", strip).groupBy("run_id", *by).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("k"))


def next_generation(traj: DataFrame, edges: DataFrame, rates: DataFrame, labels: DataFrame) -> DataFrame:
    """run_id, a, b, k: the dynamic next-generation matrix between groups."""
    return integrated(flux_tensor(flux_density(traj, edges, rates), labels), "flux", "a", "b")


def structural(edges: DataFrame, rates: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, k, k_norm: sums of (beta_i / rho_i) w_ij between groups, and with rows scaled to 1 (rows of zero stay)."""
    r = rates.select(F.col("node").alias("i"), (F.col("beta") / F.col("rho")).alias("q"))
    g = labels.select(F.col("node").alias("i"), F.col("label").alias("a"))
    h = labels.select(F.col("node").alias("j"), F.col("label").alias("b"))
    k = edges.join(r, "i").join(g, "i").join(h, "j").groupBy("a", "b").agg(F.sum(F.col("q") * F.col("w")).alias("k"))
    total = F.sum("k").over(Window.partitionBy("a"))
    return k.select("a", "b", "k", F.when(total > 0, F.col("k") / total).otherwise(0.0).alias("k_norm"))


def source_sink(k: DataFrame) -> DataFrame:
    """label, source (row sum), sink (column sum), net."""
    rows, cols = k.groupBy(F.col("a").alias("label")).agg(F.sum("k").alias("s")), k.groupBy(F.col("b").alias("label")).agg(F.sum("k").alias("t"))
    out = rows.join(cols, "label", "full_outer").select("label", F.coalesce("s", F.lit(0.0)).alias("source"), F.coalesce("t", F.lit(0.0)).alias("sink"))
    return out.withColumn("net", F.col("source") - F.col("sink"))


def retention(k: DataFrame) -> DataFrame:
    """label, retention (diagonal over row sum, 0 for an empty row), dispersal (1 minus that, 0 for an empty row)."""
    g = k.groupBy(F.col("a").alias("label")).agg(F.sum("k").alias("s"), F.sum(F.when(F.col("a") == F.col("b"), F.col("k")).otherwise(0.0)).alias("own"))
    return g.select("label", F.when(F.col("s") > 0, F.col("own") / F.col("s")).otherwise(0.0).alias("retention"), F.when(F.col("s") > 0, 1 - F.col("own") / F.col("s")).otherwise(0.0).alias("dispersal"))


def entropy(traj: DataFrame, labels: DataFrame) -> DataFrame:
    """run_id, t_idx, t, h: natural-log entropy of d over groups at each time, 0 where there is none."""
    g = traj.join(labels, "node").groupBy("run_id", "t_idx", "t", "label").agg(F.sum("d").alias("s"))
    total = F.sum("s").over(Window.partitionBy("run_id", "t_idx"))
    p = g.select("run_id", "t_idx", "t", F.when(total > 0, F.col("s") / total).otherwise(0.0).alias("p"), total.alias("total"))
    return p.groupBy("run_id", "t_idx", "t").agg(F.sum(F.when(F.col("total") > 0, -F.col("p") * F.log(F.greatest(F.col("p"), F.lit(1e-15)))).otherwise(0.0)).alias("h"))


def propagation_distance(traj: DataFrame, coords: DataFrame) -> DataFrame:
    """run_id, t_idx, t, dist: mean distance from the seed node (largest d at the start, smallest node on ties), weighted by d."""
    seed = traj.where("t_idx = 0").groupBy("run_id").agg(F.max_by("node", F.struct(F.col("d"), -F.col("node"))).alias("node")).join(coords, "node").select("run_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    rows = traj.join(coords, "node").join(seed, "run_id")
    d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    return rows.groupBy("run_id", "t_idx", "t").agg(F.coalesce(F.try_divide(F.sum(F.col("d") * d), F.sum("d")), F.lit(0.0)).alias("dist"))


def edge_flux(traj: DataFrame, edges: DataFrame, rates: DataFrame, comps: DataFrame) -> DataFrame:
    """run_id, i, j, w, flux (integrated), edge_type intra or inter."""
    k = integrated(flux_density(traj, edges, rates), "flux", "i", "j").join(edges, ["i", "j"])
    a, b = comps.select(F.col("node").alias("i"), F.col("macro").alias("ma")), comps.select(F.col("node").alias("j"), F.col("macro").alias("mb"))
    kind = F.when(F.col("ma") == F.col("mb"), "intra").otherwise("inter").alias("edge_type")
    return k.join(a, "i").join(b, "j").select("run_id", "i", "j", "ma", "mb", "w", F.col("k").alias("flux"), kind)


def receiver_flux(traj: DataFrame, edges: DataFrame, rates: DataFrame, comps: DataFrame) -> DataFrame:
    """run_id, a, b, k: integrated beta_i h_i w_ij d_j between layers, the receiver's beta, both directions of a pair together."""
    dst = traj.join(rates.select("node", "beta"), "node").select("run_id", "t_idx", "t", F.col("node").alias("i"), (F.col("beta") * F.col("h")).alias("pull"))
    src = traj.select("run_id", "t_idx", F.col("node").alias("j"), "d")
    flow = dst.join(edges.where("w > 0"), "i").join(src, ["run_id", "t_idx", "j"]).select("run_id", "t", "i", "j", (F.col("pull") * F.col("w") * F.col("d")).alias("flux"))
    k = integrated(flow, "flux", "i", "j")
    a, b = comps.select(F.col("node").alias("i"), F.col("macro").alias("ma")), comps.select(F.col("node").alias("j"), F.col("macro").alias("mb"))
    k = k.join(a, "i").join(b, "j").where("ma <> mb")
    return k.groupBy("run_id", F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).agg(F.sum("k").alias("k"))


def pivoted(k: DataFrame, labels: list[str], value: str = "k") -> DataFrame:
    """One row a label with a column for each label, 0 where a pair is absent."""
    return k.groupBy("a").pivot("b", labels).agg(F.sum(value)).na.fill(0.0)
