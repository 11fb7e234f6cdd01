"""Metrics of trajectories (run_id, t_idx, t, node, h, d, r) as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at_max, first_crossing, gradient, trapezoid
from ..functions.dims import DRUG_THRESHOLD, THRESHOLD


def crossing_time(traj: DataFrame, threshold: float = THRESHOLD, strict: bool = True) -> DataFrame:
    """run_id, node, t_cross: first time above the threshold, null if never."""
    return traj.groupBy("run_id", "node").agg(first_crossing("d", "t", threshold, strict).alias("t_cross"))


def invasion_metrics(traj: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """run_id, node and invasion_time, t_peak, auc_d, attack_rate, peak_velocity, max_d, final_d."""
    w = ("run_id", "node")
    rows = traj.select("run_id", "node", "t", "t_idx", "d", "r", trapezoid("d", "t", *w).alias("area"), gradient("d", "t", *w).alias("v"))
    return rows.groupBy(*w).agg(
        first_crossing("d", "t", threshold).alias("invasion_time"),
        at_max("t", "d", "t").alias("t_peak"),
        F.coalesce(F.sum("area"), F.lit(0.0)).alias("auc_d"),
        F.max_by("r", "t_idx").alias("attack_rate"),
        F.max("v").alias("peak_velocity"),
        F.max("d").alias("max_d"),
        F.max_by("d", "t_idx").alias("final_d"),
    )


def invasion_summary(metrics: DataFrame) -> DataFrame:
    """One row a run: compartments, invaded ones, mean and first invasion time, mean attack rate."""
    return metrics.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count("invasion_time").alias("n_invaded"),
        F.avg("invasion_time").alias("mean_invasion_time"),
        F.min("invasion_time").alias("first_invasion_time"),
        F.avg("attack_rate").alias("mean_attack_rate"),
    )


def state_summary(finals: DataFrame, comps: DataFrame, crossed: DataFrame) -> DataFrame:
    """Final means globally, by macro and by region in one pass (grouping sets): level, macro, region, mean_h, mean_d, mean_r, frac_invaded.

    crossed has node and t_cross.
    """
    rows = finals.join(comps.select("node", "macro", "region"), "node").join(crossed.select("node", "t_cross"), "node")
    g = rows.groupingSets([[], [F.col("macro")], [F.col("region")]], F.col("macro"), F.col("region"))
    out = g.agg(
        F.grouping_id().alias("_g"),
        F.avg("h").alias("mean_h"),
        F.avg("d").alias("mean_d"),
        F.avg("r").alias("mean_r"),
        F.avg(F.col("t_cross").isNotNull().cast("double")).alias("frac_invaded"),
    )
    level = F.when(F.col("_g") == 3, "global").when(F.col("_g") == 1, "macro").otherwise("region")
    return out.select(level.alias("level"), "macro", "region", "mean_h", "mean_d", "mean_r", "frac_invaded")


def group_trajectory(traj: DataFrame, *by: str, states: tuple[str, ...] = ("h", "d", "r")) -> DataFrame:
    """Mean of each state over the nodes of a group at each time."""
    return traj.groupBy("run_id", *by, "t_idx", "t").agg(*[F.avg(s).alias(s) for s in states])


def temporal_metrics(means: DataFrame, *by: str, threshold: float = THRESHOLD) -> DataFrame:
    """peak_d, t_peak, auc_d and t_cross of each group's mean trajectory (from group_trajectory)."""
    w = ("run_id", *by)
    rows = means.withColumn("area", trapezoid("d", "t", *w))
    return rows.groupBy(*w).agg(F.max("d").alias("peak_d"), at_max("t", "d", "t").alias("t_peak"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("auc_d"), first_crossing("d", "t", threshold).alias("t_cross"))


def layer_metrics(traj: DataFrame, comps: DataFrame, layers: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """Per layer: temporal metrics, nodes, share of nodes that cross, and whether it is the first to be invaded (ties by name)."""
    rows = traj.join(comps.select("node", "macro"), "node").where(F.col("macro").isin(*layers))
    mean = temporal_metrics(group_trajectory(rows, "macro"), "macro", threshold=threshold)
    nodes = rows.groupBy("run_id", "macro", "node").agg(first_crossing("d", "t", threshold).alias("c")).groupBy("run_id", "macro").agg(F.count("*").alias("n"), F.avg(F.col("c").isNotNull().cast("double")).alias("frac_invaded"))
    first = F.row_number().over(Window.partitionBy("run_id").orderBy(F.asc_nulls_last("t_cross"), "macro")) == 1
    return mean.join(nodes, ["run_id", "macro"]).select("run_id", "macro", "n", "peak_d", "t_peak", "auc_d", "t_cross", "frac_invaded", first.alias("most_vulnerable"))


def weighted_globals(layers: DataFrame) -> DataFrame:
    """Means of the layers' values weighted by their nodes."""
    w = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias("global_" + c)
    return layers.groupBy("run_id").agg(w("peak_d"), w("auc_d"), w("frac_invaded"))


def drug_summary(traj: DataFrame, comps: DataFrame, threshold: float = DRUG_THRESHOLD) -> DataFrame:
    """Per run and macro type: mean last states, and the peak of the mean drug level and its time."""
    rows = traj.join(comps.select("node", "macro"), "node")
    last = rows.groupBy("run_id", "macro", "node").agg(*[F.max_by(s, "t_idx").alias(s) for s in ("h", "d", "d2", "r", "x")], F.max("d").alias("top"))
    ends = last.groupBy("run_id", "macro").agg(*[F.avg(s).alias("final_" + s) for s in ("h", "d", "d2", "r", "x")], F.avg((F.col("top") > threshold).cast("double")).alias("frac_invaded"))
    drug = rows.groupBy("run_id", "macro", "t").agg(F.avg("f").alias("f")).groupBy("run_id", "macro").agg(F.max("f").alias("peak_f"), at_max("t", "f", "t").alias("t_peak_f"))
    return ends.join(drug, ["run_id", "macro"])


def front(traj: DataFrame, coords: DataFrame, threshold: float = 0.5, q: float = 0.9) -> DataFrame:
    """run_id, t_idx, t, area, radius, radius_smooth, velocity of the invasion front.

    The seed is what starts above the threshold, or else at 0.8 of the largest start or more; radius is the q-quantile of the
    invaded nodes' distances from its centroid and never falls; it is smoothed by a moving mean of min(5, T // 10) samples
    whose ends keep their own values; velocity is the gradient of that, at least 0. coords has node, x, y.
    """
    start = traj.where("t_idx = 0").select("run_id", "node", "d").join(coords, "node")
    top = start.groupBy("run_id").agg(F.max("d").alias("top"))
    start = start.join(top, "run_id")
    seed = start.where(F.when(F.col("top") > threshold, F.col("d") > threshold).otherwise(F.col("d") >= 0.8 * F.col("top"))).groupBy("run_id").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy"))
    rows = traj.join(coords, "node").join(seed, "run_id")
    dist = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    hit = F.col("d") > threshold
    per = rows.groupBy("run_id", "t_idx", "t").agg(F.avg(hit.cast("double")).alias("area"), F.coalesce(F.percentile(F.when(hit, dist), q), F.lit(0.0)).alias("radius"))
    by = Window.partitionBy("run_id")
    along = by.orderBy("t_idx")
    per = per.withColumn("radius", F.max("radius").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("samples", F.count("*").over(by))
    width = F.least(F.lit(5), F.floor(F.col("samples") / 10)).cast("int")
    per = per.withColumn("win", width)
    # a centred mean of win samples, as a sum over the five around with those outside left out
    around = [F.when((F.lit(o) >= -F.floor(F.col("win") / 2)) & (F.lit(o) <= F.col("win") - 1 - F.floor(F.col("win") / 2)), F.lag("radius", -o).over(along) if o < 0 else F.lead("radius", o).over(along)) for o in range(-2, 3)]
    mean = sum((F.coalesce(a, F.lit(0.0)) for a in around[1:]), F.coalesce(around[0], F.lit(0.0))) / F.greatest(F.col("win"), F.lit(1))
    half = F.floor(F.col("win") / 2)
    tail = F.ceil(F.col("win") / 2)
    own = (F.col("win") <= 1) | (F.col("t_idx") < half) | (F.col("t_idx") >= F.col("samples") - tail)
    per = per.withColumn("radius_smooth", F.when(own, F.col("radius")).otherwise(mean))
    return per.select("run_id", "t_idx", "t", "area", "radius", "radius_smooth", F.greatest(gradient("radius_smooth", "t", "run_id"), F.lit(0.0)).alias("velocity"))


def snapshots(traj: DataFrame, times: list[float]) -> DataFrame:
    """Rows at the sample nearest to each time, the earlier one on ties, with the asked time as wanted."""
    ts = traj.select("run_id", "t_idx", "t").distinct()
    wanted = ts.withColumn("wanted", F.explode(F.array(*[F.lit(float(x)) for x in times])))
    near = wanted.groupBy("run_id", "wanted").agg(F.min_by("t_idx", F.struct(F.abs(F.col("t") - F.col("wanted")), F.col("t"))).alias("t_idx"))
    return traj.join(near, ["run_id", "t_idx"])


def peak_snapshot(traj: DataFrame) -> DataFrame:
    """Rows at the sample where the mean of d is largest, the first on ties."""
    mean = traj.groupBy("run_id", "t_idx").agg(F.avg("d").alias("m")).groupBy("run_id").agg(F.max_by("t_idx", F.struct(F.col("m"), -F.col("t_idx"))).alias("t_idx"))
    return traj.join(mean, ["run_id", "t_idx"])


def interpolate(points: DataFrame, grid: DataFrame, *by: str) -> DataFrame:
    """Linear interpolation of points (by, t, x) at grid (by, t); ends hold their value. An as-of join by one sort a group."""
    a = points.select(*by, "t", "x", F.lit(0).alias("g"))
    b = grid.select(*by, "t", F.lit(None).cast("double").alias("x"), F.lit(1).alias("g"))
    w = Window.partitionBy(*by).orderBy("t", "g")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("x").isNotNull(), F.col("t"))
    r = a.unionByName(b).select("*", F.last("x", True).over(back).alias("x0"), F.last(known, True).over(back).alias("t0"), F.first("x", True).over(ahead).alias("x1"), F.first(known, True).over(ahead).alias("t1")).where("g = 1")
    mixed = F.when(F.col("x0").isNull(), F.col("x1")).when(F.col("x1").isNull() | (F.col("t0") == F.col("t")), F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return r.select(*by, "t", mixed.alias("x"))


def temporal_centroid(scores: DataFrame, *by: str) -> DataFrame:
    """by, centroid: scores (by, tp, hours, s) centred on each time point's mean, negatives cut, weighted mean of hours."""
    w = scores.withColumn("w", F.greatest(F.col("s") - F.avg("s").over(Window.partitionBy("tp")), F.lit(0.0)))
    return w.groupBy(*by).agg(F.try_divide(F.sum(F.col("w") * F.col("hours")), F.sum("w")).alias("centroid"))


def settle_time(traj: DataFrame, threshold: float = 1e-3, t_min: float = 5.0, t_max: float = 60.0) -> DataFrame:
    """run_id, t_end: first time the mean of d is below the threshold, within bounds; the upper bound if never."""
    mean = traj.groupBy("run_id", "t").agg(F.avg("d").alias("m"))
    first = F.coalesce(F.min(F.when(F.col("m") < threshold, F.col("t"))), F.lit(t_max))
    return mean.groupBy("run_id").agg(F.greatest(F.lit(t_min), F.least(F.lit(t_max), first)).alias("t_end"))


def run_outputs(traj: DataFrame, comps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scalar outputs of each run: global_r, global_d (last), peak_d (of the mean), t_peak, auc_d, mean_inv_time, frac_invaded."""
    from .dynamics import finals

    end = finals(traj).groupBy("run_id").agg(F.avg("r").alias("global_r"), F.avg("d").alias("global_d"))
    mean = temporal_metrics(group_trajectory(traj), threshold=threshold).select("run_id", "peak_d", "t_peak", "auc_d")
    cross = crossing_time(traj, threshold).groupBy("run_id").agg(F.avg("t_cross").alias("mean_inv_time"), F.avg(F.col("t_cross").isNotNull().cast("double")).alias("frac_invaded"))
    return end.join(mean, "run_id").join(cross, "run_id")


def to_spots(values: DataFrame, labels: DataFrame, key: str = "comp") -> DataFrame:
    """Compartment values at each spot: a join by the spot's compartment; spots without one keep nulls."""
    return labels.join(values, key, "left")


def refined(spots: DataFrame, gene: Column, d: str = "d") -> DataFrame:
    """spots with d_spot = d (1 + gene / 4), gene scaled to 0..1 over all spots, within 0..1."""
    g = spots.withColumn("_g", gene)
    ends = g.agg(F.min("_g").alias("_low"), F.max("_g").alias("_high"))  # one row
    g = g.crossJoin(F.broadcast(ends)).withColumn("_g", F.coalesce(F.try_divide(F.col("_g") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0)))
    return g.withColumn("d_spot", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(d) * (1 + 0.25 * F.col("_g"))))).drop("_g", "_low", "_high")
