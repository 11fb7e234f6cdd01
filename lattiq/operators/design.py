"""Designs of runs (run_id, mult MAP<STRING,DOUBLE>) and what is drawn from their outputs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import SWEEP
from ..session import cut
from . import order_stats, stats

#: The most often that a row is drawn into a bootstrap replicate; a Poisson(1) draw is larger once in ten million.
POISSON_MOST = 9


def one_at_a_time(spark: SparkSession, levels: int = 7, ranges: dict[str, tuple[float, float]] = SWEEP) -> DataFrame:
    """run_id, param, multiplier, mult: each parameter alone over evenly spaced levels."""
    dim = spark.createDataFrame([(k, *v) for k, v in ranges.items()], "param string, lo double, hi double")
    grid = dim.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("multiplier", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (levels - 1))
    return grid.select(F.concat_ws("#", "param", F.col("k").cast("string")).alias("run_id"), "param", "multiplier", F.create_map("param", "multiplier").alias("mult"))


def grid(spark: SparkSession, a: str, b: str, n: int = 12, range_a: tuple[float, float] = (0.7, 2.0), range_b: tuple[float, float] = (0.6, 1.8)) -> DataFrame:
    """run_id, va, vb, mult over an n by n grid of two parameters."""
    steps = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    va = F.lit(range_a[0]) + F.lit(range_a[1] - range_a[0]) * F.col("i") / (n - 1)
    vb = F.lit(range_b[0]) + F.lit(range_b[1] - range_b[0]) * F.col("j") / (n - 1)
    return steps.select(F.concat(F.lit("g"), "i", F.lit("_"), "j").alias("run_id"), va.alias("va"), vb.alias("vb")).withColumn("mult", F.create_map(F.lit(a), "va", F.lit(b), "vb"))


def monte_carlo(spark: SparkSession, n: int = 200, seed: int = 42, ranges: dict[str, tuple[float, float]] = SWEEP) -> DataFrame:
    """run_id, mult: uniform samples. A value is a hash of (seed, run, parameter), so any task gives the same design."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), 12) + 0.5) / F.lit(float(1 << 52))
    entries = [x for k, (lo, hi) in ranges.items() for x in (F.lit(k), F.lit(lo) + F.lit(hi - lo) * u(k))]
    return spark.range(n).select(F.concat(F.lit("mc"), F.col("id").cast("string")).alias("run_id"), F.create_map(*entries).alias("mult"))


def morris(spark: SparkSession, trajectories: int = 10, levels: int = 4, seed: int = 42, ranges: dict[str, tuple[float, float]] = SWEEP) -> DataFrame:
    """run_id, traj, step, param (moved in this step, null for step 0), value (of it), mult: Morris trajectories."""
    names, delta = list(ranges), levels / (2.0 * (levels - 1))
    rng, rows = np.random.default_rng(seed), []
    for t in range(trajectories):
        x = rng.integers(0, levels, len(names)) / (levels - 1)
        real = lambda x: {k: float(ranges[k][0] + v * (ranges[k][1] - ranges[k][0])) for k, v in zip(names, x)}
        rows.append((f"t{t}s0", t, 0, None, None, real(x)))
        for step, k in enumerate(rng.permutation(len(names)), 1):
            x = x.copy()
            x[k] = np.clip(x[k] + (delta if x[k] <= 0.5 else -delta), 0.0, 1.0)
            m = real(x)
            rows.append((f"t{t}s{step}", t, step, names[k], m[names[k]], m))
    return spark.createDataFrame(rows, "run_id string, traj int, step int, param string, value double, mult map<string,double>")


def elementary_effects(design: DataFrame, outputs: DataFrame, metric: str) -> DataFrame:
    """param, mu_star, sigma (population), mu, n_ee of one output over Morris trajectories."""
    w = Window.partitionBy("traj").orderBy("step")
    rows = design.join(outputs.select("run_id", F.col(metric).alias("y")), "run_id")
    before = F.lag("mult").over(w)
    rows = rows.select("param", "y", (F.col("y") - F.lag("y").over(w)).alias("dy"), (F.col("value") - F.try_element_at(before, F.col("param"))).alias("dx"))
    ee = rows.where(F.col("param").isNotNull() & (F.abs("dx") > 1e-12) & F.col("dy").isNotNull()).select("param", (F.col("dy") / F.col("dx")).alias("ee"))
    return ee.groupBy("param").agg(F.avg(F.abs("ee")).alias("mu_star"), F.stddev_pop("ee").alias("sigma"), F.avg("ee").alias("mu"), F.count("*").alias("n_ee"))


def tornado(rows: DataFrame, metric: str, top: int = 12) -> DataFrame:
    """param, low, high, span, nominal: ranges of an output over one-at-a-time runs, widest first, at most top."""
    g = rows.where(F.col(metric).isNotNull()).groupBy("param").agg(F.min(metric).alias("low"), F.max(metric).alias("high"), F.avg(F.when(F.col("multiplier").between(0.95, 1.05), F.col(metric))).alias("nominal"), F.count("*").alias("n")).where("n >= 2")
    return g.select("param", "low", "high", (F.col("high") - F.col("low")).alias("span"), "nominal").orderBy(F.desc("span"), "param").limit(top)


def long_multipliers(design: DataFrame) -> DataFrame:
    """run_id, param, multiplier."""
    return design.select("run_id", F.explode("mult").alias("param", "multiplier"))


def sobol_points(n: int, dims: int, seed: int = 42) -> np.ndarray:
    """n points of a Sobol sequence in up to 21 dimensions, shifted by a seeded vector, by Gray code from direction numbers."""
    # Degree, coefficient and first direction numbers of the primitive polynomials.
    poly = [
        (1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]),
        (5, 4, [1, 1, 5, 5, 5]), (5, 7, [1, 1, 7, 11, 19]), (5, 11, [1, 1, 5, 1, 1]), (5, 13, [1, 1, 1, 3, 11]), (5, 14, [1, 3, 5, 5, 31]),
        (6, 1, [1, 3, 3, 9, 7, 49]), (6, 13, [1, 1, 1, 15, 21, 21]), (6, 16, [1, 3, 1, 13, 27, 49]), (6, 19, [1, 1, 1, 15, 7, 5]), (6, 22, [1, 3, 1, 15, 13, 25]),
        (6, 25, [1, 1, 5, 5, 19, 61]), (7, 1, [1, 3, 7, 11, 23, 15, 103]), (7, 4, [1, 3, 7, 13, 13, 15, 69]),
    ]
    if dims > len(poly) + 1:
        raise ValueError(f"at most {len(poly) + 1} dimensions")
    bits = 30
    v = np.zeros((dims, bits), np.int64)
    v[0] = [1 << (bits - 1 - k) for k in range(bits)]
    for d in range(1, dims):
        s, a, m = poly[d - 1]
        m = list(m)
        for k in range(s, bits):
            new = m[k - s] ^ (m[k - s] << s)
            for q in range(1, s):
                new ^= ((a >> (s - 1 - q)) & 1) * (m[k - q] << q)
            m.append(new)
        v[d] = [m[k] << (bits - 1 - k) for k in range(bits)]
    x, out = np.zeros(dims, np.int64), np.zeros((n, dims))
    for i in range(n):
        out[i] = x / float(1 << bits)
        c = 0
        while i >> c & 1:
            c += 1
        x = x ^ v[:, c]
    shift = np.random.default_rng(seed).random(dims)
    return (out + shift) % 1.0


def saltelli(spark: SparkSession, n: int, ranges: dict[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    """run_id, base, kind (A, B or the parameter taken from B), mult: n (D + 2) runs of at most 10 parameters."""
    names = list(ranges)
    p = sobol_points(n, 2 * len(names), seed)
    a, b = p[:, : len(names)], p[:, len(names) :]
    real = lambda x: {k: float(ranges[k][0] + v * (ranges[k][1] - ranges[k][0])) for k, v in zip(names, x)}
    rows = []
    for i in range(n):
        rows += [(f"{i}A", i, "A", real(a[i])), (f"{i}B", i, "B", real(b[i]))]
        for k, name in enumerate(names):
            x = a[i].copy()
            x[k] = b[i, k]
            rows.append((f"{i}{name}", i, name, real(x)))
    return spark.createDataFrame(rows, "run_id string, base int, kind string, mult map<string,double>")


def sobol_indices(design: DataFrame, outputs: DataFrame, metric: str) -> DataFrame:
    """param, s1, st by the estimators of Saltelli and Jansen; unknown outputs count as the mean of the known ones."""
    rows = design.join(outputs.select("run_id", F.col(metric).alias("y")), "run_id", "left")
    rows = rows.withColumn("y", F.coalesce("y", F.avg("y").over(Window.partitionBy())))
    a = rows.where("kind = 'A'").select("base", F.col("y").alias("ya"))
    b = rows.where("kind = 'B'").select("base", F.col("y").alias("yb"))
    var = rows.where("kind in ('A', 'B')").agg(F.var_pop("y").alias("var"))
    each = rows.where("kind not in ('A', 'B')").select("base", F.col("kind").alias("param"), "y").join(a, "base").join(b, "base").crossJoin(F.broadcast(var))
    return each.groupBy("param").agg(F.try_divide(F.avg(F.col("yb") * (F.col("y") - F.col("ya"))), F.first("var")).alias("s1"), F.try_divide(F.avg((F.col("ya") - F.col("y")) ** 2) / 2, F.first("var")).alias("st"))


def poisson_weight(seed: int, *keys: str):
    """A Poisson(1) draw by the hash of its keys: how often a row is in a bootstrap replicate, without a table of draws."""
    text = F.concat_ws(":", F.lit(seed), *keys)
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    below, term, out = 0.0, math.exp(-1), F.lit(POISSON_MOST)
    steps = []
    for k in range(POISSON_MOST):
        below += term
        steps.append((k, below))
        term /= k + 1
    for k, upto in reversed(steps):
        out = F.when(u < upto, k).otherwise(out)
    return out


def sobol_intervals(design: DataFrame, outputs: DataFrame, metric: str, replicates: int = 100, seed: int = 0) -> DataFrame:
    """param, s1, st and s1_conf, st_conf: half widths of 95 % intervals (1.96 standard deviations over replicates).

    A replicate weighs each base point by a Poisson draw; all replicates are sums of one aggregate, by (param, replicate)
    and, for the variance of A and B, by replicate. Unknown outputs count as the mean of the known ones.
    """
    known = outputs.select("run_id", F.col(metric).alias("y"))
    fill = known.agg(F.avg("y")).first()[0]
    rows = design.join(known, "run_id", "left").select("base", "kind", F.coalesce("y", F.lit(fill)).alias("y"))
    ends = rows.groupBy("base").agg(F.max(F.when(F.col("kind") == "A", F.col("y"))).alias("ya"), F.max(F.when(F.col("kind") == "B", F.col("y"))).alias("yb"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    drawn = ends.select("*", turns.alias("b")).withColumn("w", poisson_weight(seed, "base", "b"))
    sq = drawn.groupBy("b").agg(F.sum(F.col("w") * (F.col("ya") + F.col("yb"))).alias("s"), F.sum(F.col("w") * (F.col("ya") ** 2 + F.col("yb") ** 2)).alias("ss"), F.sum(2 * F.col("w")).alias("n"))
    var = sq.select("b", (F.try_divide("ss", "n") - F.try_divide("s", "n") ** 2).alias("var"))
    crossed = rows.where("kind not in ('A', 'B')").select("base", F.col("kind").alias("param"), "y")
    first, whole = F.col("yb") * (F.col("y") - F.col("ya")), (F.col("ya") - F.col("y")) ** 2 / 2
    each = crossed.join(drawn, "base").groupBy("param", "b").agg(F.sum(F.col("w") * first).alias("f"), F.sum(F.col("w") * whole).alias("t"), F.sum("w").alias("n"))
    spread = each.join(var, "b").select("param", F.try_divide(F.try_divide("f", "n"), F.col("var")).alias("s1"), F.try_divide(F.try_divide("t", "n"), F.col("var")).alias("st"))
    spread = spread.groupBy("param").agg((1.96 * F.stddev_samp("s1")).alias("s1_conf"), (1.96 * F.stddev_samp("st")).alias("st_conf"))
    return sobol_indices(design, outputs, metric).join(spread, "param")


def rank_stability(peaks: DataFrame, base_run: str, value: str = "peak") -> DataFrame:
    """mean, sd, p05, p95, n: Spearman's rho of each run's values over nodes (run_id, node, value) with those of the base
    run; runs without a rho are left out."""
    base = peaks.where(F.col("run_id") == base_run).select("node", F.col(value).alias("_base"))
    r = cut(stats.spearman(peaks.where(F.col("run_id") != base_run).join(base, "node"), value, "_base", "run_id").where("rho is not null"), "rho")
    low, high = order_stats.quantiles(r, "rho", [0.05, 0.95])
    return r.agg(F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"), F.lit(low).cast("double").alias("p05"), F.lit(high).cast("double").alias("p95"), F.count("*").alias("n"))


def rewire(edges: DataFrame, replicates: int, swaps: int, seed: int = 42) -> DataFrame:
    """graph_id, i, j, w: degree-preserving double-edge swaps, a replicate a group; at most 20 tries a swap.

    Swapping is sequential within a replicate, so each is a seeded numpy loop over a compartment graph's edges.
    """
    spark = edges.sparkSession
    copies = edges.where("i < j").crossJoin(spark.range(replicates).select(F.concat(F.lit("rw"), F.col("id").cast("string")).alias("graph_id"), F.col("id").alias("_k")))

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        rng = np.random.default_rng(seed + int(pdf["_k"].iloc[0]))
        e = list(zip(pdf["i"].tolist(), pdf["j"].tolist()))
        have, done = set(e), 0
        for _ in range(20 * swaps):
            if done == swaps or len(e) < 2:
                break
            p, q = rng.choice(len(e), 2, replace=False)
            (a, b), (c, d) = e[p], e[q]
            if rng.random() < 0.5:
                c, d = d, c
            x, y = tuple(sorted((a, d))), tuple(sorted((c, b)))
            if len({a, b, c, d}) < 4 or x in have or y in have:
                continue
            have -= {e[p], e[q]}
            have |= {x, y}
            e[p], e[q] = x, y
            done += 1
        one = pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "i": [x[0] for x in e], "j": [x[1] for x in e], "w": pdf["w"].to_numpy()})
        return pd.concat([one, one.rename(columns={"i": "j", "j": "i"})])[["graph_id", "i", "j", "w"]]

    return copies.groupBy("graph_id").applyInPandas(swap, "graph_id string, i long, j long, w double")
