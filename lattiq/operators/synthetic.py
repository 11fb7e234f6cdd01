"""Synthetic tissue with a known truth: a jittered grid, zones, types, counts.

Draws of single rows are hashes of their keys. What depends on a whole tissue (smooth fields, dispersions of genes, spread)
is drawn in one task a tissue, which has some thousand spots.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import benchmark
from .benchmark import SHARES, TYPES

def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in (0, 1) from a hash: the same for the same keys on any cluster."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12) + 0.5) / F.lit(float(1 << 52))


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal draw (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1_000_003, *keys))


def hex_grid(spark: SparkSession, side: int = 52, jitter: float = 0.15, seed: int = 0) -> DataFrame:
    """spot, x, y on a jittered hexagonal grid."""
    g = spark.range(side * side).select(F.col("id").alias("spot"), F.floor(F.col("id") / side).alias("r"), (F.col("id") % side).alias("c"))
    x = F.col("c") + F.when(F.col("r") % 2 == 1, 0.5).otherwise(0.0) + jitter * normal(seed, "spot")
    return g.select("spot", x.alias("x"), (F.col("r") * (math.sqrt(3) / 2) + jitter * normal(seed + 1, "spot")).alias("y"))


def zones(spots: DataFrame, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """spots with zone: noisy radial thirds, cortex outside."""
    c = spots.join(F.broadcast(spots.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))))
    d = c.withColumn("_d", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    d = d.join(F.broadcast(d.agg(F.max("_d").alias("_top")))).withColumn("_d", F.col("_d") / F.col("_top") * (1 + noise * normal(seed + 2, "spot")))
    q = d.agg(F.percentile("_d", 1 / 3).alias("_a"), F.percentile("_d", 2 / 3).alias("_b"))
    zone = F.when(F.col("_d") <= F.col("_a"), "inner_medulla").when(F.col("_d") <= F.col("_b"), "outer_medulla").otherwise("cortex")
    return d.join(F.broadcast(q)).select(*spots.columns, zone.alias("zone"))


def cell_types(spots: DataFrame, seed: int = 0) -> DataFrame:
    """spots with type: the largest of log share plus a Gumbel draw a type."""
    shares = [(z, t, float(math.log(p))) for z, ps in SHARES.items() for t, p in zip(TYPES, ps)]
    dim = spots.sparkSession.createDataFrame(shares, "zone string, type string, logp double")
    each = spots.join(F.broadcast(dim), "zone").withColumn("_g", F.col("logp") - F.log(-F.log(uniform(seed + 3, "spot", "type"))))
    best = each.groupBy("spot").agg(F.max_by("type", F.struct("_g", "type")).alias("type"))
    return spots.join(best, "spot")


def _once(spark: SparkSession, fn, schema: str) -> DataFrame:
    return spark.range(1).groupBy("id").applyInPandas(lambda _: fn(), schema)


def whole_tissue(spark: SparkSession, side: int = benchmark.SIDE, seed: int = 0) -> DataFrame:
    """spot, x, y, zone, type of a tissue whose types follow zones and smooth preferences."""

    def draw() -> pd.DataFrame:
        xy, zone, kind = benchmark.tissue(np.random.default_rng([seed, 0]), side)
        return pd.DataFrame({"spot": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "zone": zone, "type": kind})

    return _once(spark, draw, "spot long, x double, y double, zone string, type string")


def spot_truth(spark: SparkSession, side: int = benchmark.SIDE, seed: int = 0) -> DataFrame:
    """spot, zone, type, t_act (null if never), d_seen, d_end of the spread over a whole tissue's own graph."""

    def solve() -> pd.DataFrame:
        xy, zone, kind = benchmark.tissue(np.random.default_rng([seed, 0]), side)
        rate = np.array([benchmark.dims.MACRO_RATES[k] for k in kind])
        t, d = benchmark.spread(benchmark.knn_edges(xy), rate[:, 0], rate[:, 1], np.where(zone == "outer_medulla", benchmark.SEED, 0.0))
        hit = d >= benchmark.ACTIVE
        act = [float(t[k]) if any_ else None for k, any_ in zip(hit.argmax(axis=0), hit.any(axis=0))]
        return pd.DataFrame({"spot": np.arange(len(xy)), "zone": zone, "type": kind, "t_act": act, "d_seen": d[np.searchsorted(t, benchmark.T_SEEN)], "d_end": d[-1]})

    return _once(spark, solve, "spot long, zone string, type string, t_act double, d_seen double, d_end double")


def expression(spots: DataFrame, damage: DataFrame, sigma: float = 0.25, housekeeping: int = 60, seed: int = 0) -> DataFrame:
    """spot, gene, count: negative binomial counts of panel and housekeeping genes raised by type, zone and damage (spot, d).

    Dispersions are a draw a gene, so a tissue (spots with type and zone) is drawn in one task.
    """
    rows = spots.select("spot", "type", "zone").join(damage.select("spot", "d"), "spot", "left").withColumn("_g", F.lit(0))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("spot")
        x, names = benchmark.counts(np.random.default_rng([seed, 1]), pdf["type"].to_numpy(), pdf["zone"].to_numpy(), pdf["d"].fillna(0.0).to_numpy(), sigma, housekeeping)
        return pd.DataFrame({"spot": np.repeat(pdf["spot"].to_numpy(), len(names)), "gene": np.tile(names, len(pdf)), "count": x.ravel().astype(float)})

    return rows.groupBy("_g").applyInPandas(draw, "spot long, gene string, count double")


def inject_errors(labels: DataFrame, level: float, seed: int = 0, mode: str = "adjacent") -> DataFrame:
    """labels (spot, type) with noisy: a share of types replaced by a neighbouring type (adjacent) or any other (uniform)."""
    if mode == "adjacent":
        others = F.create_map(*[x for t, near in benchmark.NEIGHBOURS.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in near]))])[F.col("type")]
    else:
        others = F.filter(F.array(*[F.lit(t) for t in TYPES]), lambda t: t != F.col("type"))
    nxt = F.element_at(others, (F.floor(uniform(seed + 9, "spot") * F.size(others)) + 1).cast("int"))
    return labels.withColumn("noisy", F.when(uniform(seed + 7, "spot") < level, nxt).otherwise(F.col("type")))


def blind_types(values: DataFrame, profiles: DataFrame) -> DataFrame:
    """spot, type, cosine: the profile (type, gene, value) nearest by cosine to each spot's values (spot, gene, value)."""
    p = profiles.withColumn("_n", F.sqrt(F.sum(F.col("value") ** 2).over(Window.partitionBy("type")))).select("type", "gene", (F.col("value") / F.col("_n")).alias("p"))
    norm = values.groupBy("spot").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n"))
    dot = values.join(F.broadcast(p), "gene").groupBy("spot", "type").agg(F.sum(F.col("value") * F.col("p")).alias("dot"))
    s = dot.join(norm, "spot").withColumn("cosine", F.coalesce(F.try_divide("dot", "n"), F.lit(0.0)))
    return s.groupBy("spot").agg(F.max_by("type", F.struct("cosine", "type")).alias("type"), F.max("cosine").alias("cosine"))


def drop_edges(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """edges without a share of undirected ones, both directions together."""
    return edges.where(uniform(seed + 8, F.least("i", "j"), F.greatest("i", "j")) >= share)
