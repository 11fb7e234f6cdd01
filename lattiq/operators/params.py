"""Rates of compartments from lookup dimensions, and multipliers of sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims


def default_rates(comps: DataFrame, outer_only: bool = False) -> DataFrame:
    """comps (node, comp, macro, region, is_boundary) with beta, rho, d_h, d_d.

    Unknown macro types take the defaults and unknown regions a multiplier of 1. outer_only: the simplified
    model, which raises compartments named outer_medulla or boundary and leaves the others alone.
    """
    spark = comps.sparkSession
    m = comps.join(F.broadcast(dims.macro_rates(spark)), "macro", "left")
    if outer_only:
        outer = F.col("comp").contains("outer_medulla") | F.col("comp").contains("boundary")
        bm, rm = F.when(outer, 1.25).otherwise(1.0), F.when(outer, 1.10).otherwise(1.0)
    else:
        m = m.join(F.broadcast(dims.region_rates(spark)), "region", "left")
        bm, rm = F.coalesce("beta_mult", F.lit(1.0)), F.coalesce("rho_mult", F.lit(1.0))
    return m.select(
        *comps.columns,
        (F.coalesce("beta", F.lit(dims.BETA)) * bm).alias("beta"),
        (F.coalesce("rho", F.lit(dims.RHO)) * rm).alias("rho"),
        F.lit(dims.D_H).alias("d_h"),
        F.coalesce("d_d", F.lit(dims.D_D)).alias("d_d"),
    )


def drug_rates(rates: DataFrame) -> DataFrame:
    """rates with delta, rho2, k_f, k_e, d_f, ic50. The macro type's own values win over any default."""
    spark = rates.sparkSession
    m = rates.join(F.broadcast(dims.drug_rates(spark)), "macro", "left").join(F.broadcast(dims.region_delta(spark)), "region", "left")
    return m.select(
        *rates.columns,
        (F.coalesce("delta", F.lit(dims.DELTA)) * F.coalesce("delta_mult", F.lit(1.0))).alias("delta"),
        (F.col("rho") * dims.RHO2_MULT).alias("rho2"),
        F.lit(dims.K_F).alias("k_f"),
        F.lit(dims.K_E).alias("k_e"),
        F.coalesce("d_f", F.lit(dims.D_F)).alias("d_f"),
        F.lit(dims.IC50).alias("ic50"),
    )


def plausible_ratio(rates: DataFrame) -> DataFrame:
    """macro, mean_r, low, high, ok: mean beta over rho against its plausible range, known macro types only."""
    g = rates.groupBy("macro").agg(F.avg(F.col("beta") / F.col("rho")).alias("mean_r"))
    return g.join(F.broadcast(dims.plausible(rates.sparkSession)), "macro").select("macro", "mean_r", "low", "high", F.col("mean_r").between(F.col("low"), F.col("high")).alias("ok"))


def with_multipliers(rates: DataFrame, design: DataFrame) -> DataFrame:
    """rates for each run of design (run_id, mult MAP<STRING,DOUBLE>): run_id and the scaled rates.

    The design is crossed with the compartments, which are the runs' own rows (a few dozen), not pairs of runs.
    """
    get = lambda *name: F.coalesce(F.try_element_at("mult", F.concat(*name)), F.lit(1.0))
    both = F.broadcast(rates).crossJoin(design)  # compartments, of which the solvers take MAX_NODES at most
    zone = F.when(F.col("region").isin("outer_medulla", "boundary"), "outer").when(F.col("region") == "inner_medulla", "inner")
    named = F.col("macro").isin("PT", "DCT", "TAL", "vascular")
    scaled = lambda p: F.when(named, get(F.lit(p + "_"), F.col("macro"))).otherwise(1.0) * F.when(zone.isNotNull(), get(F.lit(p + "_mult_"), zone)).otherwise(1.0)
    return both.select(
        "run_id",
        *[c for c in rates.columns if c not in ("beta", "rho", "d_h", "d_d")],
        (F.col("beta") * scaled("beta")).alias("beta"),
        (F.col("rho") * scaled("gamma")).alias("rho"),
        (F.col("d_h") * get(F.lit("D_S_global"))).alias("d_h"),
        (F.col("d_d") * get(F.lit("D_I_global"))).alias("d_d"),
    )
