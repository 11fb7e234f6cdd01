"""Lookup dimensions and default constants of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Default rates, macro types (beta, rho, d_d) and region multipliers (beta, rho).
BETA, RHO, D_H, D_D = 0.30, 0.10, 0.05, 0.20
MACRO_RATES = {
    "PT": (0.40, 0.08, 0.20),
    "DCT": (0.28, 0.10, 0.20),
    "TAL": (0.25, 0.12, 0.20),
    "vascular": (0.30, 0.10, 0.35),
    "immune": (0.20, 0.25, 0.20),
    "other": (0.22, 0.10, 0.20),
}
REGION_RATES = {
    "outer_medulla": (1.25, 1.10),
    "boundary": (1.25, 1.10),
    "cortex": (1.00, 1.00),
    "mid": (1.00, 1.00),
    "inner_medulla": (0.75, 0.85),
    "core": (0.80, 0.90),
}
# Drug defaults, death rates by macro type, their region multipliers, drug diffusion.
DELTA, K_F, RHO2_MULT, K_E, D_F, DOSE, IC50 = 0.02, 0.50, 1.5, 0.15, 0.30, 1.0, 0.0
MACRO_DELTA = {"PT": 0.040, "DCT": 0.020, "TAL": 0.015, "vascular": 0.010, "immune": 0.005, "other": 0.015}
REGION_DELTA = {"outer_medulla": 1.30, "boundary": 1.30, "cortex": 1.00, "mid": 1.00, "inner_medulla": 0.70, "core": 0.70}
MACRO_D_F = {"vascular": 0.60, "PT": 0.30, "DCT": 0.25, "TAL": 0.25, "immune": 0.20, "other": 0.25}
# Layers, their topology, order of zones on ties, thresholds, plausible beta over rho.
LAYERS = ("PT", "DCT", "TAL")
TOPOLOGY = (("PT", "DCT"), ("DCT", "TAL"), ("PT", "TAL"))
ZONES = ("inner_medulla", "outer_medulla", "cortex")
THRESHOLD, DRUG_THRESHOLD = 0.10, 0.05
PLAUSIBLE = {"PT": (1.5, 5.0), "TAL": (1.0, 3.5), "vascular": (1.2, 4.0), "DCT": (1.0, 3.0)}
# Ranges of the multipliers in sweeps.
SWEEP = {
    "beta_PT": (0.6, 1.6),
    "beta_DCT": (0.6, 1.6),
    "beta_TAL": (0.6, 1.6),
    "beta_vascular": (0.6, 1.6),
    "gamma_PT": (0.6, 1.6),
    "gamma_DCT": (0.6, 1.6),
    "gamma_TAL": (0.6, 1.6),
    "gamma_vascular": (0.6, 1.6),
    "beta_mult_outer": (0.8, 1.6),
    "beta_mult_inner": (0.5, 1.2),
    "gamma_mult_outer": (0.8, 1.4),
    "gamma_mult_inner": (0.6, 1.2),
    "D_I_global": (0.3, 3.0),
    "D_S_global": (0.3, 3.0),
}
D_INTER = (0.01, 0.02, 0.05, 0.10, 0.20, 0.40)
# Names that stand for the driver tables' small keys.
MACROS = ("PT", "DCT", "TAL", "vascular", "immune", "other")
REGIONS = ("cortex", "outer_medulla", "inner_medulla", "boundary", "mid")


def macro_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in MACRO_RATES.items()], "macro string, beta double, rho double, d_d double")


def region_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in REGION_RATES.items()], "region string, beta_mult double, rho_mult double")


def drug_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, MACRO_DELTA[k], MACRO_D_F[k]) for k in MACROS], "macro string, delta double, d_f double")


def region_delta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGION_DELTA.items()), "region string, delta_mult double")


def plausible(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PLAUSIBLE.items()], "macro string, low double, high double")
