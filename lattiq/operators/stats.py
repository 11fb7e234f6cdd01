"""Statistics over tables: rank correlations, agreement of rankings, classification curves, regression shares, tests."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import avg_rank
from ..session import cut
from . import order_stats

#: Rows of a table whose pairs are all compared, at most.
PAIR_ROWS = 10_000


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """by, rho, n: correlation of average-tie ranks over rows where both are known."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = known.select(*by, avg_rank(x, *by).alias("_x"), avg_rank(y, *by).alias("_y"))
    rho = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))  # null where one side is constant
    return r.groupBy(*by).agg(rho.alias("rho"), F.count("*").alias("n"))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    if df <= 0 or t != t:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    c, d, h = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) * h / a
    return 1 - value if swap else value


def spearman_test(df: DataFrame, x: str, y: str, *by: str, least: int = 10) -> DataFrame:
    """by, rho, p, n: Spearman's rho with the t approximation of its p-value; groups of fewer than least rows are left out."""

    @F.pandas_udf("double")
    def p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([0.0 if abs(r) >= 1 else t_two_sided(r * ((m - 2) / (1 - r * r)) ** 0.5, m - 2) for r, m in zip(rho, n)])

    s = spearman(df, x, y, *by).where((F.col("n") >= least) & F.col("rho").isNotNull())
    return s.select(*by, "rho", p_value("rho", "n").alias("p"), "n")


def _bounded(df: DataFrame, what: str) -> DataFrame:
    """df written, of PAIR_ROWS rows at most: what follows compares all pairs of them."""
    df = cut(df, "pairs")
    if (n := df.count()) > PAIR_ROWS:
        raise ValueError(f"{what} compares all pairs and takes {PAIR_ROWS} rows at most, not {n}")
    return df


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, tau (tau-b) and pairs, by counting inversions over ranges; tables of any size."""
    r = order_stats.kendall(df, x, y)
    return df.sparkSession.createDataFrame([(r["tau"], r["pairs"])], "tau double, pairs long")


def running_sums(df: DataFrame, order: str, values: tuple[str, ...], descending: bool = False) -> DataFrame:
    """df with before_<value>: the sum of each value over the rows before in the order of a column without ties.

    Rows are range-partitioned by it; each range sums its own rows, and one row a range gives what came before.
    """
    spark, by = df.sparkSession, F.desc(order) if descending else F.asc(order)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    along = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t{v}").over(along), F.lit(0)).alias(f"_b{v}") for v in values])
    own = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"_l{v}") for v in values])
    return local.join(F.broadcast(bases), "_part").select(*df.columns, *[(F.col(f"_l{v}") + F.col(f"_b{v}")).alias(f"before_{v}") for v in values])


def auroc_auprc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auroc by rank sums with average ties; auprc as average precision over distinct scores.

    Rows are summed by score first; ranks and precisions are running sums over the distinct scores.
    """
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(score).alias("s"))
    r = cut(running_sums(rows.groupBy("s").agg(F.sum("y").alias("tp"), F.count("*").cast("double").alias("m")), "s", ("tp", "m")), "scores")
    total = r.agg(F.sum("tp").alias("p"), F.sum("m").alias("rows"))
    r = r.crossJoin(F.broadcast(total))  # one row
    above, every = F.col("p") - F.col("before_tp"), F.col("rows") - F.col("before_m")  # at this score or a larger one
    rank = F.col("before_m") + (F.col("m") + 1) / 2
    g = r.groupBy("p", "rows").agg(F.sum(F.col("tp") * rank).alias("rs"), F.sum(F.col("tp") * above / every).alias("a"))
    auroc = F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("rows") - F.col("p")))
    return g.select(auroc.alias("auroc"), F.try_divide("a", "p").alias("auprc"))


def loss_shares(df: DataFrame, losses: dict[str, float], factors: list[str]) -> DataFrame:
    """factor, partial_r2, share: a composite loss (signed sum of z-scores) explained by standardised factors.

    Ordinary least squares by normal equations whose sums come from one aggregate; the partial R2 of a factor is
    the rise of the residual sum without it over that sum.
    """
    used = list(dict.fromkeys([*losses, *factors]))
    df = df.crossJoin(F.broadcast(df.agg(*[x for c in used for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])))  # one row
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0))
    cols = [z(f).alias(f"f{i}") for i, f in enumerate(factors)]
    loss = sum((F.lit(sign) * z(c) for c, sign in list(losses.items())[1:]), F.lit(list(losses.values())[0]) * z(list(losses)[0]))
    t = df.select(*cols, loss.alias("y")).withColumn("one", F.lit(1.0))
    names = ["one", *[f"f{i}" for i in range(len(factors))], "y"]
    sums = t.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in itertools.combinations_with_replacement(names, 2)]).first()
    m = np.zeros((len(names),) * 2)
    for i, j in itertools.combinations_with_replacement(range(len(names)), 2):
        m[i, j] = m[j, i] = sums[f"{names[i]}_{names[j]}"] or 0.0

    def rss(use: list[int]) -> float:
        xx, xy = m[np.ix_(use, use)], m[use, -1]
        return float(m[-1, -1] - xy @ np.linalg.lstsq(xx, xy, rcond=None)[0])

    full = list(range(len(names) - 1))
    base = rss(full)
    part = [(rss([k for k in full if k != i + 1]) - base) for i in range(len(factors))]
    part = [p / (p + base) if p + base > 0 else 0.0 for p in part]
    total = sum(part) or 1.0
    return df.sparkSession.createDataFrame([(f, float(p), float(p / total)) for f, p in zip(factors, part)], "factor string, partial_r2 double, share double")


def qap(a: DataFrame, b: DataFrame, labels: list[str]) -> DataFrame:
    """rho, p, n_perm: Spearman of off-diagonal entries of two labelled matrices (a, b, k) and its exact one-sided
    p-value over all relabellings of the second (labels of up to 6)."""
    if len(labels) > 6:
        raise ValueError("exact relabelling is for at most 6 labels")
    perms = [(k, x, y) for k, p in enumerate(itertools.permutations(labels)) for x, y in zip(labels, p)]
    spark = a.sparkSession
    m = spark.createDataFrame(perms, "perm int, label string, to string")
    moved = F.broadcast(m)
    left = a.where("a <> b").select("a", "b", F.col("k").alias("x"))
    right = b.where("a <> b").join(moved.select(F.col("label").alias("a"), F.col("to").alias("na"), "perm"), "a").join(moved.select(F.col("label").alias("b"), F.col("to").alias("nb"), F.col("perm").alias("perm2")), "b").where("perm = perm2")
    both = left.join(right.select("perm", F.col("na").alias("a"), F.col("nb").alias("b"), F.col("k").alias("y")), ["a", "b"])
    r = spearman(both, "x", "y", "perm")
    own = r.where("perm = 0").select(F.col("rho").alias("own"))
    return r.crossJoin(own).agg(F.first("own").alias("rho"), F.avg((F.col("rho") >= F.col("own") - 1e-12).cast("double")).alias("p"), F.count("*").alias("n_perm"))


def leave_one_out(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """lowest, highest: range of Spearman's rho when each row is left out in turn; for tables of groups."""
    df = _bounded(df.select(key, x, y), "leave_one_out")
    keys = df.select(F.col(key).alias("_out"))
    each = df.join(keys, F.col(key) != F.col("_out"))
    return spearman(each, x, y, "_out").agg(F.min("rho").alias("lowest"), F.max("rho").alias("highest"))


def permutation_spearman(df: DataFrame, x: str, y: str, *by: str, permutations: int = 10_000, seed: int = 0) -> DataFrame:
    """by, rho, p, n: two-sided permutation test of Spearman's rho for each group; fewer than 4 rows give nulls."""
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    head = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keys].iloc[:1].copy()
        a, b = pdf[x].rank().to_numpy(), pdf[y].rank().to_numpy()
        n = len(a)
        rho = p = None
        if n >= 4 and a.std() > 0 and b.std() > 0:
            a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
            rho = float(a @ b / n)
            rng = np.random.default_rng(seed)
            null = np.concatenate([rng.permuted(np.tile(b, (min(2000, permutations - k), 1)), axis=1) @ a / n for k in range(0, permutations, 2000)])
            p = float((1 + (np.abs(null) >= abs(rho) - 1e-12).sum()) / (1 + permutations))
        out["rho"], out["p"], out["n"] = rho, p, n
        return out

    r = rows.groupBy(*keys).applyInPandas(test, f"{head}, rho double, p double, n long")
    return r if by else r.drop("_all")


def wilcoxon(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """by, w, z, n: Wilcoxon's signed ranks of x - y, zeros left out, average ties, normal score without correction for ties."""
    d = df.select(*by, (F.col(x) - F.col(y)).alias("d")).where("d <> 0")
    r = d.select(*by, "d", avg_rank(F.abs("d"), *by).alias("r"))
    g = r.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"), F.count("*").alias("n"))
    mean, sd = F.col("n") * (F.col("n") + 1) / 4, F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24)
    w = F.least("up", "down")
    return g.select(*by, w.alias("w"), F.try_divide(w - mean, sd).alias("z"), "n")


def uniformity(df: DataFrame, phase: str, *by: str, least: int = 10) -> DataFrame:
    """by, n, r, p: Rayleigh's test that phases (shares of a cycle) are spread evenly; r is the mean resultant length.

    p is the leading term exp(-n r^2). Groups of fewer than least rows are left out.
    """
    turn = 2 * math.pi * F.col(phase)
    g = df.where(F.col(phase).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.cos(turn)).alias("_c"), F.sum(F.sin(turn)).alias("_s")).where(F.col("n") >= least)
    square = (F.col("_c") ** 2 + F.col("_s") ** 2) / F.col("n")
    return g.select(*by, "n", F.sqrt(square / F.col("n")).alias("r"), F.exp(-square).alias("p"))


def adjusted(tests: DataFrame, p: str, *family: str) -> DataFrame:
    """tests with m (tests of the family with a known p), bonferroni and holm (step-down), both at most 1.

    Tests without a p get none and don't count. Windows run over a family's tests, never over the rows they came from.
    """
    known = F.col(p).isNotNull() & ~F.isnan(p)
    out = tests.withColumn("_ok", known).withColumn("m", F.count_if("_ok").over(Window.partitionBy(*family)))
    by = Window.partitionBy(*family, "_ok").orderBy(p)
    step = out.withColumn("_k", F.row_number().over(by)).withColumn("_h", F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("_k") + 1)))
    upto = F.max("_h").over(by.rowsBetween(Window.unboundedPreceding, 0))
    ties = Window.partitionBy(*family, "_ok", p)  # equal p-values share the largest of theirs
    step = step.withColumn("_u", upto).withColumn("_u", F.max("_u").over(ties))
    return step.select(*tests.columns, "m", F.when(F.col("_ok"), F.least(F.lit(1.0), F.col(p) * F.col("m"))).alias("bonferroni"), F.when(F.col("_ok"), F.col("_u")).alias("holm"))


def rank_frequencies(df: DataFrame, run: str, item: str, value: str) -> DataFrame:
    """item, position, n: how often each item takes each position; unique ranks by (value, item), nulls last as infinite."""
    pos = F.row_number().over(Window.partitionBy(run).orderBy(F.coalesce(value, F.lit(float("inf"))), item))
    return df.select(item, pos.alias("position")).groupBy(item, "position").agg(F.count("*").alias("n"))


def summary(df: DataFrame, *values: str) -> DataFrame:
    """metric, mean, p05, p95, sd, n of each value over known rows: one aggregate, then a stack."""
    aggs = [x for v in values for x in (F.avg(v).alias(f"{v}__m"), F.percentile(v, 0.05).alias(f"{v}__l"), F.percentile(v, 0.95).alias(f"{v}__h"), F.stddev_samp(v).alias(f"{v}__s"), F.count(v).alias(f"{v}__n"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"{v}__m").alias("mean"), F.col(f"{v}__l").alias("p05"), F.col(f"{v}__h").alias("p95"), F.col(f"{v}__s").alias("sd"), F.col(f"{v}__n").alias("n")) for v in values])
    return one.select(F.explode(rows).alias("r")).select("r.*")
