"""Exact order statistics and rank agreement over whole columns: no task ever holds a column, no pairs are made.

Values are counted first (summed per task before the shuffle), so a value that fills a third of the rows is one row; the
distinct values are then dealt to ranges. What a range holds is counted, and only the ranges that a statistic needs are
read again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _ranges(counted: DataFrame, *order: str) -> DataFrame:
    """counted in ranges of the columns order, with the number of its range as _part."""
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(counted.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def quantiles(df: DataFrame, value: str | Column, shares: list[float]) -> list[float | None]:
    """The exact quantiles of the known values (linear between neighbours), None for each where there are none.

    Two passes: counts of each range of distinct values, then a running count inside the ranges that hold the wanted
    ranks. NaN counts as the largest value.
    """
    v = F.col(value) if isinstance(value, str) else value
    counted = df.select(v.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    dealt = _ranges(counted, "v")
    sums = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.sum("n").alias("n")).collect())  # a row a range
    total = sum(n for _, n in sums)
    if not total:
        return [None] * len(shares)
    places = [(total - 1) * q for q in shares]
    wanted = sorted({int(np.floor(h)) for h in places} | {int(np.ceil(h)) for h in places})
    base, ends, parts = 0, {}, {}
    for part, n in sums:
        parts[part], base = base, base + n
        for w in wanted:
            if parts[part] <= w < base:
                ends.setdefault(part, []).append(w)
    own = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    some = dealt.where(F.col("_part").isin(list(ends)))
    upto = some.select("_part", "v", "n", F.sum("n").over(own).alias("upto"))
    hit = F.lit(False)
    for part, ranks in ends.items():
        for w in ranks:
            local = w - parts[part]
            hit = hit | ((F.col("_part") == part) & (F.col("upto") > local) & (F.col("upto") - F.col("n") <= local))
    found = {}
    for r in upto.where(hit).collect():  # at most two rows a share
        for w in ends[r["_part"]]:
            if r["upto"] - r["n"] <= w - parts[r["_part"]] < r["upto"]:
                found[w] = r["v"]
    out = []
    for h in places:
        low, high = found[int(np.floor(h))], found[int(np.ceil(h))]
        out.append(low if low == high else low + (high - low) * (h - np.floor(h)))
    return out


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs (i before k) with y[i] > y[k]; n log n, from the highest bit of the ranks of y down."""
    if not len(y):
        return 0
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        group = rank >> (bit + 1)
        o = np.argsort(group, kind="stable")
        w, one = weight[o], (rank[o] >> bit & 1).astype(bool)
        before = np.cumsum(np.where(one, w, 0))
        first = np.searchsorted(group[o], group[o])  # the start of each row's group
        base = np.where(first > 0, before[first - 1], 0)
        zero = ~one
        total += sum(int(a) * int(b) for a, b in zip(w[zero], (before - base)[zero], strict=True)) if before[-1] > 2**31 else int((w[zero] * (before - base)[zero]).sum())
    return total


def _splits(counted: DataFrame, column: str, n: int) -> np.ndarray:
    """About n ascending bounds of a column with counts n; a value that fills a whole share gets a range of its own."""
    q = [k / n for k in range(1, n)]
    cuts = counted.agg(F.percentile_approx(column, q, 10_000).alias("q") if n > 1 else F.array().alias("q")).first()["q"] or []
    values, times = np.unique(np.array(cuts, float), return_counts=True)
    heavy = values[times > 1]
    return np.unique(np.concatenate([values, heavy, np.nextafter(heavy, np.inf)]))


def kendall(df: DataFrame, x: str, y: str, buckets: int = 256) -> dict:
    """tau (tau-b, None where a side is constant) and pairs over the rows where both are known.

    Rows are summed by (x, y) and dealt to ranges of that order. A discordant pair is an inversion of y in it; it lies
    within one range (counted there), or in two ranges and one bucket of y (counted in the bucket, between ranges), or in
    two ranges and two buckets (from the table of counts by range and bucket, a few numbers). Ties of x are in ascending
    order of y, so they are no inversions; a y that fills a bucket alone has none in it, and its bucket isn't read.
    """
    counted = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    counted = cut(counted.groupBy("x", "y").agg(F.count("*").alias("n")), "pairs")
    ties = lambda *c: counted.groupBy(*c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs, tx, ty, both = n * (n - 1) // 2, int(ties("x")), int(ties("y")), int(ties("x", "y"))
    if pairs in (tx, ty):
        return {"tau": None, "pairs": pairs}
    bounds = _splits(counted, "y", buckets)

    def bucketed(batches):
        for pdf in batches:
            yield pdf.assign(bucket=np.searchsorted(bounds, pdf["y"].to_numpy(), side="right"))

    dealt = _ranges(counted, "x", "y").mapInPandas(bucketed, "x double, y double, n long, _part int, bucket long")
    dealt = cut(dealt, "buckets")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        return pd.DataFrame({"k": [str(inversions(pdf["y"].to_numpy(), pdf["n"].to_numpy()))]})

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_part", "y"])  # within a range y ascends here, so that only pairs of ranges count
        return pd.DataFrame({"k": [str(inversions(pdf["y"].to_numpy(), pdf["n"].to_numpy()))]})

    own = dealt.groupBy("_part").applyInPandas(inside, "k string")
    level = dealt.groupBy("bucket").agg((F.min("y") < F.max("y")).alias("mixed")).where("mixed").select("bucket")
    shared = dealt.join(F.broadcast(level), "bucket", "left_semi").groupBy("bucket").applyInPandas(between, "k string")  # at most 2 buckets + 1 rows
    discordant = sum(int(r["k"]) for r in own.unionByName(shared).collect())  # a row a range and a bucket
    table = dealt.groupBy("_part", "bucket").agg(F.sum("n").alias("n")).toPandas()  # ranges times buckets
    m = table.pivot(index="_part", columns="bucket", values="n").fillna(0).sort_index().sort_index(axis=1).to_numpy(float).astype(object)
    later = np.zeros(m.shape[1], object)  # counts of later ranges, by bucket
    for row in m[::-1]:
        below = np.concatenate([[0], np.cumsum(later)[:-1]])
        discordant += int((row * below).sum())
        later = later + row
    s = pairs - tx - ty + both - 2 * discordant
    return {"tau": s / ((pairs - tx) ** 0.5 * (pairs - ty) ** 0.5), "pairs": pairs}
