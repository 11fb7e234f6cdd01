"""Many samples in one plan: each operator takes a sample column and treats every sample as a table of its own.

A sample may hold any share of the rows: sums are taken per task before they are shuffled, by (sample, feature) or
(sample, unit), and windows run over features, never over the rows of a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lot_of(row: str) -> Column:
    """The partition that monotonically_increasing_id gave a row in."""
    return F.shiftright(row, 33).cast("int")


def rare_places(units: DataFrame, least_units: int) -> DataFrame:
    """row, rare: the places (from 0) in a unit's features of those that occur in fewer than least_units units of all
    samples; units without any are absent.

    units has row (a number of its own each) and features (without repeats, joined by blanks). A feature of one or two units is found with its
    places by one sum over features, so that only sums are shuffled; larger bounds need the rows of those features.
    """
    words = units.where("features <> ''").select("row", F.posexplode(F.split("features", " ")).alias("pos", "feature"))
    n = F.count("*").alias("n")
    if least_units <= 3:
        ends = [F.min("row").alias("r0"), F.min_by("pos", "row").alias("p0"), F.max("row").alias("r1"), F.max_by("pos", "row").alias("p1")]
        g = words.groupBy("feature").agg(n, *ends).where(F.col("n") < least_units)
        one, two = (F.struct(F.col(f"r{k}").alias("row"), F.col(f"p{k}").alias("pos")) for k in (0, 1))
        places = g.select(F.inline(F.when(F.col("n") == 1, F.array(one)).otherwise(F.array(one, two))))
    else:
        few = words.groupBy("feature").agg(n).where(F.col("n") < least_units).select("feature")
        places = words.join(few.hint("shuffle_hash"), "feature", "left_semi")
    return places.groupBy("row").agg(F.collect_list("pos").alias("rare"))


def without_rare(units: DataFrame, rare: DataFrame, lots: int) -> DataFrame:
    """units (row, counts, total and more) with rare, and with n_left and total_left, the features and counts left;
    features, where units have them, as an array.

    row is of monotonically_increasing_id, whose upper bits are the lot (from 0) that a unit came from. Both tables are
    shuffled once, by lot, so that a task holds what one lot held; a unit's two rows meet in a window, and no side is
    broadcast.
    """
    both = units.unionByName(rare.withColumnRenamed("rare", "_rare"), allowMissingColumns=True)
    both = both.withColumn("lot", lot_of("row")).repartitionById(max(lots, 1), F.col("lot"))
    if "features" in units.columns:  # split here, where the window's sort keeps the array; later it would be split anew for each word
        both = both.withColumn("features", F.split("features", " "))
    found = F.max("_rare").over(Window.partitionBy("lot", "row"))
    u = both.withColumn("rare", F.coalesce(found, F.array().cast("array<int>"))).where("counts is not null").drop("_rare", "lot")
    lost = F.aggregate("rare", F.lit(0).cast("long"), lambda s, p: s + F.get("counts", p))
    return u.withColumn("n_left", (F.size("counts") - F.size("rare")).cast("long")).withColumn("total_left", F.col("total") - lost)


def normalise(units: DataFrame, target: float = 1e4) -> DataFrame:
    """unit, feature, count, value, sample of the units that without_rare returns; value = log(1 + target * count / the
    unit's total of what is left)."""
    places = F.array_except(F.sequence(F.lit(0), F.size("counts") - 1), "rare")
    left = units.where("n_left > 0").select("sample", "unit", "features", "counts", "total_left", F.explode(places).alias("p"))
    left = left.select("unit", F.get("features", F.col("p")).alias("feature"), F.get("counts", F.col("p")).alias("count"), "total_left", "sample")
    v = F.log1p(F.coalesce(F.try_divide(F.col("count") * target, "total_left"), F.lit(0.0)))
    return left.select("unit", "feature", "count", v.alias("value"), "sample")


def sizes(units: DataFrame) -> DataFrame:
    """sample, n_units from the table of units (sample, unit), units without any feature included."""
    return units.groupBy("sample").agg(F.count("*").alias("n_units"))


def feature_moments(values: DataFrame, n_units: DataFrame) -> DataFrame:
    """sample, feature, n_found, mean, var (units without the feature count as 0), dispersion = var / mean."""
    g = values.groupBy("sample", "feature").agg(F.count("*").alias("n_found"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"))
    g = g.join(n_units, "sample")  # Spark broadcasts it where it is small
    mean = F.col("s") / F.col("n_units")
    var = F.try_divide(F.col("ss") - F.col("n_units") * mean**2, F.col("n_units") - 1)
    g = g.select("sample", "feature", "n_found", mean.alias("mean"), F.greatest(var, F.lit(0.0)).alias("var"))
    return g.withColumn("dispersion", F.try_divide("var", "mean"))


def variable_features(moments: DataFrame, top: int, bins: int = 20, few: bool = False) -> DataFrame:
    """The top features of each sample by dispersion, standardised within bins of equal width of the sample's means.

    Ranks are by the standardised dispersion to nine digits, then by name; a bin of one feature gives it 0. A sample's
    bins come from its smallest and largest mean, joined as a row a sample, and a bin's moments as a row a bin; the
    last ranking keeps top rows a task before the shuffle (a window group limit). few: broadcast both, so that the
    features aren't shuffled to meet them.
    """
    side = F.broadcast if few else lambda df: df
    m = moments.where("dispersion is not null")
    ends = m.groupBy("sample").agg(F.min("mean").alias("low"), ((F.max("mean") - F.min("mean")) / bins).alias("width"))
    m = m.join(side(ends), "sample")
    m = m.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("mean") - F.col("low"), F.col("width")), F.lit(0.0)))))
    by_bin = m.groupBy("sample", "bin").agg(F.avg("dispersion").alias("bm"), F.stddev_samp("dispersion").alias("bs"))
    z = F.coalesce(F.try_divide(F.col("dispersion") - F.col("bm"), F.col("bs")), F.lit(0.0))
    m = m.join(side(by_bin), ["sample", "bin"]).select("sample", "feature", "n_found", "mean", "dispersion", F.round(z, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("score"), "feature"))
    return m.withColumn("rank", rank).where(F.col("rank") <= top)


def summary(units: DataFrame, n_units: DataFrame, features: DataFrame) -> DataFrame:
    """A row a sample: n_units, n_empty (units without a feature), n_features, total, mean features and counts a unit.
    units: a row a unit, with n_left and total_left; features: a row for each (sample, feature)."""
    u = units.where("n_left > 0").groupBy("sample").agg(F.count("*").alias("n_full"), F.sum("n_left").alias("pairs"), F.sum("total_left").alias("total"), F.max("total_left").alias("largest"))
    f = features.groupBy("sample").agg(F.count("*").alias("n_features"))
    out = n_units.join(u, "sample", "left").join(f, "sample", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("sample", "n_units", (F.col("n_units") - zero(F.col("n_full"))).alias("n_empty"), zero(F.col("n_features")).alias("n_features"), zero(F.col("total")).alias("total"), zero(F.col("largest")).alias("largest"), (zero(F.col("pairs")) / F.col("n_units")).alias("mean_features"), (zero(F.col("total")) / F.col("n_units")).alias("mean_total"))
