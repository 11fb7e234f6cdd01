"""Row-level preprocessing, annotation and label transfer over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import ZONES
from ..session import cut


def map_with_default(df: DataFrame, dim: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """df with column value from the dimension (key, value), the default where the key is unknown."""
    return df.join(F.broadcast(dim), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def cell_state(label: str):
    """cycling, stress, immune or baseline from a label's words."""
    low = F.lower(F.col(label))
    return F.when(low.rlike("prolif|cycling|mitotic"), "cycling").when(low.rlike("stress|injur|damage"), "stress").when(low.rlike("macrophage|t_cell|b_cell|immune|neutro"), "immune").otherwise("baseline")


def normalise_log1p(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """spot, gene, value = log(1 + target * count / library size); genes without counts are left out."""
    keep = expr.groupBy("gene").agg(F.sum("count").alias("n")).where("n >= 1").select("gene")
    e = expr.join(keep, "gene", "left_semi")
    lib = F.sum("count").over(Window.partitionBy("spot"))
    return e.select("spot", "gene", F.log1p(F.coalesce(F.try_divide(F.col("count") * target, lib), F.lit(0.0))).alias("value"))


def scaled(values: DataFrame, n_spots: int, limit: float = 10.0) -> DataFrame:
    """spot, gene, value in standard deviations of the gene over n_spots spots, cut at limit; constant genes give 0."""
    s = values.groupBy("gene").agg((F.sum("value") / n_spots).alias("m"), F.sum(F.col("value") ** 2).alias("ss"))
    s = s.select("gene", "m", F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - n_spots * F.col("m") ** 2) / (n_spots - 1))).alias("sd"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("sd")), F.lit(0.0))
    return values.join(F.broadcast(s), "gene").select("spot", "gene", F.least(z, F.lit(limit)).alias("value"))


def marker_scores(values: DataFrame, markers: DataFrame) -> DataFrame:
    """spot, zone, score: mean of the zone's markers minus the spot's mean over all genes."""
    every = values.groupBy("spot").agg(F.avg("value").alias("m"))
    own = values.join(F.broadcast(markers), "gene").groupBy("spot", "zone").agg(F.avg("value").alias("s"))
    return own.join(every, "spot").select("spot", "zone", (F.col("s") - F.col("m")).alias("score"))


def cluster_labels(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, zone: the label with the largest mean score in each cluster, the first by name on ties. clusters has spot, cluster."""
    m = scores.join(clusters, "spot").groupBy("cluster", "zone").agg(F.avg("score").alias("s"))
    k = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("s"), "zone"))
    return m.withColumn("k", k).where("k = 1").select("cluster", "zone")


def variable_genes(values: DataFrame, n_spots: int, top: int, bins: int = 20) -> DataFrame:
    """The top genes by dispersion (variance over mean), standardised within bins of equal width of the mean.

    values is sparse or dense over n_spots spots; bins with one gene give it a standardised dispersion of 0.
    """
    g = values.groupBy("gene").agg((F.sum("value") / n_spots).alias("mean"), F.sum(F.col("value") ** 2).alias("ss"))
    g = g.withColumn("var", (F.col("ss") - n_spots * F.col("mean") ** 2) / (n_spots - 1)).withColumn("disp", F.try_divide("var", "mean")).where("disp is not null")
    every = Window.partitionBy()  # a row a gene
    width = (F.max("mean").over(every) - F.min("mean").over(every)) / bins
    g = g.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("mean") - F.min("mean").over(every), width), F.lit(0.0)))))
    by = Window.partitionBy("bin")
    z = F.coalesce(F.try_divide(F.col("disp") - F.avg("disp").over(by), F.stddev_samp("disp").over(by)), F.lit(0.0))
    return g.select("gene", "mean", "disp", z.alias("disp_norm")).orderBy(F.desc("disp_norm"), "gene").limit(top)


def zone_scores(values: DataFrame, markers: DataFrame) -> DataFrame:
    """spot, zone, score: mean of the zone's present markers, each scaled by its largest value. markers has zone, gene."""
    m = values.join(F.broadcast(markers), "gene")
    top = F.max("value").over(Window.partitionBy("gene"))
    return m.withColumn("v", F.coalesce(F.try_divide(F.col("value"), top), F.lit(0.0))).groupBy("spot", "zone").agg(F.avg("v").alias("score"))


def best_zone(scores: DataFrame, order: tuple[str, ...] = ZONES) -> DataFrame:
    """spot, zone, score: the zone of the largest score, the first in order on ties; null where no score is above 0."""
    place = F.array_position(F.array(*[F.lit(z) for z in order]), F.col("zone"))
    g = scores.groupBy("spot").agg(F.max_by("zone", F.struct(F.col("score"), -place)).alias("zone"), F.max("score").alias("score"))
    return g.select("spot", F.when(F.col("score") > 0, F.col("zone")).alias("zone"), "score")


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """i, label, share: majority of the neighbours' labels, the smallest label on ties. labels has j, label."""
    c = neighbours.join(labels, "j").groupBy("i", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("i"))
    r = c.select("i", "label", (F.col("n") / total).alias("share"), F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "label")).alias("k"))
    return r.where("k = 1").select("i", "label", "share")


def _shares(df: DataFrame, key: str, name: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count("*").alias("n"))
    return g.select(key, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))


def kl_shared(a: DataFrame, b: DataFrame, key: str, eps: float = 1e-9) -> DataFrame:
    """KL divergence of a's label shares from b's over the labels of both; eps in the denominator."""
    return _shares(a, key, "p").join(_shares(b, key, "q"), key).agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("q") + eps))).alias("kl"))


def kl_union(a: DataFrame, b: DataFrame, key: str, eps: float = 1e-9) -> DataFrame:
    """KL divergence over the labels of either, missing shares as eps, both scaled to sum to 1 again."""
    u = _shares(a, key, "p").join(_shares(b, key, "q"), key, "full_outer").select(F.coalesce("p", F.lit(eps)).alias("p"), F.coalesce("q", F.lit(eps)).alias("q"))
    every = Window.partitionBy()
    u = u.select((F.col("p") / F.sum("p").over(every)).alias("p"), (F.col("q") / F.sum("q").over(every)).alias("q"))
    return u.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def macro_argmax(abundance: DataFrame) -> DataFrame:
    """spot, macro, label: the macro type with the largest summed abundance, then the type of the largest abundance in it."""
    s = abundance.withColumn("m", F.sum("value").over(Window.partitionBy("spot", "macro")))
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("spot").orderBy(F.desc("m"), "macro", F.desc("value"), "label")))
    return r.where("k = 1").select("spot", "macro", "label")


def row_entropy(abundance: DataFrame) -> DataFrame:
    """spot, entropy of the shares of abundance."""
    p = abundance.withColumn("p", F.coalesce(F.try_divide("value", F.sum("value").over(Window.partitionBy("spot"))), F.lit(0.0)))
    return p.groupBy("spot").agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-12)).alias("entropy"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: concordance, ari (adjusted Rand index) and nmi (arithmetic mean) from the contingency table of a and b."""
    n2 = lambda c: F.col(c) * (F.col(c) - 1) / 2
    t = cut(pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n")), "contingency")
    ra, rb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    total = t.agg(F.sum("n").alias("tot"), F.sum(n2("n")).alias("sij"), F.sum(F.when(F.col("a").cast("string") == F.col("b").cast("string"), F.col("n")).otherwise(0.0)).alias("same"))
    ea = ra.crossJoin(F.broadcast(total.select("tot"))).agg(F.sum(n2("na")).alias("sa"), F.sum(-F.col("na") / F.col("tot") * F.log(F.col("na") / F.col("tot"))).alias("ha"))
    eb = rb.crossJoin(F.broadcast(total.select("tot"))).agg(F.sum(n2("nb")).alias("sb"), F.sum(-F.col("nb") / F.col("tot") * F.log(F.col("nb") / F.col("tot"))).alias("hb"))
    mi = t.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(total.select("tot"))).agg(F.sum(F.col("n") / F.col("tot") * F.log(F.col("n") * F.col("tot") / (F.col("na") * F.col("nb")))).alias("mi"))
    one = total.crossJoin(ea).crossJoin(eb).crossJoin(mi)  # one row each
    expected = F.col("sa") * F.col("sb") / (F.col("tot") * (F.col("tot") - 1) / 2)
    ari = F.coalesce(F.try_divide(F.col("sij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0))
    return one.select((F.col("same") / F.col("tot")).alias("concordance"), ari.alias("ari"), F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"))


def consensus(df: DataFrame, a: str, b: str, c: str):
    """df with consensus: what at least two of three annotators say, else the first."""
    return df.withColumn("consensus", F.when(F.col(a) == F.col(b), F.col(a)).when(F.col(a) == F.col(c), F.col(a)).when(F.col(b) == F.col(c), F.col(b)).otherwise(F.col(a)))


def unmapped(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Labels without an entry in the dimension, with their counts."""
    return df.join(F.broadcast(dim.select(key)), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def evaluable(labels: DataFrame, required: tuple[str, ...], least: int, sample: str = "sample", macro: str = "macro") -> DataFrame:
    """sample, ok: whether each required macro type has at least that many spots."""
    g = labels.where(F.col(macro).isin(*required)).groupBy(sample, macro).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    have = g.groupBy(sample).agg(F.count("*").alias("k"))
    return labels.select(sample).distinct().join(have, sample, "left").select(sample, (F.coalesce("k", F.lit(0)) == len(required)).alias("ok"))


def project(wide: DataFrame, features: list[str], k: int, id_col: str = "spot"):
    """Standard scaling and PCA fitted on wide: id and pc0..pc(k-1), and the fitted model to apply to other samples."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(withMean=True, inputCol="_v", outputCol="_s"), PCA(k=k, inputCol="_s", outputCol="_p")]).fit(wide)
    out = model.transform(wide).select(id_col, vector_to_array("_p").alias("p"))
    return out.select(id_col, *[F.col("p")[i].alias(f"pc{i}") for i in range(k)]), model
