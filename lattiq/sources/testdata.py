"""Domain frames from the driver tables: spots, compartments, a trade graph, observed trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_boundary
from ..functions.dims import MACROS, REGIONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spot, x, y, identity, macro: two dimensions of each vector are the place, the label is the cell identity."""
    v = table(spark, sf_dir, "embeddings")
    macro = F.element_at(F.array(*[F.lit(m) for m in MACROS]), (F.col("label") % len(MACROS) + 1).cast("int"))
    return v.select(F.col("vec_id").alias("spot"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("identity"), macro.alias("macro"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long expression matrix (spot, gene, count): the other dimensions' sizes as counts, 0 to about 50."""
    v = table(spark, sf_dir, "embeddings")
    long = v.select(F.col("vec_id").alias("spot"), F.posexplode(F.slice("embedding", 3, 62)).alias("gene", "value"))
    return long.select("spot", F.concat(F.lit("g"), F.col("gene")).alias("gene"), F.floor(F.abs(F.col("value").cast("double")) * 100).cast("double").alias("count"))


def compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, comp, macro, region, is_boundary: a compartment for each nation."""
    n = table(spark, sf_dir, "nation")
    macro = F.element_at(F.array(*[F.lit(m) for m in MACROS]), (F.col("n_nationkey") % len(MACROS) + 1).cast("int"))
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.col("n_regionkey") + 1).cast("int"))
    c = n.select(F.col("n_nationkey").cast("long").alias("node"), macro.alias("macro"), region.alias("region"))
    c = c.select("node", F.concat_ws("_", "macro", "region").alias("comp"), "macro", "region")
    return c.withColumn("is_boundary", is_boundary())


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed i, j, v: revenue between the customers' and the suppliers' nations.

    Orders get their customer's nation first, so the lines, the largest table, are shuffled once (by order) and summed
    by pair of nations before the last exchange; Spark broadcasts suppliers where that table is small.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("j"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("i"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "i")
    return line.join(supplier, "l_suppkey").join(orders, "l_orderkey").groupBy("i", "j").agg(F.sum("v").alias("v"))


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric compartment graph i, j, w (both directions, no self edges), largest directed sum scaled to 1."""
    t = trade(spark, sf_dir).where("i <> j")
    both = t.select("i", "j", "v").unionByName(t.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    top = F.max("w").over(_all())
    return both.groupBy("i", "j").agg((F.sum("v") / 2).alias("w")).withColumn("w", F.col("w") / top)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # one row a pair of compartments


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed trajectories node (0..14), t (days from 0), d (mean value, scaled to at most 1)."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    by = e.groupBy((F.col("user_id") % 15).alias("node"), day.alias("day")).agg(F.avg("value").alias("m"))
    lows = by.select("node", "day", "m", F.min("day").over(_all()).alias("d0"), F.max("m").over(_all()).alias("top"))
    return lows.select("node", (F.col("day") - F.col("d0")).cast("double").alias("t"), (F.col("m") / F.col("top")).alias("d"))
