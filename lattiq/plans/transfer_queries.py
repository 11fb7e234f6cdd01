"""Queries that carry labels from one table to another through the feature-space index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import annotate as A
from ..operators import feature_index as FI
from ..session import cut
from ..sources.testdata import table
from .catalog import query


def _activity(lines, key: str, amount: str):
    return lines.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.sum(amount).alias("s"))


def _features(balance: str):
    return F.array(F.col(balance), F.log1p(F.coalesce("n", F.lit(0)).cast("double")), F.log1p(F.coalesce("s", F.lit(0.0))))


def customers(spark, sf_dir):
    """i, v: balance and log counts and sums of a customer's orders."""
    own = _activity(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer")
    return c.join(own, c["c_custkey"] == own["k"], "left").select(F.col("c_custkey").alias("i"), _features("c_acctbal").alias("v"))


def suppliers(spark, sf_dir):
    """j, v, label: the same of a supplier's lines, and its region."""
    own = _activity(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")
    s = table(spark, sf_dir, "supplier")
    s = s.join(own, s["s_suppkey"] == own["k"], "left")
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("label"))
    return s.join(place, "s_nationkey").select(F.col("s_suppkey").alias("j"), _features("s_acctbal").alias("v"), "label")


TWO_SIDES = """WITH q AS (SELECT c_custkey AS i, c_acctbal AS a, ln(1 + coalesce(n, 0)) AS b, ln(1 + coalesce(s, 0)) AS c FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey),
r AS (SELECT s_suppkey AS j, s_acctbal AS a, ln(1 + coalesce(n, 0)) AS b, ln(1 + coalesce(s, 0)) AS c, r_name AS label FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT stddev_samp(a) AS sa, stddev_samp(b) AS sb, stddev_samp(c) AS sc FROM r),
nn AS (SELECT i, j, sqrt(((q.a - r.a) / sa) ** 2 + ((q.b - r.b) / sb) ** 2 + ((q.c - r.c) / sc) ** 2) AS d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM q, r, m QUALIFY rank <= 15)"""


@query(TWO_SIDES + """, v AS (SELECT i, label, count(*) AS n FROM nn JOIN r USING (j) GROUP BY 1, 2),
b AS (SELECT i, label, n / sum(n) OVER (PARTITION BY i) AS share, row_number() OVER (PARTITION BY i ORDER BY n DESC, label) AS t FROM v QUALIFY t = 1)
SELECT i AS c_custkey, label, round(share, 6) AS share, round(d, 6) AS nearest FROM b JOIN nn USING (i) WHERE rank = 1""")
def label_transfer_reference(spark, sf_dir):
    """Each customer's region as its 15 nearest suppliers have it, in the space scaled on the suppliers."""
    t = FI.transfer_labels(customers(spark, sf_dir), suppliers(spark, sf_dir), 15)
    return t.select(F.col("i").alias("c_custkey"), "label", r6("share"), r6("nearest"))


@query(TWO_SIDES + " SELECT i AS c_custkey, j AS s_suppkey, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 5")
def feature_neighbours(spark, sf_dir):
    """The five nearest suppliers of each customer in the suppliers' scaled space."""
    r = suppliers(spark, sf_dir)
    model = FI.fit_space(r)
    near = FI.nearest(FI.in_space(model, customers(spark, sf_dir)), FI.build(FI.in_space(model, r.select("j", "v")), 5))
    return near.select(F.col("i").alias("c_custkey"), F.col("j").alias("s_suppkey"), r6("d"), "rank")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nn AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY k <= 15),
g AS (SELECT vec_id, label, other, count(*) AS n FROM nn GROUP BY 1, 2, 3)
SELECT vec_id, label, other AS predicted, round(n / 15, 6) AS share FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, other) = 1""")
def label_transfer_loo(spark, sf_dir):
    """Each vector's label as its 15 nearest other vectors have it: how far labels follow the features."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    near = cut(FI.nearest(v, FI.build(v.withColumnRenamed("i", "j"), 16)).where("i <> j"), "others")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("rank"))
    others = near.withColumn("n", rank).where("n <= 15").select("i", "j")  # a vector's own row may not be among the 16
    own = e.select(F.col("vec_id").alias("i"), "label")
    voted = A.vote(others, own.withColumnRenamed("i", "j")).withColumnRenamed("label", "predicted")
    return voted.join(own, "i").select(F.col("i").alias("vec_id"), "label", "predicted", r6("share"))
