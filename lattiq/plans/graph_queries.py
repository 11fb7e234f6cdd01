"""Queries over spot and compartment graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import r6
from ..operators import community as CM
from ..operators import graph as G
from ..session import cut
from ..sources.testdata import compartments, spots, trade_graph
from .catalog import COMPS, EDGES, GRAPH, SPOTS, WSP, adj, ctes, nn, query, values


def spot_graph(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    return cut(G.gaussian_graph(G.knn(spots(spark, sf_dir), k)), "graph")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots with radial zones and compartments macro_zone; i is the spot."""
    z = G.radial_zones(spots(spark, sf_dir))
    return cut(z.select(F.col("spot").alias("i"), "spot", "x", "y", "macro", "dist", "zone", F.concat_ws("_", "macro", "zone").alias("comp")), "labelled")


COARSE = "n AS (SELECT comp, count(*) AS n FROM lab GROUP BY 1), cg AS (SELECT a.comp AS ca, b.comp AS cb, sum(w) AS s, count(*) AS m FROM wsp JOIN lab a ON a.i = wsp.i JOIN lab b ON b.i = wsp.j GROUP BY 1, 2)"


@query(ctes(GRAPH, COARSE) + "SELECT ca, cb, round(s / (x.n * y.n), 6) AS w FROM cg JOIN n x ON x.comp = ca JOIN n y ON y.comp = cb WHERE ca <> cb")
def flagship_compartment_graph(spark, sf_dir):
    """Spots, nearest neighbours, Gaussian weights, radial zones, averaged compartment graph."""
    return G.coarse_grain(spot_graph(spark, sf_dir), labelled(spark, sf_dir), "avg").select("ca", "cb", r6("w"))


@query(ctes(SPOTS, nn()) + "SELECT i, j, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INTEGER) AS rank FROM nn")
def knn_graph(spark, sf_dir):
    return G.knn(spots(spark, sf_dir), 6).select("i", "j", r6("d"), "rank")


@query(ctes(SPOTS, nn(), WSP) + "SELECT i, j, round(w, 6) AS w FROM wsp")
def gaussian_edges(spark, sf_dir):
    return spot_graph(spark, sf_dir).select("i", "j", r6("w"))


@query(ctes(SPOTS) + "SELECT a.spot, round(avg(CAST(b.embedding[3] AS DOUBLE)), 6) AS smooth, count(*) AS n FROM spots a JOIN spots b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0004 GROUP BY 1")
def radius_smooth(spark, sf_dir):
    """Mean of a gene over all spots within a radius, self included."""
    s = spots(spark, sf_dir)
    gene = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("j"), F.col("embedding")[2].cast("double").alias("v"))
    near = G.within_radius(s, s, 0.02)
    return near.join(gene, "j").groupBy(F.col("i").alias("spot")).agg(F.round(F.avg("v"), 6).alias("smooth"), F.count("*").alias("n"))


@query(ctes(SPOTS, nn()) + "SELECT i, round(sum(w), 6) AS deg, count(*) AS n FROM (SELECT i, j, sum(w) / 2 AS w FROM (SELECT i, j, 1.0 AS w FROM nn UNION ALL SELECT j, i, 1.0 FROM nn) GROUP BY 1, 2) GROUP BY 1")
def sym_adjacency_degree(spark, sf_dir):
    e = G.symmetric_mean(G.knn(spots(spark, sf_dir), 6).select("i", "j", F.lit(1.0).alias("w")))
    return G.degrees(e).select("i", r6("deg"), "n")


BOUNDARY = "deg AS (SELECT i, sum(w) AS deg FROM wsp GROUP BY 1), bnd AS (SELECT i, deg, deg <= (SELECT quantile_cont(deg, 0.1) FROM deg) AS is_boundary FROM deg)"


@query(ctes(SPOTS, nn(), WSP, BOUNDARY) + "SELECT i, round(deg, 6) AS deg, is_boundary FROM bnd")
def boundary_quantile(spark, sf_dir):
    return G.boundary_nodes(spot_graph(spark, sf_dir)).select("i", r6("deg"), "is_boundary")


#: A round holds the last level (hops = k) and the one before it; on edges in both directions no other node next to the last level was seen. It ends where a level is empty.
HOPS = "hops(i, hops, k) AS (SELECT i, 0, 0 FROM bnd WHERE is_boundary UNION ALL (SELECT i, hops, k + 1 FROM hops WHERE hops = k UNION ALL SELECT DISTINCT wsp.j, k + 1, k + 1 FROM hops JOIN wsp ON wsp.i = hops.i WHERE hops = k AND wsp.j NOT IN (SELECT i FROM hops))), hop AS (SELECT i, min(hops) AS hops FROM hops GROUP BY 1)"


def _hops(spark, sf_dir):
    e = spot_graph(spark, sf_dir)
    return e, G.hop_distance(e, G.boundary_nodes(e).where("is_boundary").select("i"))


@query(ctes(SPOTS, nn(), WSP, BOUNDARY, HOPS) + "SELECT i, hops FROM hop")
def hop_distance(spark, sf_dir):
    return _hops(spark, sf_dir)[1].select("i", "hops")


@query(ctes(SPOTS, nn(), WSP, BOUNDARY, HOPS) + "SELECT CAST(floor(hops) AS BIGINT) AS bin, round(avg(x), 6) AS mean_x, count(*) AS n FROM hop JOIN spots ON spot = i GROUP BY 1")
def profile_by_distance(spark, sf_dir):
    hops = _hops(spark, sf_dir)[1]
    v = hops.join(spots(spark, sf_dir).select(F.col("spot").alias("i"), "x"), "i")
    return G.profile_by_distance(v, "hops", "x").select("bin", r6("mean_x"), "n")


P = "p AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM edges)"
WALK = "x0 AS (SELECT node AS i, CASE WHEN is_boundary THEN CAST(1 AS DOUBLE) ELSE 0 END AS x FROM comps), wk(k, i, x) AS (SELECT 0, i, x FROM x0 UNION ALL SELECT any_value(wk.k) + 1, p.i, sum(p.w * wk.x) FROM wk JOIN p ON p.j = wk.i WHERE wk.k < {steps} GROUP BY p.i)"


@query(ctes(COMPS, EDGES, P, WALK.format(steps=5)) + "SELECT i, round(x, 6) AS x FROM wk WHERE k = 5")
def random_walk_t(spark, sf_dir):
    x0 = compartments(spark, sf_dir).select(F.col("node").alias("i"), F.col("is_boundary").cast("double").alias("x"))
    p = G.row_stochastic(trade_graph(spark, sf_dir)).cache()
    return G.random_walk(x0, p, 5).select("i", r6("x"))


@query(ctes(COMPS, EDGES, P, WALK.format(steps=10)) + """, tg AS (SELECT j AS i, s / (max(s) OVER () + 1e-12) AS s FROM (SELECT j, sum(w) AS s FROM p GROUP BY 1)),
sc AS (SELECT k, i, x / (max(x) OVER (PARTITION BY k) + 1e-12) AS x FROM wk WHERE k % 5 = 0),
er AS (SELECT k, avg((x - coalesce(s, 0)) * (x - coalesce(s, 0))) AS e FROM sc LEFT JOIN tg USING (i) GROUP BY 1),
e2 AS (SELECT k, CASE WHEN k = 0 AND e = min(e) OVER () THEN 1e9 ELSE e END AS e FROM er)
SELECT k AS step, round(e, 6) AS error, row_number() OVER (ORDER BY e, k) = 1 AS best FROM e2""")
def optimal_t(spark, sf_dir):
    x0 = compartments(spark, sf_dir).select(F.col("node").alias("i"), F.col("is_boundary").cast("double").alias("x"))
    p = G.row_stochastic(trade_graph(spark, sf_dir)).cache()
    e = G.walk_errors(x0, p, 10, 5)
    return e.select("step", F.when(F.col("error") == float("inf"), 1e9).otherwise(F.round("error", 6)).alias("error"), "best")


@query(ctes(GRAPH, COARSE) + "SELECT ca, cb, round(s, 6) AS w FROM cg WHERE ca <> cb")
def coarse_none(spark, sf_dir):
    return G.coarse_grain(spot_graph(spark, sf_dir), labelled(spark, sf_dir), "none").select("ca", "cb", r6("w"))


@query(ctes(GRAPH, COARSE) + "SELECT ca, cb, round(s / m, 6) AS w FROM cg")
def coarse_edges(spark, sf_dir):
    """Mean over existing edges only, the diagonal kept."""
    return G.coarse_grain(spot_graph(spark, sf_dir), labelled(spark, sf_dir), "edges", True).select("ca", "cb", r6("w"))


@query(ctes(GRAPH) + "SELECT a.comp AS ca, b.comp AS cb, round(sum(w), 6) AS w FROM (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM wsp) e JOIN lab a ON a.i = e.i JOIN lab b ON b.i = e.j WHERE a.comp <> b.comp GROUP BY 1, 2")
def coarse_rw(spark, sf_dir):
    return G.coarse_grain(spot_graph(spark, sf_dir), labelled(spark, sf_dir), "rw").select("ca", "cb", r6("w"))


@query(ctes(COMPS, EDGES, adj()) + "SELECT i, j, round(l, 6) AS l FROM adj")
def laplacian_sym(spark, sf_dir):
    return G.adjacency(trade_graph(spark, sf_dir), "sym").select("i", "j", r6("l"))


@query(ctes(COMPS, EDGES, adj()) + "SELECT i, j, round(wt, 6) AS wt FROM adj WHERE i <> j")
def w_tilde(spark, sf_dir):
    return G.adjacency(trade_graph(spark, sf_dir), "sym").where("i <> j").select("i", "j", r6("wt"))


@query(ctes(COMPS, EDGES) + ", d AS (SELECT i, sum(w) AS deg FROM edges GROUP BY 1) SELECT e.i, e.j, round(w / deg, 6) AS wt, round(-w, 6) AS l FROM edges e JOIN d USING (i) UNION ALL SELECT i, i, 0, round(deg, 6) FROM d")
def laplacian_raw(spark, sf_dir):
    return G.adjacency(trade_graph(spark, sf_dir), "raw").select("i", "j", r6("wt"), r6("l"))


CC = "lk AS (SELECT DISTINCT wsp.i, wsp.j FROM wsp JOIN lab a ON a.i = wsp.i JOIN lab b ON b.i = wsp.j WHERE a.comp = b.comp), cc(i, c) AS (SELECT i, i FROM lab UNION SELECT lk.j, cc.c FROM cc JOIN lk ON lk.i = cc.i WHERE cc.c < lk.j), comp1 AS (SELECT i, min(c) AS component FROM cc GROUP BY 1)"


@query(ctes(GRAPH, CC) + "SELECT i, component FROM comp1")
def connected_components(spark, sf_dir):
    """Components of each compartment's own graph."""
    lab = labelled(spark, sf_dir)
    e = spot_graph(spark, sf_dir)
    inner = e.join(lab.select("i", "comp"), "i").join(lab.select(F.col("i").alias("j"), F.col("comp").alias("cj")), "j").where("comp = cj")
    return G.connected_labels(inner.select("i", "j"), lab)


@query(ctes(GRAPH, CC) + """, sz AS (SELECT comp, component, count(*) AS n FROM comp1 JOIN lab USING (i) GROUP BY 1, 2 HAVING count(*) >= 5),
nm AS (SELECT comp, component, comp || '_cc' || (row_number() OVER (PARTITION BY comp ORDER BY n DESC, component) - 1) AS part FROM sz)
SELECT i, lab.comp, coalesce(part, lab.comp) AS part FROM comp1 JOIN lab USING (i) LEFT JOIN nm ON nm.comp = lab.comp AND nm.component = comp1.component""")
def split_components(spark, sf_dir):
    return G.split_components(spot_graph(spark, sf_dir), labelled(spark, sf_dir), 5)


@query(ctes(GRAPH) + "SELECT macro, node, count(*) AS deg FROM (SELECT a.macro, wsp.i, wsp.j FROM wsp JOIN lab a ON a.i = wsp.i JOIN lab b ON b.i = wsp.j WHERE w > 1e-4 AND wsp.i < wsp.j AND a.macro = b.macro) e, LATERAL (SELECT unnest([i, j]) AS node) GROUP BY 1, 2")
def induced_degree(spark, sf_dir):
    """Degree of each spot within its macro type's induced graph, for every macro type."""
    e = G.induced_by(spot_graph(spark, sf_dir), labelled(spark, sf_dir), "macro")
    return e.select("macro", F.explode(F.array("i", "j")).alias("node")).groupBy("macro", "node").agg(F.count("*").alias("deg"))


TOPO = values(dims.TOPOLOGY, "topo", "ma, mb")
LAYER_COMPS = ", ".join([values([(k, v[2]) for k, v in dims.MACRO_RATES.items()], "mdd", "macro, d_d"), "lc AS (SELECT comp, macro, d_d, count(*) AS n FROM lab JOIN mdd USING (macro) GROUP BY 1, 2, 3)"])
INTER = "fx AS (SELECT a.comp AS ca, b.comp AS cb, sum(w) AS flux FROM wsp JOIN lab a ON a.i = wsp.i JOIN lab b ON b.i = wsp.j GROUP BY 1, 2), iw AS (SELECT ca, cb, x.macro AS ma, y.macro AS mb, 0.05 * flux / greatest(sqrt(x.n * y.n), 1) * sqrt(x.d_d * y.d_d) AS w FROM fx JOIN lc x ON x.comp = ca JOIN lc y ON y.comp = cb JOIN topo ON topo.ma = x.macro AND topo.mb = y.macro WHERE flux > 0), coup AS (SELECT ca, cb, ma, mb, w FROM iw UNION ALL SELECT cb, ca, mb, ma, w FROM iw)"


def coupling(spark, sf_dir, d_inter=0.05):
    lab = labelled(spark, sf_dir)
    comps = lab.select("comp", "macro").distinct().join(dims.macro_rates(spark).select("macro", "d_d"), "macro")
    topo = spark.createDataFrame(list(dims.TOPOLOGY), "ma string, mb string")
    return comps, G.interlayer(spot_graph(spark, sf_dir), lab, comps, topo, d_inter)


@query(ctes(GRAPH, TOPO, LAYER_COMPS, INTER) + "SELECT ca, cb, ma, mb, round(w, 6) AS w FROM coup")
def interlayer_coupling(spark, sf_dir):
    return coupling(spark, sf_dir)[1].select("ca", "cb", "ma", "mb", r6("w"))


@query(ctes(GRAPH, TOPO, LAYER_COMPS, INTER) + ", nl AS (SELECT macro, count(*) AS n FROM lc GROUP BY 1) SELECT ma, mb, round(sum(w) / greatest(sqrt(any_value(x.n) * any_value(y.n)), 1), 6) AS w FROM coup JOIN nl x ON x.macro = ma JOIN nl y ON y.macro = mb GROUP BY 1, 2")
def interlayer_summary(spark, sf_dir):
    comps, c = coupling(spark, sf_dir)
    return G.interlayer_summary(c, comps).select("ma", "mb", r6("w"))


@query(ctes(GRAPH) + "SELECT spot, round(dist, 6) AS dist, zone FROM lab")
def radial_zones(spark, sf_dir):
    return labelled(spark, sf_dir).select("spot", r6("dist"), "zone")


@query(ctes(GRAPH) + "SELECT comp, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM lab GROUP BY 1")
def compartment_centroids(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("comp").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))


@query(ctes(COMPS, EDGES) + "SELECT CASE WHEN a.macro = b.macro THEN 'intra_' || a.macro ELSE 'inter_' || least(a.macro, b.macro) || '_' || greatest(a.macro, b.macro) END AS edge_class, count(*) AS n, round(sum(w), 6) AS total FROM edges JOIN comps a ON a.node = i JOIN comps b ON b.node = j WHERE i < j GROUP BY 1")
def edge_class_summary(spark, sf_dir):
    c = compartments(spark, sf_dir)
    e = trade_graph(spark, sf_dir).where("i < j").join(c.select(F.col("node").alias("i"), F.col("macro").alias("a")), "i").join(c.select(F.col("node").alias("j"), F.col("macro").alias("b")), "j")
    return e.groupBy(G.edge_class("a", "b").alias("edge_class")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("total"))


@query()
def spot_communities(spark, sf_dir):
    """Communities of the spot graph by modularity; SQL has no such iteration, tests hold it against plain Python."""
    e = spot_graph(spark, sf_dir)
    return CM.communities(e, spots(spark, sf_dir).select(F.col("spot").alias("i")))
