"""Queries of annotation, normalisation and label transfer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.columns import r6
from ..operators import annotate as A
from ..operators import graph as G
from ..sources.testdata import expression, spots, table
from .catalog import EXPR, SPOTS, ctes, nn, query, values

NAMES = [(0, "PT_S1"), (1, "PT_S2_injured"), (2, "DCT"), (3, "TAL"), (4, "endothelial"), (5, "macrophage"), (6, "PT_proliferating"), (7, "podocyte")]
NAMED = values(NAMES, "nm", "identity, name")


def _names(spark):
    return spark.createDataFrame(NAMES, "identity int, name string")


@query(ctes(SPOTS, NAMED) + "SELECT spot, coalesce(name, 'Unassigned') AS name FROM spots LEFT JOIN nm USING (identity)")
def annotate_map_default(spark, sf_dir):
    return A.map_with_default(spots(spark, sf_dir), _names(spark), "identity", "name", "Unassigned").select("spot", "name")


@query(ctes(SPOTS, NAMED) + "SELECT CASE WHEN regexp_matches(lower(n), 'prolif|cycling|mitotic') THEN 'cycling' WHEN regexp_matches(lower(n), 'stress|injur|damage') THEN 'stress' WHEN regexp_matches(lower(n), 'macrophage|t_cell|b_cell|immune|neutro') THEN 'immune' ELSE 'baseline' END AS state, count(*) AS n FROM (SELECT coalesce(name, 'Unassigned') AS n FROM spots LEFT JOIN nm USING (identity)) GROUP BY 1")
def state_case(spark, sf_dir):
    s = A.map_with_default(spots(spark, sf_dir), _names(spark), "identity", "name", "Unassigned")
    return s.groupBy(A.cell_state("name").alias("state")).agg(F.count("*").alias("n"))


@query(ctes(SPOTS, NAMED) + "SELECT identity, count(*) AS n FROM spots WHERE identity NOT IN (SELECT identity FROM nm) GROUP BY 1")
def unmapped_anti_join(spark, sf_dir):
    return A.unmapped(spots(spark, sf_dir), _names(spark), "identity")


NORM = "kg AS (SELECT gene FROM expr GROUP BY 1 HAVING sum(count) >= 1), norm AS (SELECT spot, gene, coalesce(ln(1 + count * 10000 / nullif(sum(count) OVER (PARTITION BY spot), 0)), 0) AS value FROM expr WHERE gene IN (SELECT gene FROM kg))"


@query(ctes(SPOTS, EXPR, NORM) + "SELECT spot, gene, round(value, 6) AS value FROM norm")
def normalize_log1p(spark, sf_dir):
    return A.normalise_log1p(expression(spark, sf_dir)).select("spot", "gene", r6("value"))


@query(ctes(SPOTS, EXPR, NORM) + """, gs AS (SELECT gene, avg(value) AS mean, var_samp(value) AS var FROM norm GROUP BY 1), gd AS (SELECT *, var / mean AS disp FROM gs WHERE mean <> 0),
gb AS (SELECT *, least(19, floor(coalesce((mean - min(mean) OVER ()) / nullif((max(mean) OVER () - min(mean) OVER ()) / 20, 0), 0))) AS bin FROM gd),
gz AS (SELECT gene, mean, disp, coalesce((disp - avg(disp) OVER (PARTITION BY bin)) / nullif(stddev_samp(disp) OVER (PARTITION BY bin), 0), 0) AS z FROM gb)
SELECT gene, round(mean, 6) AS mean, round(disp, 6) AS disp FROM gz ORDER BY round(z, 9) DESC, gene LIMIT 20""")
def hvg_topn(spark, sf_dir):
    v = A.normalise_log1p(expression(spark, sf_dir))
    return A.variable_genes(v, table(spark, sf_dir, "embeddings").count(), 20).select("gene", r6("mean"), r6("disp"))


MARKERS = [("inner_medulla", "g1"), ("inner_medulla", "g2"), ("inner_medulla", "g99"), ("outer_medulla", "g3"), ("outer_medulla", "g4"), ("cortex", "g5"), ("cortex", "g6"), ("cortex", "g7")]
ZONED = ", ".join([values(MARKERS, "mk", "zone, gene"), "zs AS (SELECT spot, zone, avg(v) AS score FROM (SELECT spot, zone, coalesce(value / nullif(max(value) OVER (PARTITION BY gene), 0), 0) AS v FROM norm JOIN mk USING (gene)) GROUP BY 1, 2)"])


@query(ctes(SPOTS, EXPR, NORM, ZONED) + "SELECT spot, CASE WHEN max(score) > 0 THEN first(zone ORDER BY score DESC, list_position(['inner_medulla', 'outer_medulla', 'cortex'], zone)) END AS zone, round(max(score), 6) AS score FROM zs GROUP BY 1")
def zone_score_argmax(spark, sf_dir):
    m = spark.createDataFrame(MARKERS, "zone string, gene string")
    return A.best_zone(A.zone_scores(A.normalise_log1p(expression(spark, sf_dir)), m)).select("spot", "zone", r6("score"))


VOTE = "vt AS (SELECT i, macro AS label, count(*) AS n FROM nn JOIN spots ON spot = j GROUP BY 1, 2), tr AS (SELECT i, label, n / sum(n) OVER (PARTITION BY i) AS share FROM vt QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, label) = 1)"


def _transfer(spark, sf_dir):
    s = spots(spark, sf_dir)
    return s, A.vote(G.knn(s, 15), s.select(F.col("spot").alias("j"), F.col("macro").alias("label")))


@query(ctes(SPOTS, nn(15), VOTE) + "SELECT i, label, round(share, 6) AS share FROM tr")
def label_transfer_knn(spark, sf_dir):
    return _transfer(spark, sf_dir)[1].select("i", "label", r6("share"))


SHARES = "pa AS (SELECT macro, count(*) / sum(count(*)) OVER () AS p FROM spots GROUP BY 1), pb AS (SELECT label AS macro, count(*) / sum(count(*)) OVER () AS q FROM tr GROUP BY 1)"


@query(ctes(SPOTS, nn(15), VOTE, SHARES) + "SELECT round(sum(p * ln(p / (q + 1e-9))), 6) AS kl FROM pa JOIN pb USING (macro)")
def transfer_kl_shared(spark, sf_dir):
    s, t = _transfer(spark, sf_dir)
    return A.kl_shared(s.select("macro"), t.select(F.col("label").alias("macro")), "macro").select(r6("kl"))


@query(ctes("a AS (SELECT c_nationkey AS k, count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) / sum(count(*)) OVER () AS q FROM supplier GROUP BY 1), u AS (SELECT coalesce(p, 1e-9) AS p, coalesce(q, 1e-9) AS q FROM a FULL JOIN b USING (k)), v AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM u)") + "SELECT round(sum(p * ln(p / q)), 6) AS kl FROM v")
def transfer_kl_union(spark, sf_dir):
    """Customers' nations against suppliers', of which the smaller tables miss some."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return A.kl_union(a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k").select(r6("kl"))


ABUND = "ab AS (SELECT spot, gene AS label, ['PT', 'DCT', 'TAL', 'vascular', 'immune', 'other'][CAST(substr(gene, 2) AS INTEGER) % 6 + 1] AS macro, count AS value FROM expr)"


def _abundance(spark, sf_dir):
    k = F.substring("gene", 2, 3).cast("int")
    macro = F.element_at(F.array(*[F.lit(m) for m in dims.MACROS]), k % 6 + 1)
    return expression(spark, sf_dir).select("spot", F.col("gene").alias("label"), macro.alias("macro"), F.col("count").alias("value"))


@query(ctes(SPOTS, EXPR, ABUND) + "SELECT spot, macro, label FROM (SELECT *, sum(value) OVER (PARTITION BY spot, macro) AS m FROM ab) QUALIFY row_number() OVER (PARTITION BY spot ORDER BY m DESC, macro, value DESC, label) = 1")
def macro_sum_argmax(spark, sf_dir):
    return A.macro_argmax(_abundance(spark, sf_dir))


@query(ctes(SPOTS, EXPR, ABUND) + "SELECT spot, round(sum(-p * ln(p + 1e-12)), 6) AS entropy FROM (SELECT spot, coalesce(value / nullif(sum(value) OVER (PARTITION BY spot), 0), 0) AS p FROM ab) GROUP BY 1")
def row_entropy(spark, sf_dir):
    return A.row_entropy(_abundance(spark, sf_dir)).select("spot", r6("entropy"))


AGREE = "pr AS (SELECT s.macro AS a, tr.label AS b FROM spots s JOIN tr ON tr.i = s.spot), ct AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM pr GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM ct GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM ct GROUP BY 1), tot AS (SELECT sum(n) AS tt FROM ct)"


@query(ctes(SPOTS, nn(15), VOTE, AGREE) + """SELECT round((SELECT sum(n) FROM ct WHERE a = b)/ tt, 6) AS concordance,
 round((sij - sa * sb / (tt * (tt - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (tt * (tt - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi
FROM tot, (SELECT sum(n * (n - 1) / 2) AS sij FROM ct), (SELECT sum(n * (n - 1) / 2) AS sa FROM ra), (SELECT sum(n * (n - 1) / 2) AS sb FROM rb),
 (SELECT sum(-n/ tt * ln(n/ tt)) AS ha FROM ra, tot), (SELECT sum(-n/ tt * ln(n/ tt)) AS hb FROM rb, tot), (SELECT sum(ct.n/ tt * ln(ct.n * tt / (ra.n * rb.n))) AS mi FROM ct JOIN ra USING (a) JOIN rb USING (b), tot)""")
def agreement_ari_nmi(spark, sf_dir):
    s, t = _transfer(spark, sf_dir)
    pairs = s.select(F.col("spot").alias("i"), "macro").join(t, "i")
    return A.agreement(pairs, "macro", "label").select(r6("concordance"), r6("ari"), r6("nmi"))


@query(ctes(SPOTS, nn(15), VOTE, EXPR, ABUND) + """, am AS (SELECT spot, macro FROM (SELECT *, sum(value) OVER (PARTITION BY spot, macro) AS m FROM ab) QUALIFY row_number() OVER (PARTITION BY spot ORDER BY m DESC, macro, value DESC, label) = 1)
SELECT s.spot, CASE WHEN s.macro = tr.label OR s.macro = am.macro THEN s.macro WHEN tr.label = am.macro THEN tr.label ELSE s.macro END AS consensus FROM spots s JOIN tr ON tr.i = s.spot JOIN am ON am.spot = s.spot""")
def consensus_vote(spark, sf_dir):
    s, t = _transfer(spark, sf_dir)
    third = A.macro_argmax(_abundance(spark, sf_dir)).select("spot", F.col("macro").alias("third"))
    both = s.select("spot", "macro").join(t.select(F.col("i").alias("spot"), "label"), "spot").join(third, "spot")
    return A.consensus(both, "macro", "label", "third").select("spot", "consensus")


@query("SELECT source AS sample, count(DISTINCT CASE WHEN n >= 8 THEN lang END) = 3 AS ok FROM (SELECT source, lang, count(*) FILTER (WHERE lang IN ('en', 'de', 'fr')) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def evaluability_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("sample"), F.col("lang").alias("macro"))
    return A.evaluable(d, ("en", "de", "fr"), 8)


@query(ctes(SPOTS, EXPR) + "SELECT macro, gene, round(avg(count), 4) AS mean FROM expr JOIN spots USING (spot) GROUP BY 1, 2")
def mean_by_group(spark, sf_dir):
    e = expression(spark, sf_dir).join(spots(spark, sf_dir).select("spot", "macro"), "spot")
    return e.groupBy("macro", "gene").agg(F.round(F.avg("count"), 4).alias("mean"))


@query("SELECT lower(p_name) AS name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1")
def lower_case_dedupe(spark, sf_dir):
    """First row of each name, case ignored."""
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), "p_partkey")
    return p.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("p_partkey"))).where("k = 1").drop("k")


@query()
def pca_project(spark, sf_dir):
    """Two principal components of all scaled genes; signs are the solver's, so absolute values."""
    genes = [f"g{k}" for k in range(62)]
    wide = A.normalise_log1p(expression(spark, sf_dir)).groupBy("spot").pivot("gene", genes).agg(F.first("value")).na.fill(0.0)
    out, _ = A.project(wide, genes, 2)
    return out.select("spot", F.round(F.abs("pc0"), 4).alias("pc0"), F.round(F.abs("pc1"), 4).alias("pc1"))
