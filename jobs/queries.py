"""The jobs as queries over the given tables: each runs twice into one new folder and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.session import fresh_folder

from . import sample_features, trajectory_feed


def job1_trajectory_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table with its node's trajectory in each row."""
    base = fresh_folder(spark, "job1")
    for _ in range(2):
        # as a pattern, since a file stream takes a single file only so; the table may be a file or a folder
        trajectory_feed.run(spark, f"{sf_dir}/event[s].parquet", f"{base}/out", f"{base}/checkpoint")
    r = lambda c: F.round(c, 6).alias(c)
    nodes = trajectory_feed.read_nodes(spark, f"{base}/out").select("node", "days", "first_day", "crossing", "peak_time", r("area"), r("highest"), r("last"))
    daily = trajectory_feed.read_daily(spark, f"{base}/out").select("day", "node", "n", r("mean"), r("low"), r("high"))
    return daily.join(nodes, "node", "left")


def job2_sample_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variable features of each sample with the sample's summary in each row; samples without features included."""
    out = f"{fresh_folder(spark, 'job2')}/out"
    for _ in range(2):
        sample_features.run(spark, f"{sf_dir}/documents.parquet", out)
    r = lambda c: F.round(c, 6).alias(c)
    summary = sample_features.read(spark, out, "summary").select("sample", "n_units", "n_empty", "n_features", "total", "largest", r("mean_features"), r("mean_total"))
    variable = sample_features.read(spark, out, "variable").select("sample", "rank", "feature", "n_found", r("mean"), r("dispersion"), r("score"))
    return summary.join(variable, "sample", "left")


QUERIES = {f.__name__: f for f in (job1_trajectory_feed, job2_sample_features)}

_PUNCTUATION = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"

ORACLES = {
    "job1_trajectory_feed": """
        WITH e AS (SELECT CAST(ts AS DATE) AS day, ((user_id % 15) + 15) % 15 AS node, value FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
        d AS (SELECT day, node, count(*) AS n, sum(value) / count(*) AS mean, min(value) AS low, max(value) AS high FROM e GROUP BY 1, 2),
        o AS (SELECT node, min(day) AS first_day, max(mean) AS top, count(*) AS days FROM d GROUP BY 1),
        t AS (SELECT node, date_diff('day', first_day, day) AS t, coalesce(mean / nullif(top, 0), 0) AS lev FROM d JOIN o USING (node)),
        a AS (SELECT node, t, lev, lag(t) OVER w AS t0, lag(lev) OVER w AS l0, row_number() OVER (PARTITION BY node ORDER BY lev DESC, t) AS peak, row_number() OVER (PARTITION BY node ORDER BY t DESC) AS back FROM t WINDOW w AS (PARTITION BY node ORDER BY t)),
        m AS (SELECT node, CAST(min(t) FILTER (WHERE lev > 0.5) AS DOUBLE) AS crossing, CAST(max(t) FILTER (WHERE peak = 1) AS DOUBLE) AS peak_time,
                     coalesce(sum((t - t0) * (lev + l0) / 2), 0) AS area, max(lev) FILTER (WHERE back = 1) AS last FROM a GROUP BY 1)
        SELECT d.node, day, n, round(d.mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, days, first_day, crossing, peak_time, round(area, 6) AS area, round(top, 6) AS highest, round(last, 6) AS last
        FROM d JOIN o USING (node) JOIN m USING (node)""",
    "job2_sample_features": f"""
        WITH u AS (SELECT coalesce(source, 'none') AS sample, doc_id AS unit, text FROM documents),
        w AS (SELECT sample, unit, regexp_replace(x, '{_PUNCTUATION}', '', 'g') AS feature FROM (
                SELECT sample, unit, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+')) AS x FROM u)),
        c0 AS (SELECT sample, unit, feature, count(*) AS c FROM w WHERE feature <> '' GROUP BY 1, 2, 3),
        c AS (SELECT * FROM c0 WHERE feature IN (SELECT feature FROM c0 GROUP BY 1 HAVING count(*) >= 3)),
        v AS (SELECT sample, unit, feature, c, ln(1 + 10000.0::DOUBLE * c / sum(c) OVER (PARTITION BY sample, unit)) AS value FROM c),
        s AS (SELECT sample, count(DISTINCT unit) AS n_units FROM u GROUP BY 1),
        g AS (SELECT sample, feature, count(*) AS n_found, sum(value) / any_value(n_units) AS mean, sum(value * value) AS ss, any_value(n_units) AS n FROM v JOIN s USING (sample) GROUP BY 1, 2),
        m AS (SELECT sample, feature, n_found, mean, greatest((ss - n * mean * mean) / nullif(n - 1, 0), 0) / mean AS dispersion FROM g WHERE mean > 0 AND n > 1),
        b AS (SELECT *, least(19, floor(coalesce((mean - min(mean) OVER p) / nullif((max(mean) OVER p - min(mean) OVER p) / 20, 0), 0))) AS bin FROM m WINDOW p AS (PARTITION BY sample)),
        z AS (SELECT sample, feature, n_found, mean, dispersion, round(coalesce((dispersion - avg(dispersion) OVER q) / nullif(stddev_samp(dispersion) OVER q, 0), 0), 9) AS score FROM b WINDOW q AS (PARTITION BY sample, bin)),
        r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY score DESC, feature) AS rank FROM z QUALIFY rank <= 50),
        x AS (SELECT sample, count(DISTINCT unit) AS full_units, count(*) AS pairs, count(DISTINCT feature) AS n_features, sum(c) AS total FROM c GROUP BY 1),
        l AS (SELECT sample, max(t) AS largest FROM (SELECT sample, unit, sum(c) AS t FROM c GROUP BY 1, 2) GROUP BY 1)
        SELECT s.sample, s.n_units, s.n_units - coalesce(full_units, 0) AS n_empty, coalesce(n_features, 0) AS n_features, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(largest, 0) AS BIGINT) AS largest,
               round(coalesce(pairs, 0) / s.n_units, 6) AS mean_features, round(coalesce(total, 0) / s.n_units, 6) AS mean_total,
               CAST(rank AS INTEGER) AS rank, feature, n_found, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, round(score, 6) AS score
        FROM s LEFT JOIN x USING (sample) LEFT JOIN l USING (sample) LEFT JOIN r USING (sample)""",
}
