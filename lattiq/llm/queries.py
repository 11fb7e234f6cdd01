"""Queries opN_<name> of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import castore, embeddings, exact, hardneg, html, langid, mixing, packing, quality, rules, simhash, warc
from .common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = castore.write_store(load(spark, sf_dir, "documents"))
    store.verify()
    return castore.read_store(store)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op4_shrinkage_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op7_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(load(spark, sf_dir, "documents"))


def op8_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(load(spark, sf_dir, "embeddings"))


def op9_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(load(spark, sf_dir, "documents"))


def op10_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(load(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(load(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pareto_mixing, op2_content_store, op3_best_fit_packing, op4_shrinkage_qda, op5_wrapper_extraction, op6_simhash_bktree, op7_block_naming, op8_spherical_kmeans, op9_ppm_langid, op10_zstd_warc, op11_dual_tree_negatives, op12_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_zstd_warc": """
            WITH p AS (
              SELECT page_id, coalesce(html, '') AS h, row_number() OVER (PARTITION BY page_id, coalesce(html, '')) AS turn FROM pages),
            k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC, turn DESC) AS n, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
            SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
                   CASE WHEN strlen(h) >= 1000 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN strlen(h) >= 1000 AND n > 1 THEN keep END AS refers_to
            FROM k""",
        "op7_block_naming": """
            WITH n AS (
              SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
              FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
        "op11_dual_tree_negatives": """
            WITH v AS (
              SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
              FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q)
              WHERE a.vec_id % 100 = 0),
            p AS (SELECT r, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS k FROM s WHERE same QUALIFY k <= 5),
            n AS (
              SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
                     row_number() OVER (PARTITION BY p.r, k ORDER BY score DESC, other) AS rank
              FROM p JOIN s ON s.r = p.r AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
            SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
        "op12_quality_rules": f"""
            WITH d AS (
              SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
            w AS (
              SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
              FROM d),
            g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
            p AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
            c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (VALUES (0), (1), (2)) AS three(k) GROUP BY r),
            s AS (
              SELECT doc_id, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS word_chars,
                     len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
                     len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
                     len(regexp_extract_all(t, '!')) AS shouts,
                     len(list_filter(ws, lambda x: list_contains([{", ".join(repr(x) for x in sorted({x for line in rules.STOP_WORDS.values() for x in line.split()}))}], lower(x)))) AS stops,
                     len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t\\n\\x0B\\f\\r]*[-*•]'))) AS bullets,
                     len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\n\\x0B\\f\\r]*$'))) AS dots
              FROM w LEFT JOIN c USING (r)),
            b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
            SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
                   CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
                   NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1::DOUBLE AND shouts / n_words <= 0.2::DOUBLE
                   AND stops / n_words >= 0.03::DOUBLE AND n_dup_lines / n_lines <= 0.5 AND bullets / n_lines <= 0.9::DOUBLE AND dots / n_lines <= 0.3::DOUBLE AS kept
            FROM b""",
    }
