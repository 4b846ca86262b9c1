"""Registered queries of this subpackage: each applies one operator to its whole table.

`QUERIES` maps a name to a function of (spark, folder); `ORACLES` maps a name to DuckDB SQL with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirefold.llm.ann import nearest
from quirefold.llm.common import KEY, held_out, remainder, table
from quirefold.llm.decontamination import find_contamination
from quirefold.llm.langid import fit_languages, identify_languages
from quirefold.llm.line_dedup import dedup_lines
from quirefold.llm.lm_score import score_texts
from quirefold.llm.manifest import build_manifest, prove
from quirefold.llm.negatives import hard_negatives
from quirefold.llm.packing import pack_documents
from quirefold.llm.quality import score_quality
from quirefold.llm.sharding import DIMENSIONS, shard_documents
from quirefold.llm.simhash import simhash_groups
from quirefold.llm.sql import HARD_NEGATIVES, MANIFEST, SHARDING, with_dots
from quirefold.llm.toxicity import score_toxicity
from quirefold.llm.url_filter import judge_urls

# Fixed values of the contract: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _predicted() -> Column:
    return (F.col("score") >= 0.3).cast("int").alias("predicted")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_quality(documents(spark, folder), table(spark, folder, "labels"), remainder(5) != 0)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", _predicted())


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(documents(spark, folder), table(spark, folder, "benchmark")).drop(*KEY)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(documents(spark, folder), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    judged = identify_languages(docs, fit_languages(docs, remainder(5) != 0))
    return judged.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_texts(documents(spark, folder), remainder(10) != 0)
    return scored.select(
        "doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(documents(spark, folder), table(spark, folder, "labels"), remainder(4) != 2)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", _predicted())


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_urls(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_groups(documents(spark, folder), shingle=3, max_bits=2)
    return groups.select("doc_id", "fingerprint", "component_id", "n_links")


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_documents(documents(spark, folder), shards=40, law="rows", columns=["doc_id", *DIMENSIONS])
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return prove(build_manifest(documents(spark, folder), tampered=remainder(5) == 0))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_lm_score": op5_lm_score,
    "op6_nearest": op6_nearest,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_sharding": op11_sharding,
    "op12_manifest": op12_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH d AS (SELECT doc_id, hash(text) AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, t, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
        k AS (
            SELECT *, translate(
                trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, t)) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY doc_id, t
    """,
    "op9_url_filter": with_dots(r"""
        WITH RECURSIVE rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        rests AS (
            SELECT page_id, url, html,
                CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (
            SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1), '') AS query
            FROM rests),
        tags AS (
            SELECT host, path, query, unnest(regexp_extract_all(
                regexp_replace(html, '(?s)<!--.*?(?:-->|$)', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM parts),
        targets AS (
            SELECT host, path, query, replace(CASE
                WHEN regexp_matches(tag, '(?is)[\s"''/]rel\s*=\s*("([^">]*\s)?canonical(\s[^">]*)?"|''([^''>]*\s)?canonical(\s[^''>]*)?''|canonical[\s/>])')
                    THEN regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?([^"''\s>]+)', 1)
                WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')
                    THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS t
            FROM tags),
        full_targets AS (
            SELECT host || DOTS(path) || query AS a, CASE
                WHEN contains(t, '://') THEN substr(t, strpos(t, '://') + 3)
                WHEN starts_with(t, '//') THEN substr(t, 3)
                WHEN starts_with(t, '/') THEN host || t
                WHEN regexp_matches(t, '^[?#]') THEN host || path || t
                ELSE host || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^((?s:.*)/)', 1) ELSE '/' END || t
                END AS b
            FROM targets WHERE t <> '' AND host <> ''),
        ends AS (
            SELECT a, translate(regexp_extract(b, '^[^/?#]*'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
                DOTS(regexp_extract(b, '^[^/?#]*([^?#]*)', 1)) || regexp_extract(b, '^[^?#]*(\?[^#]*)?', 1) AS r
            FROM full_targets),
        links AS (
            SELECT a, h || r AS b FROM ends WHERE h <> '' UNION SELECT h || r, a FROM ends WHERE h <> ''),
        hit(node) AS (
            SELECT a FROM links WHERE (
                SELECT arg_max(v, length(rules.h || p)) FROM rules
                WHERE (regexp_extract(a, '^[^/?#]*') = rules.h OR ends_with(regexp_extract(a, '^[^/?#]*'), '.' || rules.h))
                    AND starts_with(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), p)) = 'block'
            UNION SELECT links.b FROM hit JOIN links ON links.a = hit.node),
        judged AS (
            SELECT page_id, any_value(host) AS host, any_value(path) AS path, any_value(query) AS query,
                arg_max(rules.h || p, length(rules.h || p)) AS rule, arg_max(v, length(rules.h || p)) AS v
            FROM parts LEFT JOIN rules
                ON (host = rules.h OR ends_with(host, '.' || rules.h)) AND starts_with(path, p)
            GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host <> '' AND EXISTS (
            SELECT 1 FROM hit WHERE node = host || DOTS(path) || query) THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged
    """),
    "op11_sharding": SHARDING,
    "op12_manifest": MANIFEST,
    "op13_hard_negatives": HARD_NEGATIVES,
}
