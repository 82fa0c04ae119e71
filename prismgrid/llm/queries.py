"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )


def op2_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import hpylm

    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    return hpylm.score(docs.withColumn("train", F.coalesce(part != 1, F.lit(True))), "train")


def op3_cover_tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import cover_tree

    return cover_tree.near_pairs(table(spark, sf_dir, "embeddings"))


def op4_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import ann_scan

    vectors = table(spark, sf_dir, "embeddings")
    return ann_scan.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import quality_kn

    return quality_kn.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: page n was fetched on day n mod 730 from 2024-01-01."""
    return pages.select(
        "page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 730 as int))").alias("fetch_time")
    )


def list_events(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of the pages, by rule.

    The first hex digits of a host's MD5 decide: a host of digit 0-3 is listed, one of 0-1 by host,
    2 by domain, 3 by path; it is added on a day, removed half a year later and, if the second digit
    is even, added again after another 100 days.
    """
    from prismgrid.llm import url_filter

    hosts = url_filter.url_parts(pages.select("url")).filter("host <> ''").select("host", "path1").distinct()
    code = lambda at, n: F.conv(F.substring(F.md5("host"), at, n), 16, 10).cast("int")
    first = code(1, 1)
    listed = hosts.filter(first <= 3).select(
        F.when(first <= 1, "host").when(first == 2, "domain").otherwise("path").alias("rule"),
        F.when(first == 3, F.concat_ws("/", "host", "path1")).otherwise(F.col("host")).alias("key"),
        F.expr("date_add(date'2024-01-01', cast(conv(substr(md5(host), 3, 3), 16, 10) as int) % 500)").alias("day"),
        (code(2, 1) % 2 == 0).alias("again"),
    ).distinct()
    event = lambda action, days: F.struct(F.lit(action).alias("action"), F.date_add("day", days).alias("at"))
    log = F.when(F.col("again"), F.array(event("add", 0), event("remove", 180), event("add", 280)))
    log = log.otherwise(F.array(event("add", 0), event("remove", 180)))
    return listed.select("rule", "key", F.explode(log).alias("e")).select("rule", "key", "e.action", "e.at")


def op7_url_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import url_filter

    pages = table(spark, sf_dir, "pages")
    judged = url_filter.filter_urls(captures(pages), list_events(pages))
    return judged.withColumns({c: F.col(c).cast("string") for c in ("fetch_time", "active_since")})


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, (DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER))::DATE AS fetch_time,
         coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.$', ''), '') AS host,
         coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1), '') AS path1
  FROM pages),
listed AS (
  SELECT DISTINCT
         CASE WHEN d1 <= 1 THEN 'host' WHEN d1 = 2 THEN 'domain' ELSE 'path' END AS rule,
         CASE WHEN d1 = 3 THEN host || '/' || path1 ELSE host END AS key,
         (DATE '2024-01-01' + (('0x' || substr(md5(host), 3, 3))::INTEGER % 500))::DATE AS day,
         ('0x' || substr(md5(host), 2, 1))::INTEGER % 2 = 0 AS again
  FROM (SELECT DISTINCT host, path1, ('0x' || substr(md5(host), 1, 1))::INTEGER AS d1 FROM captures WHERE host <> '')
  WHERE d1 <= 3),
spans AS (
  SELECT rule, key, day AS valid_from, (day + 180)::DATE AS valid_to FROM listed
  UNION ALL
  SELECT rule, key, (day + 280)::DATE, NULL FROM listed WHERE again),
hits AS (
  SELECT c.page_id, c.url, c.fetch_time, s.rule, s.key, s.valid_from,
         row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY CASE s.rule WHEN 'path' THEN 1 WHEN 'host' THEN 2 ELSE 3 END, -length(s.key), s.key, s.valid_from) AS nth,
         count(*) OVER (PARTITION BY c.page_id, c.url) AS n_active
  FROM captures c JOIN spans s ON c.host <> ''
   AND ((s.rule = 'host' AND s.key = c.host) OR (s.rule = 'path' AND s.key = c.host || '/' || c.path1)
     OR (s.rule = 'domain' AND (s.key = c.host OR ends_with(c.host, '.' || s.key))))
   AND c.fetch_time >= s.valid_from AND (s.valid_to IS NULL OR c.fetch_time < s.valid_to))
SELECT c.page_id, c.url, CAST(c.fetch_time AS VARCHAR) AS fetch_time, c.host, c.path1, CAST(coalesce(h.n_active, 0) AS BIGINT) AS n_active,
       h.rule IS NOT NULL AS blocked, h.rule, h.key AS listed_key, CAST(h.valid_from AS VARCHAR) AS active_since
FROM captures c LEFT JOIN hits h ON h.nth = 1 AND h.page_id = c.page_id AND h.url = c.url
"""


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from prismgrid.llm import bpe

    args = rank_file(), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *args), *args)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prismgrid.llm import langid_crf

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    docs = docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    model = langid_crf.fit(docs.filter("not held_out"))
    return langid_crf.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_pii_weak_supervision": op1_pii_weak_supervision,
    "op2_hierarchical_pitman_yor": op2_hierarchical_pitman_yor,
    "op3_cover_tree_pairs": op3_cover_tree_pairs,
    "op4_adaptive_dimension_scan": op4_adaptive_dimension_scan,
    "op5_kneser_ney_quality": op5_kneser_ney_quality,
    "op6_simhash_segment_popcount": op6_simhash_segment_popcount,
    "op7_url_temporal_list_join": op7_url_temporal_list_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_pivotal_mixing": op9_pivotal_mixing,
    "op10_crf_language_id": op10_crf_language_id,
}

ORACLE_SQL: dict[str, str] = {"op7_url_temporal_list_join": OP7_SQL}
