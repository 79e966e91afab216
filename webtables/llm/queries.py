"""One query per operator: its production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, decontaminate, jaccard, language, linededup, merkle, mixing, oracles, packing, quality, secrets, sharding, toxicity, urlfilter
from .common import table
from .registry import ORACLES, QUERIES, query  # noqa: F401


@query()
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", "dropped")


@query()
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixture(table(spark, sf_dir, "documents"), mixing.cycle(5, 2, 1))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.counted(F.col("base"), name).alias(f"n_{name}") for name in ("assign", "access", "hex")]
    digest = F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, secrets.span_text(F.col("found")).alias("spans"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.find_overlap(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "hits")


@query()
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"), quality.RULES)


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# the same steps in plain SQL: rules by longest text, then reachability over the links of the pages
URL_SQL = r"""
WITH RECURSIVE rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
raw AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
link AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM raw
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*''?([^"''\s>]+)', 1) FROM raw),
based AS (
  SELECT url, t, split_part(url, '://', 1) AS scheme,
    translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_extract(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '^(.*/)?', 0) AS folder
  FROM link WHERE t <> '' AND strpos(url, '://') > 0),
pair AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN concat(scheme, ':', t)
    WHEN starts_with(t, '/') THEN concat(scheme, '://', h, t) ELSE concat(scheme, '://', h, CASE folder WHEN '' THEN '/' ELSE folder END, t) END AS target FROM based),
every(url) AS (SELECT url FROM raw UNION SELECT url FROM pair UNION SELECT target FROM pair),
parsed AS (
  SELECT url,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM every),
keyed AS (
  SELECT url, host, path, CASE WHEN strpos(url, '://') > 0 THEN concat(
    translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '://', host, path, regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1)) END AS node FROM parsed),
ruled AS (
  SELECT k.url, k.host, k.path, k.node, r.rule, r.action FROM keyed k LEFT JOIN LATERAL (
    SELECT rhost || rpath AS rule, action FROM rules
    WHERE (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) r ON true),
edge AS (
  SELECT a.node AS a, b.node AS b FROM pair p JOIN keyed a ON a.url = p.url JOIN keyed b ON b.url = p.target WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
reach(start, node) AS (
  SELECT DISTINCT a, a FROM (SELECT a FROM edge UNION SELECT b FROM edge)
  UNION
  SELECT r.start, CASE WHEN e.a = r.node THEN e.b ELSE e.a END FROM reach r JOIN edge e ON e.a = r.node OR e.b = r.node),
alias AS (
  SELECT r.start AS node FROM reach r JOIN ruled u ON u.node = r.node GROUP BY r.start
  HAVING bool_or(coalesce(u.action = 'block', false)) AND NOT bool_or(coalesce(u.action = 'allow', false)))
SELECT w.page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path, u.rule,
  coalesce(u.action, CASE WHEN u.node IN (SELECT node FROM alias) THEN 'block' END, 'allow') AS verdict
FROM raw w LEFT JOIN ruled u ON u.url IS NOT DISTINCT FROM w.url
"""


@query(URL_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.shard_documents(docs, shards=16)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query(oracles.merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


@query(oracles.repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_summary(rows, F.col("present"))


@query()
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    rows = packing.pack_documents(table(spark, sf_dir, "documents"), spec)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
