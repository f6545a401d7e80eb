"""The registered queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.shipping import ship
from tidemark.llm import decontaminate, fingerprints, hard_negatives, mixing, near_dedup, quality, sharding, suffix_dedup, toxicity, url_filter, warc, wavelet, whitening
from tidemark.llm.shared import scratch_folder

SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, url_filter.RULES))


def op2_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return wavelet.token_report(table(spark, sf_dir, "documents"), tokenizer, end=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda k: quality.fold(k, 4) != 2, meta=("n_chars",))
    return quality.score_quality(docs, model, quality.fold(F.col("doc_id"), 4) == 2, meta=("n_chars",))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda k: quality.fold(k, 5) != 0)
    return toxicity.toxicity_report(docs, model, quality.fold(F.col("doc_id"), 5) == 0)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 9) for c in ("probability", "token_weight")})


def op7_mixing_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.margins(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0, scale=256.0)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html", scratch_folder(spark, "captures"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filters, op2_token_output, op3_quality, op4_toxicity, op5_near_dedup, op6_suffix_dedup, op7_mixing, op7_mixing_margins, op8_fingerprints, op9_sharding, op10_decontamination, op11_whitening, op12_hard_negatives, op13_warc, pipeline]
    return {f.__name__: f for f in own}


_A2Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = rf"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_A2Z}) AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
  r(h, p, v) AS (VALUES {", ".join(map(str, url_filter.RULES))}), m AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
  SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (n)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_A2Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
  i AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0), iw AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
  dw AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
  h AS (SELECT r, n, s, item FROM dw JOIN iw USING (n, g)), p AS (SELECT r, count(DISTINCT x) AS hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
  t AS (SELECT r, count(*) AS items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(hit > 0 AND 20 * hit >= len(w), false) AS contaminated
  FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""


OP12_SQL = """WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT a, c AS p, score AS ps, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS k FROM s WHERE same QUALIFY k <= 5),
  n AS (SELECT p.a, p, ps, s.c, s.score, row_number() OVER (PARTITION BY p.a, k ORDER BY score DESC, c) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps QUALIFY rank <= 3)
  SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, c AS negative_id, ps AS positive_score, score AS negative_score FROM n"""

OP13_SQL = """WITH h AS (SELECT page_id, coalesce(html, '') AS html FROM pages), k AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS x,
  max(page_id) OVER (PARTITION BY html) AS top, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k FROM h)
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM k"""


def oracle_sql() -> dict[str, str]:
    """The other operators hash with functions that DuckDB lacks, learn, or need eigenvectors; tests hold them against brute force."""
    return {"op1_url_filters": OP1_SQL, "op10_decontamination": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_warc": OP13_SQL}
