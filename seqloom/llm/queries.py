"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clusters, decontaminate, html, mixing, near, negatives, quality, scoring, simhash, substring, tokens, topk


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_read(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return quality.scored(documents, quality.learn(documents, _read(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(rows.unionByName(own)))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with its class."""
    return near.classes(_read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(_read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each negative; some ids' labels are moved on first, as mislabelled rows would be."""
    rows = _read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.withColumn("label", moved))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprinted(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_html_extraction, op3_substring_dedup, op4_topk_search, op5_lm_scoring, op6_quality_classifier, op7_token_counts, op8_chat_formatting, op9_minhash_near_dedup, op10_source_mixing, op11_centroid_clustering, op12_hard_negatives, op13_document_fingerprints)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": OP3,
        "op4_topk_search": OP4,
        "op8_chat_formatting": OP8,
        "op11_centroid_clustering": OP11,
        "op12_hard_negatives": OP12,
    }


OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, s, hash(list_slice(ws, s, s + 34)) AS h, list_slice(ws, s, s + 34) AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM d WHERE len(ws) >= 35)),
r AS (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h, run HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM r),
k AS (SELECT d.doc_id, len(ws) AS n, coalesce(list_sort(list(c.i) FILTER (c.i IS NOT NULL)), []) AS gone, any_value(ws) AS ws FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, ws)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM k
"""

OP4 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'),
                '\[(\\*(?:/?INST\]|/?SYS\]|/?TURN\]|IMAGE\]|AUDIO\]|DOCUMENT\]))', '[\\\1', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(length(escaped) + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_GAP = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _round(i: int) -> str:
    """Vectors to the nearest centroid, and the centroids of the round after."""
    return f"""
a{i} AS MATERIALIZED (SELECT key, vec_id, e, number, gap FROM (SELECT v.key, v.vec_id, v.e, c.number, {_GAP} AS gap, row_number() OVER (PARTITION BY v.key ORDER BY {_GAP}, c.number) AS place FROM v, c{i} c) WHERE place = 1),
c{i + 1} AS MATERIALIZED (SELECT o.number, coalesce(n.e, o.e) AS e FROM c{i} o LEFT JOIN (
  SELECT number, list(f ORDER BY pos) AS e FROM (SELECT number, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS f FROM (SELECT number, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{i}) GROUP BY number, pos) GROUP BY number) n ON n.number = o.number)"""


OP11 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS number, e FROM (SELECT e, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT 8)),
{",".join(_round(i) for i in range(11))}
SELECT a.vec_id, CAST(a.number AS INTEGER) AS cluster, CAST(gap AS BIGINT) AS distance, CAST(sum(gap) OVER (PARTITION BY a.number) AS BIGINT) AS cluster_inertia, CAST(sum(gap) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a10 a JOIN c10 c ON c.number = a.number
"""

OP12 = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.place, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(place AS INTEGER) AS positive_rank FROM n WHERE rank <= 3
"""
