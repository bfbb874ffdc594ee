"""The registered queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, hard_negatives, html_text, language_id, packing, quality, secret_scan, sharding, simhash, token_counts, topk_search, toxicity
from .tables import read


def op1_no_random_access_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % topk_search.QUERY_STEP == 0))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.label_documents(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_layout_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op8_bk_tree_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "chars", F.crc32("candidate").alias("candidate_crc32"), "score", "is_secret")


def op11_nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_exact_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_voronoi_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, own = F.col("label"), F.col("vec_id")
    vectors = read(spark, sf_dir, "embeddings").withColumn("label", F.when(own % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(vectors, vectors.where(own % 100 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_no_random_access_top_k": op1_no_random_access_top_k,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_crf_language_id": op4_crf_language_id,
    "op5_byte_balanced_shards": op5_byte_balanced_shards,
    "op6_additive_quality": op6_additive_quality,
    "op7_layout_html_text": op7_layout_html_text,
    "op8_bk_tree_near_duplicates": op8_bk_tree_near_duplicates,
    "op9_transducer_token_counts": op9_transducer_token_counts,
    "op10_secret_scan": op10_secret_scan,
    "op11_nonnegative_pu_toxicity": op11_nonnegative_pu_toxicity,
    "op12_exact_centroid_clustering": op12_exact_centroid_clustering,
    "op13_voronoi_hard_negatives": op13_voronoi_hard_negatives,
}

#: CRC-32 of a text's bytes, with its table made by the usual rule.
CRC = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_of
)"""
CRC_OF = """xor(list_reduce(list_prepend(4294967295::BIGINT,
         list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)),
         lambda a, b: xor(a >> 8, crc_of[(xor(a, b) & 255) + 1])), 4294967295)"""

SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def clusters_sql(rounds: int = 3) -> str:
    """The rounds written out: distances of all kept vectors from the centroids, then floors of the means."""
    near = "SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i])))::BIGINT AS d FROM kept, c{0}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1"
    steps = []
    for t in range(rounds):
        steps.append(f"a{t} AS MATERIALIZED ({near.format(t)})")
        mean = f"SELECT k, list(floor_of ORDER BY i) AS c FROM (SELECT k, i, (s - (s % n + n) % n) // n AS floor_of FROM (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{t}, range(1, 65) p(i) GROUP BY k, i)) GROUP BY k"
        steps.append(f"c{t + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{t} o LEFT JOIN ({mean}) m USING (k))")
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {SOUND}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS k, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept WHERE vec_id IS NOT NULL ORDER BY h LIMIT 16)
), {", ".join(steps)}, placed AS ({near.format(rounds)})
SELECT vec_id, k AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM placed JOIN c{rounds} USING (k)"""


ORACLES: dict[str, str] = {
    "op12_exact_centroid_clustering": clusters_sql(),
    "op13_voronoi_hard_negatives": f"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {SOUND}
), scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5""",
    "op1_no_random_access_top_k": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op5_byte_balanced_shards": f"""
WITH {CRC}, sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {CRC_OF.format("coalesce(text, '')")} AS crc FROM documents, crc_table
), summed AS (
  SELECT *, sum(size) OVER () AS total,
         sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, crc) AS nth
  FROM sized
), placed AS (
  SELECT *, least(15, ((upto - size) * 2 + size) * 16 // (total * 2))::INTEGER AS shard FROM summed
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed""",
}
