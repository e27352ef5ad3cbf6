"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, jaccard, langid, lines, packing, secrets, shards, suffixes, tokens, topk


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_uniform_threshold(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_grouped_prefix_join(spark, sf_dir):
    return jaccard.near_duplicates(_docs(spark, sf_dir))


def op3_orc_tokens(spark, sf_dir):
    return tokens.tokenize_to_orc(_docs(spark, sf_dir))


def op4_backward_extension(spark, sf_dir):
    out = suffixes.remove_repeats(_docs(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op5_template_windows(spark, sf_dir):
    out = decontam.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", "n_windows", "item_windows", "exact")


def op6_char_network(spark, sf_dir):
    return secrets.find_secrets(_docs(spark, sf_dir))


def op7_nearest_centroid(spark, sf_dir):
    return langid.identify(_docs(spark, sf_dir))


def op8_fuzzy_lines(spark, sf_dir):
    out = lines.dedup_lines(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op9_hash_ring(spark, sf_dir):
    return shards.shard_documents(_docs(spark, sf_dir))


def op10_pattern_packing(spark, sf_dir):
    return packing.pack_documents(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_uniform_threshold, op2_grouped_prefix_join, op3_orc_tokens, op4_backward_extension, op5_template_windows, op6_char_network, op7_nearest_centroid, op8_fuzzy_lines, op9_hash_ring, op10_pattern_packing)}
ORACLES = {
    "op1_uniform_threshold": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM (SELECT DISTINCT vec_id, embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.vec) + 1), lambda i: q.vec[i] * c.vec[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
