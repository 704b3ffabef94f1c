"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import jaccard_join, language_id, lm_scoring, oracles, packing, piece_sampling, prefix_trie, quality_classifier, quality_rules, resampling, sharding, substring_dedup, top_k, url_filter
from lexmill.llm.common import remainder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    return language_id.train_and_identify(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 5) == 1)
    return lm_scoring.train_and_score(docs, public_tokenizers.path("piece_bpe_32k.model"), ~F.col("held_out"), ["doc_id", "held_out"])


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    return quality_classifier.train_and_score(docs, _read(spark, sf_dir, "labels"), ~F.col("held_out"), ["doc_id", "held_out"])


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), keep=["page_id"])


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_read(spark, sf_dir, "documents"), 40)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), seed=2024, percent=10)
    return drawn.withColumnRenamed("id", "doc_id")


OP8_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM d WHERE len(words) >= 20),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i : i + 19], ' ') ORDER BY doc_id, i) AS n FROM starts),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM ranked WHERE n > 1),
word AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_lattice_lm": op3_lattice_lm,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_sampled_pieces": op5_sampled_pieces,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_quality_rules": op10_quality_rules,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_sharding": op12_sharding,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring_dedup": OP6_SQL,
        "op8_exact_top_k": OP8_SQL,
        "op11_prefix_trie": oracles.OP11,
        "op12_sharding": oracles.OP12,
        "op13_importance_resampling": oracles.OP13,
    }
