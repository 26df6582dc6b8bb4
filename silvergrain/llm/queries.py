"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.llm import conversation_repair, hard_negatives, html_text, jaccard_join, line_dedup, lm_scoring, mixing, oracles, packing, quality, sharding, suffix_dedup, token_counts, topk
from silvergrain.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_pack_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


def op3_quality_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality.quality_verdicts(docs).drop("distance")


def op4_topk_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_lm_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_html_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_mix_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op9_shard_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    dealt = sharding.shards(docs)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op11_line_dedup_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_conversation_cost_to_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_hard_negatives_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy)
    return hard_negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_pack_minimum_bin_slack": op2_pack_minimum_bin_slack,
    "op3_quality_robust_outliers": op3_quality_robust_outliers,
    "op4_topk_pivot_index": op4_topk_pivot_index,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_lm_deleted_interpolation": op6_lm_deleted_interpolation,
    "op7_html_page_differencing": op7_html_page_differencing,
    "op8_mix_splitting_tree": op8_mix_splitting_tree,
    "op9_shard_kd_tree": op9_shard_kd_tree,
    "op10_token_counts": op10_token_counts,
    "op11_line_dedup_bitmaps": op11_line_dedup_bitmaps,
    "op12_conversation_cost_to_go": op12_conversation_cost_to_go,
    "op13_hard_negatives_norm_buckets": op13_hard_negatives_norm_buckets,
}

#: DuckDB SQL where it can express the query.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.NGRAM_JACCARD_JOIN,
    "op4_topk_pivot_index": oracles.TOPK,
    "op5_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
    "op11_line_dedup_bitmaps": oracles.LINE_DEDUP,
    "op13_hard_negatives_norm_buckets": oracles.HARD_NEGATIVES,
}
