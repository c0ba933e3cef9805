"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import ctw_lm, filter_audit, hard_negatives, language_id, lsa_decontaminate, pareto_mix, prefix_counts, quality_nbsvm, repair_shards, simhash_ball, tiktoken_codec, url_rules, wav_landmarks
from quillmesh.llm.common import remainder, table


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_nbsvm.train(docs, labels.where(remainder("doc_id", 3) != 1))
    scored = quality_nbsvm.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_segmentation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(remainder("doc_id", 5) != 0))
    return language_id.predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_shards.encode_and_read(table(spark, sf_dir, "documents"))


def op4_lsa_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_tiktoken_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiktoken_codec.round_trip(table(spark, sf_dir, "documents"))


def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ctw_lm.score(docs, ctw_lm.train(docs.where(remainder("doc_id", 7) != 2)))
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_table(table(spark, sf_dir, "documents"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {prefix_counts.LIMIT_TOKENS} AS over_limit")


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_ball.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_url_range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, url_rules.RULES))


def op10_wav_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wav_landmarks.media_digests(table(spark, sf_dir, "documents"))


def op11_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.scaled_rows(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_nbsvm, op2_segmentation_language, op3_repair_token_shards, op4_lsa_decontaminate, op5_tiktoken_round_trip, op6_context_tree_weighting, op7_prefix_token_counts, op8_simhash_ball, op9_url_range_rules, op10_wav_landmarks, op11_ball_tree_negatives, op12_pareto_mix, op13_filter_audit)
}
ORACLES: dict[str, str] = {"op9_url_range_rules": url_rules.ORACLE_SQL, "op11_ball_tree_negatives": hard_negatives.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
