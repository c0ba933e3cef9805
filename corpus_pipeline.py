"""A corpus-cleaning pipeline of five stages, each calling one operator of quillmesh.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet in
the shared folder and read again as the next stage's docs. All but the last return the columns of docs.

Defined cases. Quality: a text whose score is under 0.5 goes; without labels of both classes the constant score decides.
Language: texts that are null or without a letter, and those whose best language is less likely than ``LEAST_LANGUAGE``,
go. Near-dedup: of each group of linked documents the one with the smallest id stays, of rows that repeat this id the
longest; a document without an id stays only where none of its group has one. Rows of one id, or without an id, that are
in different groups all stay. Decontamination: documents that hold a passage of
the benchmark, or a paraphrase, go. Encoding: a null text has no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import language_id, lsa_decontaminate, quality_nbsvm, simhash_ball, tiktoken_codec
from quillmesh.llm.common import filter_rows, materialise, table

LEAST_LANGUAGE = 0.4
ORACLE_SQL = None  # SQL can't express trained models and fingerprints; tests compare with a brute-force version


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = spark.sparkContext.broadcast(quality_nbsvm.train(docs, table(spark, sf_dir, "labels")))
    return filter_rows(docs, lambda source: (score >= 0.5 for (score,) in quality_nbsvm.score_rows(model.value, source)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = spark.sparkContext.broadcast(language_id.train(docs))
    return filter_rows(docs, lambda source: (lang != language_id.UNKNOWN_LANGUAGE and score >= LEAST_LANGUAGE for lang, score in language_id.predict_rows(model.value, source)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_ball.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = docs
    for block in lsa_decontaminate.blocks(docs, table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(block)
        kept = filter_rows(kept, lambda source, shared=shared: (not shared.value.matches(text) for (text,) in source))
    return kept


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiktoken_codec.round_trip(docs, with_ids=True)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
