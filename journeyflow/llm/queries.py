"""Catalogue entries of the training-data operators: one query per operator and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from journeyflow.llm import (
    conversation_repair,
    cross_polytope,
    language_rank,
    lp_packing,
    merkle_manifest,
    mincut_html,
    order_minhash,
    passage_mil,
    pivot_topk,
    quality_rules,
    sentencepiece_nbest,
    suffix_dedup,
    url_filter,
)
from journeyflow.llm.oracles import ORACLES as ORACLES
from journeyflow.llm.shipping import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """File of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_nbest(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_passage_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_mil.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(_read(spark, sf_dir, "documents"))


def op5_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp_packing.packing_digest(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op7_language_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_rank.language_digest(_read(spark, sf_dir, "documents"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut_html.extraction_digest(_read(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(_read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(_read(spark, sf_dir, "conversations"))


def op12_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.topk_digest(_read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_digest(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece_nbest,
        op2_order_minhash,
        op3_passage_mil,
        op4_quality_rules,
        op5_lp_packing,
        op6_url_filter,
        op7_language_rank,
        op8_cross_polytope,
        op9_mincut_html,
        op10_suffix_dedup,
        op11_conversation_repair,
        op12_pivot_topk,
        op13_merkle_manifest,
        pipeline,
    )
}
