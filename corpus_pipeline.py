"""The corpus pipeline: quality rules, language, near copies, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; `run` writes
each stage's rows as Parquet in the shared folder and hands the written table on. All stages but
the last return the columns of ``documents``; n_chars follows the text.

Rows with a null doc_id or text are ordinary rows: a text without words fails the rules. Rows that
repeat a doc_id are judged each by its own text; of near copies and equal rows exactly one row
stays, the first by doc_id (nulls last) and text hash. Every stage puts the columns it does not read aside
under private names, so extra columns with any name pass through untouched.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from journeyflow.llm import language_rank, lp_packing, order_minhash, quality_rules, suffix_dedup  # noqa: E402
from journeyflow.llm.queries import tokenizer_path  # noqa: E402
from journeyflow.llm.shipping import ship  # noqa: E402
from journeyflow.llm.storage import materialize  # noqa: E402

MIN_LANGUAGE_SCORE = 0.2  # below it a text resembles none of the learned languages


def _aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with all but the ``used`` columns under private names, and the selection that undoes it."""
    names = {c: c if c in used else f"_aside_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(k) for c, k in names.items()]), [F.col(k).alias(c) for c, k in names.items()]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fences."""
    ship(spark)
    docs, back = _aside(docs, ("lang", "source", "text"))
    return quality_rules.quality_rules(docs).where("kept").select(*back)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that resemble a language learned from the labelled ones; ``und`` and strangers go."""
    ship(spark)
    docs, back = _aside(docs, ("lang", "text"))
    found = language_rank.predict_language(docs, language_rank.learn_profiles(docs))
    good = (F.col("lang_pred") != language_rank.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(good).select(*back)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the first by doc_id (nulls last) and text hash."""
    ship(spark)
    docs, back = _aside(docs, ("doc_id", "text"))
    return order_minhash.without_near_copies(docs).select(*back)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that stood in the corpus before."""
    ship(spark)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    docs, back = _aside(docs, ("doc_id", "text"))
    return suffix_dedup.without_repeats(docs).select(*back).withColumn("n_chars", size)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place."""
    ship(spark)
    return lp_packing.packing_digest(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("near copies", near_copy_stage),
    ("repeated strings", repeats_stage),
    ("packing", packing_stage),
]

#: The stages hash, learn and tokenise, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
