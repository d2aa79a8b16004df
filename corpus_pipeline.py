"""The corpus pipeline: stages over `documents`, each the input of the next.

Language identification drops documents without a known language; exact dedup keeps one document of
equal texts; the n-gram Jaccard join keeps one of each group of near copies (five words, similarity 0.8);
suffix-array dedup takes passages of 200 bytes and more that stand anywhere else out of the texts; what
is left is packed into sequences of 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadtide.llm.common import Scratch, alone, read
from leadtide.llm.exact_dedup import without_copies
from leadtide.llm.jaccard_join import without_near_copies
from leadtide.llm.language_id import known_language
from leadtide.llm.packing import best_fit_packing
from leadtide.llm.suffix_dedup import without_repeats


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null or have no letter go."""
    return known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return without_copies(docs, keep="min")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return without_near_copies(docs, n=5, num=80, den=100)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 200 bytes or more leave the texts; documents of which nothing is left go."""
    return without_repeats(docs, least=200)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of a document in sequences of 4096 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("suffix_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote goes when its result is written, and its input with it.

    Null ids, texts and other columns, repeated rows, tables without rows and columns of any name pass
    through as the stages' docstrings say; rows with a null or empty text go in the first stage.
    """
    docs, kept = read(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        with alone(spark):
            after = kept.write(stage(spark, docs, sf_dir))
        kept.drop_others(after)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
