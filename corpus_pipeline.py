"""A training corpus from ``documents``: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cryolog.llm import common, op1_suffix_dedup, op2_decontaminate, op5_jaccard, op9_packing, op10_toxicity
from cryolog.llm.queries import vocabulary


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labelled ones among its input."""
    return op10_toxicity.drop_toxic(docs, op10_toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 or more, the document of the smallest id stays."""
    return op5_jaccard.drop_near_copies(docs, k=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at two places or more are cut out of the texts: passages of some 33 words or more."""
    return op1_suffix_dedup.remove_repeats(docs, length=200, gram=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go."""
    return op2_decontaminate.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left goes into windows of 4096 tokens, neighbours together."""
    return op9_packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeats", repeats), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # a trained classifier and greedy packing have no SQL; tests hold the run against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
