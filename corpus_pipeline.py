"""From raw documents to packed training sequences, each stage's rows written and read again as the next one's."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import written
from quern.llm.exact_dedup import deduplicated
from quern.llm.mixing import mixed
from quern.llm.near_dedup import representatives
from quern.llm.packing import best_fit_packing
from quern.llm.toxicity import train, without_toxic
from quern.sources.tables import load

#: Where the tokenizer's vocabulary is; never copied into the repository.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    return without_toxic(docs, train(docs, load(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays."""
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or more often."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces of sequences."""
    return best_fit_packing(docs, TOKENIZER)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixing), ("packing", packing)]

#: No SQL for a trained classifier or a tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
