"""Cleaning of a document collection: stages over whole tables, each with the rows its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows that stay,
with the columns of ``documents`` (the last: the encoded documents). ``run`` applies them to ``documents``.
A stage's result is written once to the shared checkpoint folder, and the next stage reads it from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm import bpe, decontam, simhash, toxicity
from salescope.llm.common import cut, read
from salescope.llm.queries import tokenizer


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject; it learns from all labels of these documents."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.clean(docs, model)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies: the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (``ids``), their number (``n_tokens``) and the decoded text."""
    source = bpe.load(tokenizer(TOKENIZER))
    return bpe.encode_and_decode(docs, source).withColumn("n_tokens", F.size("ids").cast("long"))


TOKENIZER = "word_bpe_49k.json"

STAGES = [("toxicity", remove_toxic), ("simhash_dedup", remove_near_copies), ("decontamination", remove_contaminated), ("bpe", encode)]

#: A learned lexicon, XXH64 and a tokenizer's merges cannot be written in SQL; tests/llm holds brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
