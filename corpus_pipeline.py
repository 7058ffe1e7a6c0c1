"""A training-corpus pipeline over the table documents; part of the subpackage millrace.llm.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns
of docs. run() applies them in order, each to what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, mixing, quality, simhash, token_store
from millrace.llm.queries import table, tokenizer_file
from millrace.storage import Run


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and what they hold of each document."""
    return token_store.token_output(docs, tokenizer_file(), end_id=2)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
    ("token output", write_tokens),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way, and its input, go when its output is there."""
    docs = table(spark, sf_dir, "documents")
    with Run() as mine:
        for name, stage in STAGES[:-1]:
            docs = mine.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)
