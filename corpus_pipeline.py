"""A corpus in five stages: clean of toxic texts, in an identified language, without near copies, mixed to weights, encoded.

Each stage works on all rows its predecessor kept, is written as Parquet and read again. The last one
has the token ids of the corpus.

Edge cases: null and empty texts aren't toxic, have no language and go with the second stage; null ids
go through like others; of repeated rows, equal texts and near copies one stays; an empty table, and
labels without documents, give an empty result. Extra columns are kept up to the last stage.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import bpe, langid, mixing, set_join, toxicity
from skyloom.llm._tables import shared_folder


#: Texts are handed to Python so many rows at a time, which bounds what a task holds of them outside the heap.
ROWS = "1000"


def small_batches(stage):
    """A stage whose rows go to Python in small batches, whoever writes its result: the setting is the session's from here on, until ``run`` ends."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@small_batches
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language has at least half the words."""
    return langid.keep_identified(docs, langid.fit(docs))


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of exact and near copies."""
    return set_join.keep_representatives(docs)


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by raked source, language and topic weights, no document twice."""
    return mixing.sample(docs)


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and digests."""
    return bpe.token_digests(docs, bpe.vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Trained models and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the session's own setting for Python's batches is back when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return docs
