"""Corpus preparation in stages, each over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; `run` writes it to the shared folder as Parquet and
reads it again as the next stage's documents. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontam, frames, jaccard_join, mixing, queries, token_files, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more under the classifier, fitted on the labelled documents, go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return toxicity.without_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    return decontam.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of the sources takes them: none, in part, or up to twice."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids as written files, read back: doc_id, start, n_tokens, ids_crc32 of each document."""
    return token_files.documents_of(token_files.write_shards(docs, queries.tokenizer_path()))


def _stage(work):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return work(frames.ship(spark), docs, sf_dir)
    run.__doc__ = work.__doc__
    return run


STAGES = [("toxicity", _stage(toxic_out)), ("jaccard_join", _stage(near_copies)),
          ("decontaminate", _stage(decontaminated)), ("mixing", _stage(mixed)), ("token_files", _stage(tokens))]

#: A trained classifier decides the first stage, which SQL can't repeat; tests/llm holds `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = frames.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
