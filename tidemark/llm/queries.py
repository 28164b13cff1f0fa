"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (backoff, decontam, frames, hard_negatives, jaccard_join, language, main_text, mixing, oracles, phrases,
                          quality, repeats, token_files, topk, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames.ship(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_jaccard_join", oracles.JACCARD)
def jaccard(table) -> DataFrame:
    return jaccard_join.linked_documents(table("documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_backoff_score", oracles.BACKOFF)
def backoff_score(table) -> DataFrame:
    return backoff.scored(table("documents"))


@query("op4_toxicity")
def toxic(table) -> DataFrame:
    docs = table("documents")
    model = toxicity.train(docs, table("labels"), ~frames.held_out("doc_id", 3, 1))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", frames.held_out("doc_id", 3, 1).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"), "lang_threshold", "flagged")


@query("op5_decontaminate")
def decontaminate(table) -> DataFrame:
    return decontam.overlaps(table("documents"), table("benchmark"))


@query("op6_mixing", oracles.MIXING)
def mixed(table) -> DataFrame:
    return mixing.taken(table("documents"))


@query("op7_token_files")
def tokens(table) -> DataFrame:
    shards = token_files.write_shards(table("documents"), tokenizer_path())
    return token_files.documents_of(shards)


@query("op8_quality")
def good(table) -> DataFrame:
    return quality.scored(table("documents"), table("labels"), F.col("source"), F.col("lang"))


@query("op9_language")
def languages(table) -> DataFrame:
    docs = table("documents")
    classifier = language.train(docs, ~frames.held_out("doc_id", 4, 2))
    return language.identified(docs, classifier).select(
        "doc_id", frames.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_top_k", oracles.TOP_K)
def top_k(table) -> DataFrame:
    return topk.nearest(table("embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_suffix_dedup", oracles.REPEATS)
def suffix_dedup(table) -> DataFrame:
    return repeats.without_repeats(table("documents"), keep_text=False)


@query("op11_hard_negatives", oracles.HARD_NEGATIVES)
def negatives(table) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table("embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op12_collocations", oracles.COLLOCATIONS)
def collocations(table) -> DataFrame:
    return phrases.collocations(table("documents"))


@query("op13_main_text")
def article(table) -> DataFrame:
    return main_text.extracted(table("pages"), main_text.train(table("pages")))
