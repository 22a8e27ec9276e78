"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs. All but the
last return the columns of docs. A row without a doc_id passes or fails each stage on its own: it is no near duplicate of
anything, and an exact copy of a row with an id goes. Rows that repeat an id and its text are one document in several rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rutine.llm import blocknames, bpe, langid, mixing, ngram_join
from rutine.llm.common import free, written

#: Mean probability of the predicted language below which a document is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter, and those of which the network is unsure, go.

    The network learns from the labelled documents from which op3 learns."""
    net = langid.train(docs.where(~langid.held_out()))
    lang, score = free(docs.columns, "lang_pred"), free(docs.columns, "score")
    judged = langid.with_language(docs, net, names=(lang, score))
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return blocknames.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id: five words, a similarity of 0.8."""
    classes = ngram_join.similar_classes(docs.select("doc_id", "text"), words=5, percent=80)
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(written(gone, "near").hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources of op5: a document that the mix takes twice is there twice, one that it does not take is not.

    Rows that repeat an id share a fate; a null source is a source; a text without words has size 0 and gives nothing. Rows do not move."""
    return mixing.mixed_rows(docs, mixing.word_count("text"), F.array("source"), mixing.cyclic_targets())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row of the mix, repeated rows each. A null text is an empty one, with no tokens."""
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("tokens", tokens)]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", ""))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
