"""Corpus pipeline: language ID, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result to the shared folder and reads it back for the next.

Null, empty and letterless texts go in the first stage. Rows that repeat a doc_id are rows of their own, but near-dedup takes
them as one document. Null doc_ids stay unless their text equals one of a row with an id; null sources are a source of their
own. Very long texts are worked on whole. Extra columns are kept. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe_codec, exact_dedup, language_id, mixing, near_dedup
from tallyweave.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages learnt from the labelled documents; their lang column is as it was."""
    learnt_from = language_id.labelled(docs).select("text", "lang", "doc_id")
    return language_id.keep_identified(docs, language_id.fit(learnt_from, key=F.col("doc_id")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, the one with the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, repeats included, to each source's target share of words."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that the mix takes, a row for each time."""
    return bpe_codec.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact),
    ("near-dedup", drop_near),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: Near-dedup and balanced sampling have no SQL form; each stage's operator is tested against brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
