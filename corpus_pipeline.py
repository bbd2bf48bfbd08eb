"""A corpus pipeline: language, repeated lines, near-duplicates, source weights, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import byte_bpe, language_id, line_dedup, mixing, ngram_join
from quantloom.llm.common import Scratch, discarding

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language, with or without a doc_id; ``und`` goes."""
    model = language_id.gather(language_id.learn(docs.where(~language_id.held_out())))
    return docs.where(language_id.language(docs, model) != language_id.UNKNOWN)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the later documents; a document left without a word goes.

    n_chars of a shortened text is counted anew; all else stays as it is.
    """
    found = line_dedup.trimmed(docs).where((F.col("lines_gone") == 0) | F.col("rest").rlike(mixing.WORD))
    new = {"text": F.col("rest"), "n_chars": F.when(F.col("lines_gone") > 0, F.length("rest")).otherwise(F.col("row.n_chars"))}
    return found.select(*(new.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of documents similar by five words and 80 % the one with the least doc_id."""
    found = ngram_join.similar_documents(docs, words=5, percent=80)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not, once or repeatedly."""
    return mixing.mixed(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the tokens and of what they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", detect_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("byte_bpe", encode),
]

#: Alignment, profiles and byte pair encoding are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of ``sf_dir``, each written to the shared folder."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with discarding():  # a stage's own tables, once its result is written
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
