"""A training corpus from raw documents: five stages, each a table that the next one reads.

Every stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of `documents`.
The results depend on trained weights and hashed samples, so SQL cannot express the whole. The tests hold the stages
of near duplicates, repeated strings, benchmark items and pieces against brute-force versions or the library on small
tables; the classifier's parts are held against plain sums and an exact solution of its fit in its own tests.

Null, empty, repeated and very long texts, repeated and null ids, further columns and empty tables are handled as each
stage's operator says; the result has a row per document that is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridhead.llm import decontaminate, near_dup, pieces, quality, suffix_dedup
from gridhead.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    return near_dup.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once go from the texts; the documents stay."""
    return suffix_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, and whether they decode to the text again."""
    found = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "lang", "source", "n_pieces", "ids", "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_class),
    ("suffix-array dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
