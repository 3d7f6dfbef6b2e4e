"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it
kept, and returns a DataFrame; all but the last have the columns of ``documents``, with
any further ones that these have. An empty table passes through every stage; very long
texts count whole in all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, langid, near_duplicates, packing, substrings
from maskwright.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of null text or without a letter and those whose language is too close to call; repeated rows fare alike."""
    return langid.accepted(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the least doc_id, once if the row is repeated. Rows of null text all stay."""
    return near_duplicates.distinct_documents(docs)


def remove_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of spans that stand elsewhere first are cut out; ``n_chars`` follows the text. All rows stay, of null text too; repeated ones come out alike."""
    clean = substrings.dedup(docs, both_ends=True)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null and empty texts, and all where the benchmark is empty, stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens; null and empty texts are their end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_spans),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

#: No stage but the reading of tables can be said in SQL; the tests of the operators behind them have brute-force versions (langid: held-out accuracy).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
