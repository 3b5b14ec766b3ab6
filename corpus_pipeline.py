"""The corpus pipeline: from raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again for the
next one. All but the last return the columns of documents. In all of them a null text counts as empty, a null
doc_id is a value like any other, rows are decided by doc_id and text together, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, language_id, mixing, packing, simhash
from millrace.session import Scratch, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table's labelled rows teach; those without letters, or in none of them, go."""
    return language_id.accepted(spark, docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id; of rows that repeat both, one."""
    return exact_dedup.exact_dedup(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike to 0.8 or more, the one of the smallest doc_id;
    rows without doc_id come last."""
    return simhash.near_dedup(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words aren't drawn."""
    return mixing.mixed(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    return packing.pack(spark, docs, packing.tokenizer_path())


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisers, model training and fingerprints aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each result written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
