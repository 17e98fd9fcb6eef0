"""The corpus pipeline: toxicity, near-copy and substring dedup, mixing and BPE, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import bpe, mixing, simhash, substring_dedup, toxicity
from fieldloom.llm.common import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic.

    Null and empty texts are judged by the models' intercepts; repeated rows are judged alike; without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    Null and empty texts are copies of each other; the smallest doc_id stays, and rows that share it stay together; a row
    without a doc_id stays only in a group that has no other.
    """
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that repeat.

    Null and short texts stay as they are; repeated rows are copies of each other and lose all words of their windows.
    """
    return substring_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them.

    A null source is a source; documents without words go along by their keys; rows that tie at a cut are counted, and as
    many stay as come nearest the target.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the mix, a row for each copy; null texts are empty."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # classifiers, XXH64 fingerprints and BPE have no SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; every stage but the last is a table in the shared folder.  An empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
