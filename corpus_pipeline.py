"""A training corpus from raw documents: language ID, line dedup, SimHash near-dedup, source mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's docs, all but
the last with the columns of documents. run() applies them to the table documents, each stage's result written
to the shared folder and read back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georank.llm import language_id, line_dedup, mixing, packing, simhash
from georank.llm.common import materialize, ship
from georank.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; text without a letter or near no profile goes."""
    ship(spark)
    profiles = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, profiles)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents with nothing left go."""
    ship(spark)
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of a similarity of five-word shingles of 0.8 or more: the one with the smallest id."""
    ship(spark)
    return simhash.keep_first(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped so that sources meet their target weights."""
    ship(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed in sequences; ids as little-endian unsigned 32-bit."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path(), capacity=4096, keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Profiles, XXH64 fingerprints and tokens have no SQL; tests hold run() against a plain version of the five stages on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
