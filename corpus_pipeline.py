"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and gets all rows its predecessor kept.
All but the last return the columns of ``documents``. Rows that hold nulls, empty
texts or repeated rows go through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import linededup, mixing, simhash, tokens, toxicity
from tapewright.llm.common import documents, materialize, release
from tapewright.llm.queries import piece_model


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches their language's cut."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three or more documents share, but for the largest doc_id's."""
    return linededup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates: texts with a Jaccard
    similarity of 0.8 or more on shingles of 5 words, found by three equal positional
    bytes and at most 10 differing bits in one of 28 fingerprints."""
    return simhash.drop_near_duplicates(docs, shingle=5, max_bits=10, similarity=0.8, tables=28)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights."""
    return mixing.sample_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document the mix took: doc_id, n_tokens, ids."""
    return tokens.encode_documents(docs, piece_model(), ("doc_id", "n_tokens", "ids"))


STAGES = [("toxicity", toxic), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("mix", mix), ("sentencepiece", encode)]
#: Training a classifier and fingerprint components have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
            release(before)  # a table that this run wrote itself; the input stays
    return docs
