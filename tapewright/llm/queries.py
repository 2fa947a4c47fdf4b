"""One query per operator over the given tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import alignment, chat, licenses, linededup, mixing, negatives, quality, secrets, simhash, substrings, tokens, topk, toxicity
from tapewright.llm.common import documents


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differing")
    return tokens.encode_documents(documents(spark, sf_dir), piece_model(), columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(documents(spark, sf_dir))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], turns.schema)
    return chat.digests(turns.unionByName(probe))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), byte_vocabulary(), piece_model())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_toxicity, op3_simhash, op4_mixing, op5_licenses, op6_quality, op7_secrets, op8_line_dedup, op9_top_k, op10_chat, op11_negatives, op12_substrings, op13_alignment, pipeline)
}
ORACLE_SQL = {"op4_mixing": mixing.ORACLE_SQL, "op8_line_dedup": linededup.ORACLE_SQL, "op9_top_k": topk.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL, "op11_negatives": negatives.ORACLE_SQL}
