"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html, jaccard, mixing, packing, permutation, pii, quality, suffix_tree, toxicity
from .common import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def default_tokenizer() -> str:
    """Where the public word-level BPE vocabulary lies; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return packed.withColumn("ids_crc32", F.crc32("token_ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "token_ids")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mixing": op3_source_mixing,
    "op4_surrogates": op4_surrogates,
    "op5_pivot_permutation": op5_pivot_permutation,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_toxicity": op7_toxicity,
    "op8_main_text": op8_main_text,
    "op9_packing": op9_packing,
    "op10_chat_format": op10_chat_format,
}
ORACLES = {
    "op3_source_mixing": mixing.ORACLE_SQL,
}
