"""A corpus pipeline of five stages, each a call of one training-data operator.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograin.llm import jaccard, mixing, packing, pii, quality
from echograin.llm.common import materialize, table
from echograin.llm.queries import default_tokenizer

#: Near-duplicates here are documents whose sets of five-word shingles have a similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return jaccard.one_of_each(docs, width=SHINGLE_WORDS, t=SIMILARITY)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    out = pii.replace(docs)
    replaced = F.col(out.columns[-1]) > 0
    return out.withColumn("n_chars", F.when(replaced, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, default_tokenizer())


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("PII", pii_stage), ("mixing sources to target weights", mixing_stage), ("packing", packing_stage)]

#: The stages are no SQL (shingle regions, keyed streams, online packing): tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
