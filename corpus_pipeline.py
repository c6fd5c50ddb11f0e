"""From raw documents to packed sequences: language, exact copies, near copies, personal data, packing.

Each stage works on all that the one before it kept, is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import exact_dedup, jaccard_join, language_id, packing, pii
from kerbside.llm.common import stored, without

#: Executors have grown by the time of the last stage, so that its workers remember a quarter of what they do alone.
REMEMBERED_PIECES = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted und, which are those without letters; the model learns from the lang of the documents themselves."""
    return language_id.accepted(docs, language_id.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return without(docs, stored(exact_dedup.exact_duplicates(docs).where("not kept").select("rid"), "dropped"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links join, the row with the least doc_id."""
    return without(docs, stored(jaccard_join.similar_groups(docs).where("not kept").select("rid"), "dropped"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the kind of each piece of personal data in its place; n_chars is that of the new text."""
    return pii.masked(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, remembered=REMEMBERED_PIECES)


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("pii", personal_data), ("best_fit_packing", pack)]

#: SQL can't express language identification; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
