"""A corpus from raw documents: language ID, exact and near deduplication, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are written as
Parquet and read again as the next stage's input. SQL cannot express the stages, so there is
no twin; tests hold the rows against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import exact_dedup, langid, mixing, near_dedup, packing
from panelweave.session import materialize

ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that is likelier than all others together, go."""
    return langid.identified_rows(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Similar to 0.8 or more in five-word shingles, directly or through others."""
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, up to twice."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
