"""A training corpus from the documents table: quality, near duplicates, decontamination, personal data, mixture.

Each stage reads what the one before it kept and wrote. ``run`` gives the rows of the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import decontaminate, mixing, nearjoin, pii, quality
from graticule.llm.queries import LANGUAGE_WEIGHTS
from graticule.llm.workspace import materialize, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents whose quality score is at least a half."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return quality.with_quality(docs, model, into=score).where(F.col(score) >= 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near duplicates."""
    return nearjoin.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents that are not contaminated by benchmark items."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all documents, with personal data replaced by its kind."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: a row for each document and epoch of the mixture, with mix_epoch and mix_tokens."""
    return mixing.mix(docs, LANGUAGE_WEIGHTS)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL has neither the trained classifier nor the seeded graph of contexts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
