"""The registered queries of the operators, op1 to op10, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, media, mixing, nearjoin, pii, quality, sampling, secrets, toxicity, urlfilter
from .sql import ORACLES

#: The rules of the URL query.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LANGUAGE_WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, mix_epoch, mix_tokens of each document and epoch that the mixture reads."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, LANGUAGE_WEIGHTS, keep=("doc_id", "lang", "source"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return _scored(quality.with_quality(docs, model), 0.5)


def _scored(docs: DataFrame, cut: float) -> DataFrame:
    return docs.select("doc_id", sampling.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = language.with_language(docs, language.fit_language(docs))
    return marked.select("doc_id", sampling.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "_lang.lang_pred", "_lang.score", "_lang.rejected")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rules} AS t(rule_host, rule_path, verdict)")).drop("n_matches")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return _scored(toxicity.with_toxicity(docs, model), 0.7)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    n_words, n_hit = F.col("_hits.n_words"), F.col("_hits.n_hit")
    return marked.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), "_hits.n_items", "_hits.items_sha256", decontaminate.is_contaminated(n_hit, n_words).alias("contaminated"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_source_mixing, op2_secret_scan, op3_near_duplicates, op4_quality, op5_language, op6_url_filter, op7_toxicity, op8_media_columns, op9_decontamination, op10_pii)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
