"""The queries of this subpackage by name, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notewright.llm import (
    centroids,
    decontamination,
    filter_audit,
    html_extraction,
    language_model,
    license_scan,
    mixing,
    pii,
    quality_trees,
    simhash,
    suffix_dedup,
    toxicity,
    weak_supervision,
)
from notewright.llm.oracles import ORACLES  # noqa: F401


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components over whole documents."""
    return simhash.simhash_groups(_docs(spark, sf_dir))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as (doc_id, item_id) pairs with how much of it."""
    return decontamination.find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier document holds."""
    return suffix_dedup.dedup_digest(_docs(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the weakly supervised verdict for every document."""
    return weak_supervision.judge_quality(_docs(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, slot and position in the mix of sources, at square-root weights."""
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return mixing.mix_sources(docs)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extraction.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and language-model score of every document."""
    return language_model.score_texts(_docs(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold."""
    return toxicity.score_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned outside the held-out fold."""
    return quality_trees.score_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, the digest of the base spans, and all spans."""
    return pii.span_digest(pii.find_personal_data(_docs(spark, sf_dir)))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every document names or quotes."""
    return license_scan.scan_licenses(_docs(spark, sf_dir))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and distance after three rounds."""
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order of them, by language."""
    return filter_audit.audit_filters(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_source_mixing": op5_source_mixing,
    "op6_html_extraction": op6_html_extraction,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_pii": op10_pii,
    "op11_license_scan": op11_license_scan,
    "op12_centroids": op12_centroids,
    "op13_filter_audit": op13_filter_audit,
}
