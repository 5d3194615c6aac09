"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, decontaminate, lattice, licenses, minhash, packing, pii, quality, substrings, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.preference_pairs(table(spark, sf_dir, "conversations")))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.likelihood(table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_filter": url_filter,
    "op2_near_duplicates": near_duplicates,
    "op3_chat_formatting": chat_formatting,
    "op4_decontamination": decontamination,
    "op5_license_scan": license_scan,
    "op6_lm_scoring": lm_scoring,
    "op7_quality_rules": quality_rules,
    "op8_personal_data": personal_data,
    "op9_best_fit_packing": best_fit_packing,
    "op10_substring_dedup": substring_dedup,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op1_url_filter": urls.sql(), "op3_chat_formatting": chat.SQL, "op7_quality_rules": quality.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
