"""A corpus pipeline of five of the operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns
of ``docs``, with ``text`` and ``n_chars`` as the stage leaves them.

Cases: as the operators state them.  Rows with a null id can't be named by a decision and
stay; other columns are passed on; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, minhash, packing, pii, quality
from tablewright.llm.common import beside, cut, forget, table, written


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return beside(docs, cut(ids.select("doc_id").distinct()), "doc_id", "left_anti", F.octet_length(F.col("doc_id").cast("string")) + 16)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that they leave depleted."""
    kept = quality.judged(docs).where("not _rejected")
    return _sized(kept.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the least id stays."""
    return _without(docs, minhash.near_duplicates(docs).where("doc_id <> group_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an item of the benchmark go."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks stand in the place of personal data."""
    return _sized(pii.masked(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in which training sequence."""
    return packing.best_fit(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("personal data", personal_data), ("best-fit packing", best_fit_packing)]
#: MinHash and a neural tagger can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages by turns; what a stage wrote for itself goes when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        before = written()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            forget(x for x in written()[:-1] if x not in before or x == last)
            last = written()[-1]
    return docs
