"""From raw documents to a training mix: five stages, each on all that the one before kept.

run() applies STAGES to the table documents; each stage's result is written to the shared folder and read
again as the next one's input. Null texts and texts under ten words end in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dutymark.llm.common import saved, table
from dutymark.llm.decontaminate import drop_copies
from dutymark.llm.jaccard import drop_near_duplicates
from dutymark.llm.mixing import mix
from dutymark.llm.pii import redact
from dutymark.llm.quality_rules import fit_forest, keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return keep_good(docs, fit_forest(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return drop_copies(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars adapted."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order; adds copy and mix_key."""
    return mix(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("mixing", mixing)]

#: SQL has neither the forest nor the redaction; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
