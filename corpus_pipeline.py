"""From raw documents to token files: five stages, each on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm.common import materialize, table
from keystrata.llm.decontaminate import drop_contaminated
from keystrata.llm.near_duplicates import drop_near_duplicates
from keystrata.llm.quality import keep_good
from keystrata.llm.source_mix import plan_mix, training_order
from keystrata.llm.token_files import as_read, token_files, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document has a row for each time it is taken."""
    return training_order(plan_mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in training order, which is that of the rows in the files of the stage before; a row for each document
    in them, read back."""
    return token_files(docs, tokenizer_path(), as_read(docs))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
