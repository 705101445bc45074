"""A corpus in five stages: judged, deduplicated, decontaminated, freed of personal data, mixed.

Every stage takes all that the one before kept and, but for the last, returns
the columns of ``documents``. The last returns the documents of the mix with
the words it takes of each (repeats counted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.decontamination import decontaminated
from tallyhouse.llm.jaccard_join import one_of_each_group
from tallyhouse.llm.mixing import mixed_documents
from tallyhouse.llm.pii import mask_pii
from tallyhouse.llm.quality_classifier import accepted
from tallyhouse.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the text."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by their weights."""
    return mixed_documents(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
