"""Scores of answers against reviewed cases, as aggregates over (case_id, item, position) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CASE = "case_id string, category string, question string, expected_plan string, expected_result string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed cases of JSON lines; the plans' mixed literals stay text."""
    return spark.read.schema(CASE).json(path)


def repeated_cases(cases: DataFrame) -> DataFrame:
    """Case ids that stand more than once in or across suites; empty for a sound suite."""
    return cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def f1(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id, precision, recall and f1 of items, distinct in a case; a case with nothing on both sides scores 1."""
    e, a = expected.select("case_id", "item").distinct().withColumn("e", F.lit(1)), actual.select("case_id", "item").distinct().withColumn("a", F.lit(1))
    both = e.join(a, ["case_id", "item"], "full").groupBy("case_id").agg(F.count("e").alias("n_e"), F.count("a").alias("n_a"), F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("hit"))
    precision = F.when(F.col("n_a") > 0, F.col("hit") / F.col("n_a")).otherwise(F.when(F.col("n_e") == 0, 1.0).otherwise(0.0))
    recall = F.when(F.col("n_e") > 0, F.col("hit") / F.col("n_e")).otherwise(F.when(F.col("n_a") == 0, 1.0).otherwise(0.0))
    return both.select("case_id", precision.alias("precision"), recall.alias("recall"), F.when(F.col("n_e") + F.col("n_a") > 0, 2 * F.col("hit") / (F.col("n_e") + F.col("n_a"))).otherwise(1.0).alias("f1"))


def order_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id and the share of neighbours in the expected order that the answer has in the same order."""
    nexts = expected.withColumn("following", F.lead("item").over(W.partitionBy("case_id").orderBy("position"))).where("following is not null")
    at = actual.groupBy("case_id", "item").agg(F.min("position").alias("at"))
    joined = nexts.join(at, ["case_id", "item"], "left").join(at.select("case_id", F.col("item").alias("following"), F.col("at").alias("after")), ["case_id", "following"], "left")
    return joined.groupBy("case_id").agg(F.avg(F.coalesce(F.col("at") < F.col("after"), F.lit(False)).cast("double")).alias("order_accuracy"))
