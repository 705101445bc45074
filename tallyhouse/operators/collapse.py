"""Several source rows of one product made one: best lot, consensus or conflict, range, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import row_hash


def best_row(df: DataFrame, by: list[str], value: str, ties: list[Column]) -> DataFrame:
    """The row with the largest value of each group, nulls last, ties by the given order."""
    w = W.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def consensus(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, status, n_values: the value on which all rows of a group agree, or null as mixed_source_values.

    A null counts as a value of its own.
    """
    kinds = F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("\0")))
    return df.groupBy(*by).agg(
        F.when(kinds == 1, F.min(value)).alias("value"), F.when(kinds == 1, "valid").otherwise("mixed_source_values").alias("status"), kinds.alias("n_values"))


def conflict_issues(df: DataFrame, source: str, key: str, columns: dict[str, str], rule: str, severity: str = "warning") -> DataFrame:
    """An issue for each field on which the rows of a group differ, in one pass over all fields; shaped as ``quality.field_issues``.

    columns: field to its raw column; the rule is rule.field. A null counts as a value of its own.
    """
    kinds = [(F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("")))).alias(f"_n_{f}") for f in columns]
    cells = F.array(*(F.struct(F.lit(raw).alias("column_name"), F.lit("mixed_source_values").alias("status"), F.lit(f"{rule}.{f}").alias("rule"), F.col(f"_n_{f}").alias("n")) for f, raw in columns.items()))
    out = df.groupBy(key).agg(*kinds).select(F.col(key).cast("string").alias("row_key"), F.inline(cells)).where("n > 1")
    out = out.select(F.lit(source).alias("source"), "row_key", "column_name", "status", "rule", F.lit(severity).alias("severity"))
    return out.withColumn("issue_id", row_hash(*(F.col(c) for c in ("source", "row_key", "column_name", "status", "rule"))))


def value_range(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def lineage(df: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """by and the sorted distinct sources of each group. Groups are lots of one product, a small number by nature."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(*parts))).alias("sources"))
