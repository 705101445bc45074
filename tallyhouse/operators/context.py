"""Evidence packed for a reader of bounded size: sources as a dictionary, rows that point into it, a byte budget.

Distinct sources get dense ids by the order of their keys. Evidence rows keep
the id in place of the source. Rows are kept in their order while the
running size of dictionary and rows stays within the budget; from the first that does not
fit, rows are summed up by product type and field, so that what is left out is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import positions, running_sums

SOURCE = ("source_table", "source_file", "source_sheet", "source_checksum", "source_snapshot_date")
#: Columns of a packed row, besides the source's id.
PACKED = ("evidence_id", "product_type", "product_id", "field", "value", "status")


@dataclass(frozen=True)
class Context:
    """sources: source_id and its key. kept: source_id, PACKED, n_bytes, so_far. overflow: product_type, field, n_rows, n_bytes of rows beyond the budget."""

    sources: DataFrame
    kept: DataFrame
    overflow: DataFrame


def compact(columns: list[Column]) -> Column:
    """A row as compact JSON of texts, nulls kept."""
    return F.to_json(F.array(*(c.cast("string") for c in columns)), {"ignoreNullFields": "false"})


def packed_context(evidence: DataFrame, order: list[str], budget: int) -> Context:
    """``evidence`` (SOURCE, PACKED and the columns of ``order``) under a budget of bytes; the dictionary is paid first and always whole."""
    keys = evidence.select(*SOURCE).distinct()
    sources = positions(keys, list(SOURCE), "_n").select((F.col("_n") - 1).alias("source_id"), *SOURCE)
    paid = sources.agg(F.coalesce(F.sum(F.octet_length(compact([F.col(c) for c in SOURCE]))), F.lit(0))).first()[0]
    named = sources.select("source_id", *(F.col(c).alias(f"_{c}") for c in SOURCE))
    on = F.lit(True)
    for c in SOURCE:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = evidence.join(named, on).drop(*(f"_{c}" for c in SOURCE), *SOURCE)
    rows = rows.withColumn("n_bytes", F.octet_length(compact([F.col("source_id"), *(F.col(c) for c in PACKED)])).cast("long"))
    summed = running_sums(rows, order, "n_bytes").withColumn("so_far", F.col("so_far") + F.lit(paid))
    kept = summed.where(F.col("so_far") <= budget)
    overflow = summed.where(F.col("so_far") > budget).groupBy("product_type", "field").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
    return Context(sources, kept.select("source_id", *PACKED, "n_bytes", "so_far"), overflow)
