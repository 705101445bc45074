"""Exact links between sources on a shared identifier, their conflicts and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import row_hash
from .quality import duplicate_keys


def exact_links(left: DataFrame, right: DataFrame, rule: str, version: str = "1.0.0", left_table: str = "left", right_table: str = "right") -> DataFrame:
    """left_id, right_id, raw_identifier, rule, link_id of rows (id, raw_identifier) that share a non-blank identifier.

    link_id is a hash of the rule, its version, both tables with their ids, and
    the identifier.
    """
    a = left.where("raw_identifier is not null and raw_identifier != ''").select(F.col("id").alias("left_id"), "raw_identifier")
    b = right.where("raw_identifier is not null and raw_identifier != ''").select(F.col("id").alias("right_id"), "raw_identifier")
    out = a.join(b, "raw_identifier").withColumn("rule", F.lit(rule))
    return out.withColumn("link_id", row_hash(F.col("rule"), F.lit(version), F.lit(left_table), F.col("left_id"), F.lit(right_table), F.col("right_id"), F.col("raw_identifier")))


def conflicts(links: DataFrame) -> DataFrame:
    """side, id, n_partners of every id linked to more than one partner; empty for good links."""
    def side(name, own, other):
        return links.groupBy(F.col(own).alias("id")).agg(F.count_distinct(other).alias("n_partners")).where("n_partners > 1").select(F.lit(name).alias("side"), "id", "n_partners")

    return side("left", "left_id", "right_id").unionByName(side("right", "right_id", "left_id"))


def problems(links: DataFrame, expected: int | None = None) -> DataFrame:
    """problem, n of what keeps links from being published: conflicting ends, repeated pairs, another number of links than expected."""
    ends = conflicts(links).groupBy(F.concat(F.lit("conflict on the "), "side").alias("problem")).agg(F.count(F.lit(1)).alias("n"))
    pairs = duplicate_keys(links, ["left_id", "right_id"]).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("repeated pair").alias("problem"), "n")
    out = ends.unionByName(pairs)
    if expected is not None:
        out = out.unionByName(links.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select(F.lit("number of links").alias("problem"), "n"))
    return out


def linked_records(products: DataFrame, id_column: str, links: DataFrame, end: str) -> DataFrame:
    """The whole records of the products at one end (left_id or right_id) of any link, each once."""
    ids = links.select(F.col(end).alias(id_column)).distinct()
    return products.join(ids, id_column, "left_semi")


def evidence(links: DataFrame) -> DataFrame:
    """Two rows a link: its left and its right end."""
    ends = F.array(F.struct(F.lit("left").alias("role"), F.lit(0).cast("bigint").alias("ordinal"), F.col("left_id").alias("id")), F.struct(F.lit("right").alias("role"), F.lit(1).cast("bigint").alias("ordinal"), F.col("right_id").alias("id")))
    return links.select("link_id", F.inline(ends))


def of_either_side(links: DataFrame, key) -> DataFrame:
    return links.where((F.col("left_id") == key) | (F.col("right_id") == key)).orderBy("left_id", "right_id")


# fixed values: what places a cell of a source
CELL_KEY = (
    "source_table", "source_file", "source_sheet", "source_row_number", "source_column_name", "source_column_number", "source_column_letter",
    "source_checksum", "source_snapshot_date", "source_applicable_date",
)


def with_cell(link_evidence: DataFrame, cells: DataFrame) -> DataFrame:
    """Evidence (CELL_KEY and raw_identifier) with whether the source has that very cell; an unstated applicable date meets an unstated one."""
    cells = cells.withColumnRenamed("raw_value", "raw_identifier")
    return matched(link_evidence, cells, [*CELL_KEY, "raw_identifier"], ("source_applicable_date",))


def matched(left: DataFrame, right: DataFrame, keys: list[str], null_safe: tuple[str, ...] = (), flag: str = "is_matched") -> DataFrame:
    """Every left row with whether the right side has its key; null-safe keys match nulls."""
    r = right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias(flag)).distinct()
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}")) if k in null_safe else F.col(k) == F.col(f"_{k}")
        on = one if on is None else on & one
    return left.join(r, on, "left").drop(*(f"_{k}" for k in keys)).withColumn(flag, F.coalesce(flag, F.lit(False)))
