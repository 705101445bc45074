"""Quality issues, their roll-ups, and contract checks as queries that should be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.parse import row_hash
from ..plans.registry import COMPARABLE
from .ordering import positions


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not; a null condition does not."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def issues(df: DataFrame, source: str, key: list[str], column: str, status: Column, rule: str, severity: str) -> DataFrame:
    """One row for each value whose status is not comparable, with an id of its lineage and rule."""
    bad = df.withColumn("status", status).where(~F.col("status").isin(*COMPARABLE))
    # escaped, so that no two keys meet
    row_key = F.concat_ws("|", *(F.replace(F.replace(F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for k in key))
    out = bad.select(F.lit(source).alias("source"), row_key.alias("row_key"), F.lit(column).alias("column_name"), "status", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    return out.withColumn("issue_id", row_hash(*(F.col(c) for c in ("source", "row_key", "column_name", "status", "rule"))))


def field_issues(df: DataFrame, source: str, key: str, columns: dict[str, str], severity: str) -> DataFrame:
    """Issues of many fields in one pass: like ``issues``, for parsed rows. columns: field to its raw column; the rule is source.field."""
    cells = F.array(*(F.struct(F.lit(raw).alias("column_name"), F.col(f"{f}__quality_status").alias("status"), F.lit(f"{source}.{f}").alias("rule")) for f, raw in columns.items()))
    out = df.select(F.col(key).cast("string").alias("row_key"), F.inline(cells)).where(~F.col("status").isin(*COMPARABLE))
    out = out.select(F.lit(source).alias("source"), "row_key", "column_name", "status", "rule", F.lit(severity).alias("severity"))
    return out.withColumn("issue_id", row_hash(*(F.col(c) for c in ("source", "row_key", "column_name", "status", "rule"))))


def rollup(issue_rows: DataFrame) -> DataFrame:
    """Counts by source, rule, severity and status, one pass: dimension, name, n_issues, n_rows."""
    dims = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("name")) for d in ("source", "rule", "severity", "status")))
    return issue_rows.select("source", "row_key", F.inline(dims)).groupBy("dimension", "name").agg(F.count(F.lit(1)).alias("n_issues"), F.count_distinct("source", "row_key").alias("n_rows"))


LEVELS = {"total": [], "source": ["source"], "rule": ["rule", "rule_version"], "severity": ["severity"], "status": ["status"], "quarantined": ["quarantined"]}


def full_rollup(issue_rows: DataFrame) -> DataFrame:
    """Issues at every level in one pass of grouping sets: dimension, name, version (of rules), n_issues, n_rows, n_quarantined_rows.

    issue_rows: source, row_key, rule, rule_version, severity, status,
    quarantined (boolean). Levels: total, source, (rule, version), severity, status,
    quarantined. A row counts once at a level, however many issues it has
    there. Without issues there are no rows.
    """
    columns = [c for cs in LEVELS.values() for c in cs]
    row, held = F.struct("source", "row_key"), F.coalesce(F.col("quarantined"), F.lit(False))
    # grouped columns stay apart from those that are counted, which grouping sets would set to null
    base = issue_rows.select(*(F.col(c).alias(f"_{c}") for c in columns), row.alias("row"), F.when(held, row).alias("held"))
    sets = [[F.col(f"_{c}") for c in cs] for cs in LEVELS.values()]
    out = base.groupingSets(sets, *(F.col(f"_{c}") for c in columns)).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_issues"), F.count_distinct("row").alias("n_rows"), F.count_distinct("held").alias("n_quarantined_rows"))
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    everything = sum(bit.values())
    dimension = name = F.lit(None).cast("string")
    for d, cs in LEVELS.items():
        here = F.col("level") == everything - sum(bit[c] for c in cs)
        dimension = F.when(here, d).otherwise(dimension)
        if cs:
            name = F.when(here, F.col(f"_{cs[0]}").cast("string")).otherwise(name)
    return out.select(dimension.alias("dimension"), name.alias("name"), F.col("_rule_version").cast("string").alias("version"), "n_issues", "n_rows", "n_quarantined_rows")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Repeats of a row that are written out at once.
REPEATS = 4096


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one of two tables has; empty for equal tables. Both are read and dealt out once."""
    own = [f"c{i}" for i in range(len(a.columns))]
    both = a.toDF(*own).withColumn("n", F.lit(1).cast("long")).unionAll(b.toDF(*own).withColumn("n", F.lit(-1).cast("long")))
    n = F.abs("n")
    more = both.groupBy(*own).agg(F.sum("n").alias("n")).where("n != 0")
    # repeats in blocks, so that a row with very many is no long array
    blocks = more.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / REPEATS))))
    rows = blocks.withColumn("only_in", F.explode(F.array_repeat(F.when(F.col("n") > 0, "left").otherwise("right"), F.least(F.lit(REPEATS).cast("long"), n - F.col("block") * REPEATS).cast("int"))))
    return rows.select(*own, "only_in").toDF(*a.columns, "only_in")


def out_of_order(df: DataFrame, position: str, key: str, by: list[str]) -> DataFrame:
    """Rows whose key is less than the one before them within ``by``."""
    w = W.partitionBy(*by).orderBy(position)
    return df.withColumn("before", F.lag(key).over(w)).where(F.col(key) < F.col("before"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, blank, nonblank, numeric_zero, max_text of text columns, in one aggregation."""
    aggs = []
    for c in columns:
        text = F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count_if(text == "").alias("blank"), F.count_if(text != "").alias("nonblank"),
            F.count_if(F.coalesce(text.try_cast("decimal(38,18)") == 0, F.lit(False))).alias("numeric_zero"), F.max(F.when(text != "", text)).alias("max_text")).alias(c))
    return df.agg(*aggs).select(F.inline(F.array(*(F.col(c) for c in columns))))


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """times, n_keys: how many keys occur how often, for those that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").groupBy("times").agg(F.count(F.lit(1)).alias("n_keys"))


def nearest_rank(df: DataFrame, value: str, percent: int, by: list[str]) -> DataFrame:
    """The ceil(p*n/100)-th smallest value of each group (not an interpolated percentile).

    Rows are counted by value first, with map-side combining; only distinct
    values are sorted.
    """
    w = W.partitionBy(*by)
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_times"))
    so_far = F.sum("_times").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    at = F.ceil(F.col("_n") * percent / 100)
    placed = counted.withColumns({"_so_far": so_far, "_n": F.sum("_times").over(w)})
    return placed.where((F.col("_so_far") >= at) & (F.col("_so_far") - F.col("_times") < at)).select(*by, F.col(value).alias(f"p{percent}"))


def table_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and a hash of a table that does not depend on the order of its rows: sums of four parts of row hashes."""
    h = row_hash(*(F.col(c) for c in columns))
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("table_hash"))


def contract_problems(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Tables (table_name, n_rows, table_hash) that are missing, unexpected or different; empty for a kept contract."""
    a = actual.select("table_name", F.col("n_rows").alias("rows_now"), F.col("table_hash").alias("hash_now"))
    both = expected.join(a, "table_name", "full")
    problem = F.when(F.col("rows_now").isNull(), "missing").when(F.col("n_rows").isNull(), "unexpected").when(F.col("n_rows") != F.col("rows_now"), "row count differs").when(F.col("table_hash") != F.col("hash_now"), "content differs")
    return both.select("table_name", problem.alias("problem")).where("problem is not null")


def affected_rows(issue_rows: DataFrame, quarantining: list[str]) -> DataFrame:
    """By source: rows with any issue, and rows with one of a status that quarantines."""
    return issue_rows.groupBy("source").agg(F.count_distinct("row_key").alias("affected_rows"), F.count_distinct(F.when(F.col("status").isin(quarantining), F.col("row_key"))).alias("quarantined_rows"))


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which each comes first: value, position."""
    first = df.groupBy(value).agg(F.min(order).alias("_first"))
    return positions(first, ["_first", value]).drop("_first")
